"""Quality rules: a learned decision list over text statistics.

Statistics and verdicts are built-in SQL expressions; nothing of a row's path
leaves the JVM. The list is learned by sequential covering: rules are grown
one threshold at a time on two thirds of a bounded labelled sample, pruned on
the rest, and come out as ordered ``CASE WHEN`` branches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from keyloom.llm.common import free

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
SAMPLE = 20_000  #: labelled rows that the list is learned from, at most
FEATURES = ("mean_word", "symbol_share", "upper_share", "bang_share", "dup_line_share", "repeat_share", "distinct_share")


def bind(value: Column, then) -> Column:
    """``then(value)`` with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def once(value: Column) -> Column:
    """``value``, computed once for each row.

    The optimizer neither copies an expression that numbers rows into every
    place that uses it, nor moves a filter on it below it. Numbers are never
    negative, so they change no value.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def _covered(words: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the row."""

    def windows(codes: Column) -> Column:
        two = F.transform(codes, lambda h, i: F.xxhash64(h, F.get(codes, i + 1)))
        return bind(
            two,
            lambda p: bind(
                F.transform(p, lambda h, i: F.xxhash64(h, F.get(p, i + 2))),
                lambda q: F.transform(
                    F.sequence(F.lit(0), F.size(codes) - WINDOW), lambda i: F.xxhash64(F.get(q, i), F.get(q, i + 4))
                ),
            ),
        )

    def spread(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeated(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda x, j: F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))
                        | F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def count(codes: Column) -> Column:
        return F.when(F.size(codes) < WINDOW + 1, F.lit(0)).otherwise(
            bind(
                windows(codes),
                lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(bind(repeated(h), spread)),
            )
        )

    return bind(F.transform(words, lambda w: F.xxhash64(w)), count)


def added(columns: list[str]) -> list[str]:
    """Names of the columns that :func:`judge` adds to those, of which the first is that of :func:`statistics`: ``_q`` and ``_kept`` where they are unused."""
    return free(columns, "_q", "_kept")


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct (see :func:`added`) of its text's counts and shares.

    A null or empty text has no words and all counts 0; shares over nothing are
    0. Repeated rows repeat; other columns are passed on; an empty table gives
    no rows.
    """
    name = added(docs.columns)[0]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def gone(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.withColumn(
        name,
        once(bind(
            words,
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                gone(r"[#*$%&|<>]").alias("n_symbols"),
                bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                _covered(w).cast("long").alias("n_repeat_words"),
                F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
                gone(r"\p{Lu}").alias("n_upper"),
                gone("!").alias("n_bangs"),
                (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
            ),
        )),
    )
    q = F.col(name)

    def share(a: str, b: str) -> Column:
        return F.when(q[b] > 0, q[a] / q[b]).otherwise(F.lit(0.0))

    return first.withColumn(
        name,
        F.struct(
            f"{name}.*",
            share("word_chars", "n_words").alias("mean_word"),
            share("n_symbols", "word_chars").alias("symbol_share"),
            share("n_upper", "word_chars").alias("upper_share"),
            share("n_bangs", "n_words").alias("bang_share"),
            share("n_dup_lines", "n_lines").alias("dup_line_share"),
            share("n_repeat_words", "n_words").alias("repeat_share"),
            share("n_distinct", "n_words").alias("distinct_share"),
            ((q["n_words"] < 20) | (100 * q["n_repeat_words"] > 30 * q["n_words"])).alias("base_failed"),
        ),
    )


@dataclass
class DecisionList:
    """Ordered rules; a row is rejected by the first whose conditions all hold.

    Each condition: (feature, "<=" or ">", threshold).
    """

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def rejects(self, stats: Column) -> Column:
        out = None
        for rule in self.rules:
            hit = F.lit(True)
            for name, side, at in rule:
                hit = hit & (stats[name] <= at if side == "<=" else stats[name] > at)
            out = F.when(hit, True) if out is None else out.when(hit, True)
        return F.lit(False) if out is None else out.otherwise(False)

    def describe(self) -> list[str]:
        return ["reject if " + " and ".join(f"{n} {s} {t:.6g}" for n, s, t in rule) for rule in self.rules]


def _hits(x: np.ndarray, rule: list[tuple[int, str, float]]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, side, at in rule:
        hit &= x[:, f] <= at if side == "<=" else x[:, f] > at
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, longest: int) -> list[tuple[int, str, float]]:
    rule: list[tuple[int, str, float]] = []
    hit = np.ones(len(x), bool)
    while len(rule) < longest and (hit & ~bad).any():
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        best = (1e-9, None)
        for f in range(x.shape[1]):
            v = x[hit, f]
            at = np.unique(np.quantile(np.concatenate((v, x[hit & bad, f])), np.linspace(0, 1, 65), method="lower"))
            at = (at[1:] + at[:-1]) / 2
            if not len(at):
                continue
            y = bad[hit]
            below = v[:, None] <= at[None, :]
            pb, nb = (below & y[:, None]).sum(0), (below & ~y[:, None]).sum(0)
            for side, p, n in (("<=", pb, nb), (">", p0 - pb, n0 - nb)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, side, float(at[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = _hits(x, rule)
    return rule


def learn(rows: list[tuple], features: tuple[str, ...] = FEATURES, precision: float = 0.97, least: int = 5, most_rules: int = 16, longest: int = 4) -> DecisionList:
    """Sequential covering over ``(key, is_bad, *features)`` rows, in the order of key.

    A rule enters the list if it is right for ``precision`` of the rows that it
    covers and covers ``least`` rejected ones; covering ends at the first that isn't.
    """
    rows = sorted(rows)
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(features))
    bad = np.array([r[1] for r in rows], bool)
    growing = np.arange(len(rows)) % 3 != 2
    left, out = np.ones(len(rows), bool), DecisionList()
    while len(out.rules) < most_rules and (bad & left & growing).any():
        g, v = left & growing, left & ~growing
        rule = _grow(x[g], bad[g], longest)
        score = lambda r: ((_hits(x[v], r) & bad[v]).sum() + 1) / (_hits(x[v], r).sum() + 2)
        while len(rule) > 1 and score(rule[:-1]) >= score(rule):
            rule = rule[:-1]
        hit = _hits(x, rule) & left if rule else np.zeros(len(rows), bool)
        if not rule or (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum():
            break
        out.rules.append([(features[f], side, at) for f, side, at in rule])
        left &= ~hit
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DecisionList:
    """The list for ``docs`` by ``labels`` (doc_id, quality: 0 is to be rejected).

    Learned from at most ``sample`` labelled rows, those of least hash of
    doc_id, among texts that the base rules pass; of documents that repeat a
    doc_id one counts, that of least statistics. Without both classes the list
    is empty and rejects nothing.
    """
    chosen = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    found = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = (
        found.where(~F.col("_q.base_failed"))
        .groupBy("doc_id")
        .agg(F.min(F.struct(F.xxhash64("doc_id").alias("key"), (F.col("_quality") == 0).alias("bad"), *[F.col(f"_q.{f}").alias(f) for f in FEATURES])).alias("row"))
        .select("row.*")
        .collect()
    )
    return learn([tuple(r) for r in rows])


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with the struct of :func:`statistics` and whether the base rules and the list pass the row (see :func:`added`).

    Null and empty texts have no words, so the base rules reject them. Repeated
    rows repeat; other columns are passed on, whatever their names; an empty
    table gives no rows.
    """
    stats, kept = added(docs.columns)
    found = statistics(docs)
    return found.withColumn(kept, ~F.col(f"{stats}.base_failed") & ~rules.rejects(F.col(stats)))


def query(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    judged = judge(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    base = [F.col(f"_q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return judged.select("doc_id", *base, F.col("_kept").alias("kept"))
