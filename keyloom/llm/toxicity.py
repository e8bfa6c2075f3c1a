"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns each word into a symbol: the set of the classes that it is in
(insult, threat, target, negation, reporting, intent) and a weight. Five
transducers read the symbols of a clause, one each for insults, threats,
targets, negation and reported speech; composed into one, they scale the weight
of every insult and threat by its context. A document scores by its matched
clauses, never by a word outside the grammar.

Insults are learned: words and word beginnings that labelled toxic texts use
and others don't. The scale from clause weights to 0..1 is learned as well.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from keyloom.llm.common import Batches, materialize, slim
from keyloom.llm.langid import held_out

SAMPLE = 20_000  #: labelled rows learned from, at most: those of least hash of doc_id
CHANCE = 1e-7  #: a pattern is taken if chance gives its labels less often
PURITY = 0.9  #: least toxic share of the labelled texts that hold a pattern
ODDS = 2.5  #: least log odds ratio of a pattern
PREFIXES = (3, 4, 5, 6)
ALIKE = 5  #: texts with as many longest words in common are copies of one text

INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT = (1 << i for i in range(6))
SYMBOLS = 64
WORDS = {
    THREAT: "kill murder hurt destroy beat shoot stab burn hang strangle",
    TARGET: "you your yours u he she him her they them his their it this that these those tu vous il elle ils du ihr sie er ustedes ellos ella",
    NEGATION: "not no never nobody none neither nor without isn't aren't wasn't don't doesn't didn't nicht kein keine nie pas jamais nunca ni",
    REPORT: "said says say wrote writes quoted quotes quote reported claimed claims called told sagte dit dijo",
    INTENT: "will would shall should must gonna going i'll we'll i'd werde wird vais va voy vamos",
}
CLASSES = {w: sum(c for c, other in WORDS.items() if w in other.split()) for own in WORDS.values() for w in own.split()}
_CLAUSE = re.compile(r"[.!?;\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CACHED = 200_000


@dataclass(frozen=True)
class Machine:
    """A transducer over symbols: by state and symbol the next state, and factors for an insult's and a threat's weight."""

    to: np.ndarray
    insult: np.ndarray
    threat: np.ndarray

    def compose(self, other: Machine) -> Machine:
        """Both machines at once; the factors multiply."""
        n, m = len(self.to), len(other.to)
        pair = lambda a, b: (a[:, None] * b[None]).reshape(n * m, SYMBOLS)
        return Machine((self.to[:, None] * m + other.to[None]).reshape(n * m, SYMBOLS), pair(self.insult, other.insult), pair(self.threat, other.threat))


def _window(mark: int, width: int, inside: tuple[float, float], outside: tuple[float, float]) -> Machine:
    """Factors (insult, threat) in the ``width`` words after a symbol of class ``mark``, and out of them."""
    symbols, states = np.arange(SYMBOLS)[None], np.arange(width + 1)[:, None]
    to = np.where(symbols & mark, width, np.maximum(states - 1, 0))
    own = [np.where(states > 0, a, b) * np.ones((1, SYMBOLS)) for a, b in zip(inside, outside, strict=True)]
    return Machine(to, *own)


def insults() -> Machine:
    """Lets insults through; one of a run of insults weighs more than alone. Nothing else has an insult's weight."""
    has = (np.arange(SYMBOLS) & INSULT) != 0
    to = np.stack([has, has]).astype(int)
    return Machine(to, np.stack([has * 1.0, has * 1.1]), np.ones((2, SYMBOLS)))


def threats() -> Machine:
    """Lets threats through, in full within the words after one of intent. Nothing else has a threat's weight."""
    has = (np.arange(SYMBOLS) & THREAT) != 0
    near = _window(INTENT, 4, (1.0, 1.0), (1.0, 0.7))
    return Machine(near.to, near.insult, near.threat * has)


def targets() -> Machine:
    return _window(TARGET, 5, (1.25, 1.0), (1.0, 0.25))


def negations() -> Machine:
    return _window(NEGATION, 3, (0.4, 0.2), (1.0, 1.0))


def reports() -> Machine:
    """What follows a word of reporting, to the end of the clause, is someone else's."""
    said = (np.arange(SYMBOLS) & REPORT) != 0
    to = np.stack([said, np.ones(SYMBOLS)]).astype(int)
    factor = np.stack([np.ones(SYMBOLS), np.full(SYMBOLS, 0.6)])
    return Machine(to, factor, factor)


PARTS = (insults, threats, targets, negations, reports)


@lru_cache(maxsize=1)
def grammar() -> tuple[list[list[int]], list[list[float]], list[list[float]]]:
    """The five transducers, composed."""
    m = reduce(Machine.compose, (part() for part in PARTS))
    return m.to.tolist(), m.insult.tolist(), m.threat.tolist()


@dataclass
class Model:
    """Lexicon and scale. ``insults``: words, or beginnings with a closing ``*``, to weights."""

    insults: dict[str, float] = field(default_factory=dict)
    threat: float = 0.0
    slope: float = 1.0
    offset: float = -20.0

    def look_up(self, word: str) -> tuple[int, float, float]:
        """Symbol, and weights as an insult and as a threat."""
        best = self.insults.get(word, 0.0)
        for n in PREFIXES:
            if len(word) >= n:
                best = max(best, self.insults.get(word[:n] + "*", 0.0))
        symbol = CLASSES.get(word, 0) | (INSULT if best else 0)
        return symbol, best, self.threat if symbol & THREAT else 0.0

    def clauses(self, text: str | None, cache: dict[str, tuple[int, float, float]]) -> list[tuple[str, float]]:
        """Matched clauses with their weights."""
        if not text:
            return []
        if len(cache) > _CACHED:
            cache.clear()
        low = text.lower()
        words = _WORD.findall(low)
        for word in set(words).difference(cache):
            cache[word] = self.look_up(word)
        if not any(cache[w][0] & (INSULT | THREAT) for w in set(words)):
            return []
        to, insult, threat = grammar()
        out = []
        for clause in _CLAUSE.split(low):
            read = [cache[w] if w in cache else self.look_up(w) for w in _WORD.findall(clause)]
            state, total = 0, 0.0
            for symbol, a, b in read:
                if symbol & (INSULT | THREAT):
                    total += a * insult[state][symbol] + b * threat[state][symbol]
                state = to[state][symbol]
            if total:
                out.append((clause.strip(), total))
        return out

    def evidence(self, text: str | None, cache: dict[str, tuple[int, float, float]]) -> float:
        """All matched clauses together: the root of their squares' sum, so strong ones count most and each adds something."""
        return math.sqrt(math.fsum(w * w for _, w in self.clauses(text, cache)))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.slope * evidence + self.offset))))


def _by_chance(pos: int, n: int, rate: float) -> float:
    """Probability of ``pos`` or more toxic among ``n`` texts."""
    total = 0.0
    for k in range(pos, n + 1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate))
        total += term
        if k > n * rate and term < 1e-18 * total:  # from here on they only fall
            break
    return total


def lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Weights of patterns by ``(pattern, toxic texts, other texts)``.

    The weight is the log odds ratio; a beginning that others share loses to
    the words themselves, and one as pure as its words stands for all of them.
    """
    if not toxic or not clean:
        return {}
    rate, out = toxic / (toxic + clean), {}
    for pattern, pos, neg in counts:
        odds = math.log((pos + 0.5) / (toxic + 1)) - math.log((neg + 0.5) / (clean + 1))
        if odds >= ODDS and pos >= 3 and pos >= PURITY * (pos + neg) and _by_chance(pos, pos + neg, rate) < CHANCE:
            out[pattern] = odds
    return out


def _scale(rows: list[tuple[float, int]]) -> tuple[float, float]:
    """Logistic slope and offset by Newton's method, with a weak prior."""
    a, b = 1.0, -3.0
    for _ in range(50):
        ga, gb, haa, hab, hbb = -0.01 * a, 0.0, 0.01, 0.0, 1e-6
        for x, y in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            ga, gb, v = ga + (y - p) * x, gb + (y - p), p * (1 - p) + 1e-9
            haa, hab, hbb = haa + v * x * x, hab + v * x, hbb + v
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        da, db = max(-1.0, min(1.0, da)), max(-2.0, min(2.0, db))
        a, b = max(0.0, a + da), b + db
        if abs(da) + abs(db) < 1e-6:
            break
    return a, b


def _words(batches: Batches) -> Batches:
    """Label, hash of the longest words, and distinct words of each text (doc_id, toxic, text)."""
    for b in batches:
        found = [sorted(set(_WORD.findall(t.lower()))) for t in b.column(2).to_pylist()]
        like = [xxhash.xxh64_intdigest(" ".join(sorted(w, key=lambda x: (-len(x), x))[:ALIKE])) >> 1 for w in found]
        yield pa.RecordBatch.from_arrays(
            [b.column(1).cast(pa.int32()), pa.array(like, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["toxic", "like", "words"]
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of ``docs`` by ``labels`` (doc_id, toxic), from at most ``sample`` doc_ids outside the held-out fold.

    Texts with the same ALIKE longest words count once, in a pattern's numbers
    and in those of its class, so that copies of one text don't make its words
    look toxic. Repeated labels of a doc_id are one, toxic if any is; of repeated
    documents every text counts for the patterns, and their mean evidence for
    the scale. Labels of one kind, or none, teach nothing.
    """
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out("doc_id", 5, 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    rows = materialize(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"), "labelled")
    read = rows.mapInArrow(slim(_words), "toxic int, like long, words array<string>")
    read = materialize(read.groupBy("toxic", "like").agg(F.flatten(F.collect_set("words")).alias("words")), "words")
    size = {r["toxic"]: r["count"] for r in read.groupBy("toxic").count().collect()}
    starts = [F.when(F.length("word") >= n, F.concat(F.left("word", F.lit(n)), F.lit("*"))) for n in PREFIXES]
    counts = (
        read.select("toxic", "like", F.explode(F.array_distinct("words")).alias("word"))
        .select("toxic", "like", F.explode(F.array_compact(F.array("word", *starts))).alias("pattern"))
        .distinct()
        .groupBy("pattern")
        .agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    )
    # what is left is bounded by the sample, and few: a pattern must be in texts that chance doesn't make all toxic
    seen = counts.where(f"pos >= 3 and pos >= {PURITY} * (pos + neg)").collect()
    model = Model(lexicon(sorted(tuple(r) for r in seen), size.get(1, 0), size.get(0, 0)))
    if not model.insults:
        return model
    strong = sorted(model.insults.values())
    model.threat = strong[len(strong) // 2] / 2
    found = _evidence(rows, model, ["doc_id", "toxic"]).groupBy("doc_id", "toxic").agg(F.avg("evidence").alias("evidence")).orderBy("doc_id").collect()
    model.slope, model.offset = _scale([(r["evidence"], r["toxic"]) for r in found])
    return model


def _evidence(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    given = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*keep).schema.add("evidence", "double").add("score", "double")
    names = out.fieldNames()

    def run(batches: Batches) -> Batches:
        cache: dict[str, tuple[int, float, float]] = {}
        model = given.value
        for b in batches:
            found = [model.evidence(t, cache) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, pa.float64()), pa.array([model.score(x) for x in found], pa.float64())], names)

    return docs.select(*keep, F.col("text").cast("string")).mapInArrow(slim(run), out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every row.

    A null or empty text has no clause and gets the score of no evidence.
    Without labels of both kinds nothing is learned and all scores are near 0.
    Repeated rows repeat; an empty table gives no rows; other columns are not
    read.
    """
    rows = _evidence(docs.select("doc_id", "text", held_out("doc_id", 5, 0).alias("held_out")), model, ["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def query(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import bound_batches, table

    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("evidence")
