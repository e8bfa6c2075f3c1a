"""Language identification: word-first backoff.

A known word scores by its log frequency in each language; a word not seen in
training falls back to its character n-grams, the longest known ones first.
Words are runs of letters, in training and in prediction alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from keyloom.llm.common import Batches, materialize, release, slim

SAMPLE = 40_000  #: training documents, at most: those of least hash of doc_id
WORDS = 50_000  #: words kept of each language, at most: its most frequent; others are scored by their n-grams
GRAMS = 50_000  #: n-grams kept of each language, at most
LONGEST = 5  #: characters of the longest n-gram
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 400_000  #: words of which a task remembers the scores
_CELLS = 4_000_000  #: numbers that these take at most, however many languages there are


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall(text.lower())
    if not found or "".join(found).isalpha():
        return found
    # numerals such as ½, ² and Ⅷ are no letters
    return ["".join(part) for w in found for letters, part in groupby(w, str.isalpha) if letters]


@dataclass
class Model:
    """Log frequencies of words and n-grams: places of the keys, and a row for each with a number for each of ``langs``."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray

    @staticmethod
    def of(words: list[tuple[str, str, int]], grams: list[tuple[str, str, int]]) -> Model:
        """From counts (language, key, n)."""
        langs = sorted({w[0] for w in words})
        at = {x: i for i, x in enumerate(langs)}

        def logs(rows: list[tuple[str, str, int]], group: Callable[[str], int]) -> tuple[dict[str, int], np.ndarray]:
            place = {k: i for i, k in enumerate(sorted({r[1] for r in rows}))}
            counts = np.zeros((len(place), len(langs)), np.float32)
            for lang, key, n in rows:
                counts[place[key], at[lang]] += n
            kinds = np.fromiter(map(group, place), np.int64, len(place))
            totals = np.zeros((kinds.max(initial=0) + 1, len(langs)))
            np.add.at(totals, kinds, counts)
            return place, np.log((counts + 0.5) / (totals[kinds] + 1.0)).astype(np.float32)

        return Model(langs, *logs(words, lambda k: 0), *logs([r for r in grams if r[0] in at], len))

    def vector(self, word: str) -> np.ndarray | None:
        """Log frequencies of a word; None where not even its letters are known."""
        if (known := self.words.get(word)) is not None:
            return self.word_logs[known]
        text = f"<{word}>"
        rows, i = [], 0
        while i < len(text):
            for n in range(min(LONGEST, len(text) - i), 0, -1):
                if (known := self.grams.get(text[i : i + n])) is not None:
                    rows.append(known)
                    break
            i += max(1, n - 1)  # n is 1 where not even the letter is known
        return self.gram_logs[rows].mean(axis=0) if rows else None


class Scores(dict):
    """Word -> a row of ``rows``: its log frequencies less their mean, or row 0, which is nothing, for an unknown word."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.most = model, max(1, min(_CACHED, _CELLS // max(1, len(model.langs))))
        self.rows, self.n = np.zeros((1024, len(model.langs)), np.float32), 1

    def __missing__(self, word: str) -> int:
        v = self.model.vector(word)
        if v is None:
            self[word] = 0
            return 0
        if self.n == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        self.rows[self.n] = v - v.mean()
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def predict(self, text: str | None) -> tuple[str, float]:
        langs = self.model.langs
        if not text or not langs:
            return UNKNOWN, 0.0
        counts = Counter(words_of(text))
        if not counts:
            return UNKNOWN, 0.0
        if len(self) > self.most:
            self.clear()
            self.n = 1
        at = np.fromiter(map(self.__getitem__, counts), np.int64, len(counts))
        root = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
        weight = float(root[at > 0].sum())
        if not weight:
            return langs[0], 0.0
        total = root @ self.rows[at].astype(np.float64)
        mean = total / math.sqrt(weight)
        p = np.exp(mean - mean.max())
        k = int(total.argmax())
        return langs[k], float(p[k] / p.sum())


def held_out(doc_id: str = "doc_id", fold: int = 4, remainder: int = 2) -> Column:
    """Whether crc32 of doc_id's text leaves ``remainder``; false without doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % fold == remainder, F.lit(False))


COUNTS = "lang string, key string, n long"


def _counted(keys_of: Callable[[list], Counter]) -> Callable[[Batches], Batches]:
    """A batch's columns as counts of (language, key)."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            found = keys_of([c.to_pylist() for c in b.columns])
            if found:
                langs, keys = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(keys), pa.array(found.values(), pa.int64())], ["lang", "key", "n"])

    return slim(run)


def count_words(columns: list[list]) -> Counter:
    """(language, word) of languages and texts."""
    out: Counter = Counter()
    for lang, text in zip(*columns, strict=True):
        for word, n in Counter(words_of(text)).items():
            out[lang, word] += n
    return out


def count_grams(columns: list[list]) -> Counter:
    """(language, n-gram) of languages, words and how often each is met."""
    out: Counter = Counter()
    for lang, word, times in zip(*columns, strict=True):
        text = f"<{word}>"
        for n in range(1, LONGEST + 1):
            for i in range(len(text) - n + 1):
                out[lang, text[i : i + n]] += times
    return out


def _most_frequent(counts: DataFrame, most: int) -> list[tuple[str, str, int]]:
    """Counts of the ``most`` or so most frequent keys of each language.

    The cut is found from how many keys share a count, so no task ranks a
    language's keys; of the keys that share the count at the cut, those of
    least hash fill what is left.
    """
    shared = counts.groupBy("lang", "n").agg(F.count("*").alias("keys")).collect()
    cuts, left = [], {}
    for lang, n, keys in sorted((tuple(r) for r in shared), key=lambda r: (r[0], -r[1])):
        room = left.get(lang, most)
        if room > 0 and keys > room:
            cuts.append((lang, n, room / keys))
        left[lang] = room - keys
    at = counts.sparkSession.createDataFrame(cuts, "cut_lang string, cut long, share double")
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(1 << 30)
    kept = F.col("cut").isNull() | (F.col("n") > F.col("cut")) | ((F.col("n") == F.col("cut")) & (part < F.col("share")))
    return [tuple(r) for r in counts.join(at, F.col("lang") == F.col("cut_lang"), "left").where(kept).select("lang", "key", "n").collect()]


def fit(docs: DataFrame, sample: int = SAMPLE, words: int = WORDS, grams: int = GRAMS) -> Model:
    """The model of ``docs`` (doc_id, text, lang), from at most ``sample`` doc_ids outside the held-out fold.

    Rows without doc_id, text or lang teach nothing; every text of a doc_id
    does. Counting is distributed; the driver gets ``words`` words and ``grams``
    n-grams of each language, so a language that few rows have is not lost.
    """
    rows = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    taught = rows.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.col("lang").cast("string"), "text")
    total = F.sum("n").alias("n")
    met = materialize(taught.mapInArrow(_counted(count_words), COUNTS).groupBy("lang", "key").agg(total), "words")
    parts = materialize(met.mapInArrow(_counted(count_grams), COUNTS).groupBy("lang", "key").agg(total), "grams")
    model = Model.of(_most_frequent(met, words), _most_frequent(parts, grams))
    release(met, parts)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row's whole text.

    ``und`` with score 0 where the text is null or has no letter, or nothing
    was learned. Repeated rows repeat; an empty table gives no rows; other
    columns are not read.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", held_out().alias("held_out")).schema.add("lang_pred", "string").add("score", "double")
    names = out.fieldNames()

    def run(batches: Batches) -> Batches:
        scores = Scores(given.value)
        for b in batches:
            found = [scores.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names
            )

    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(slim(run), out)


def query(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import bound_batches, table

    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
