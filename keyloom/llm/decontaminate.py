"""Benchmark decontamination by template canonicalisation.

Words are lower-cased; numbers, units after a number, and names (capitalised,
and no common word where a sentence begins) become typed placeholders, a run of
one type a single one, so a question asked again with other values has the same
template. Windows of template words are hash-joined with those of the
benchmark; a document is contaminated by an item when windows that stand in it
in the item's order hold enough of the item's words, and the placeholders are
filled consistently: equal slots of the item by equal words.

Both sides of the join are tables. Of a document's windows only those are
shuffled whose hash a bit set of the benchmark's may hold; they carry the words
of their slots, so no text is read again.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from keyloom.llm import buckets
from keyloom.llm.common import Batches, free, mapped, materialize, slim, text_hash, without

WINDOW = 8  #: template words of a window; a shorter item is one window
LEAST = 0.6  #: share of an item's template words that must stand in matched windows
CONSISTENT = 0.7  #: share of an item's slots in matched windows that must be filled consistently
DRIFT = 4  #: words by which the distance of places may change from one hit of a chain to the next
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw j kj cal kcal v a ohm k c f celsius fahrenheit degree degrees percent % $ € £ usd eur dollar dollars euro euros cent cents mph kmh".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
#: Words that are no name where a sentence begins.
COMMON = frozenset(
    "a about after all also although an and another any are as at because before both but by can could did do does each either every few find first for from give given had has have he her here his how however i if in into is it its let many may more most much must my no not now of on once one only or other our over she should show since so some such suppose than that the their them then there these they this those though through to under until up was we were what when where whether which while who whom whose why will with without would write yes you your "
    "aber alle als am auch auf aus bei bis da damit dann das dass dem den denn der des die dies diese dieser dieses doch du ein eine einem einen einer er es für hat ihr im ist man mit nach nicht noch nur ob oder ohne sie sind so und von vor wann war warum was wenn wer wie wir wird wo zu zum zur "
    "au aux avec ce ces cette comme dans de depuis des donc du elle elles en est et il ils je la le les leur lors mais ne nos notre nous on ont ou où par pas pour quand que quel quelle qui sans selon ses si son sont sous sur un une vous "
    "al como con cuando cuál de del desde donde dónde el ella en entre era es esta este esto hay la las lo los más no nos o para pero por porque qué que se según ser si sin sobre su sus también un una y ya".split()
)
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%$€£]|[.!?\n]+")
_CACHED = 200_000  #: tokens of which a task remembers what they are
#: What a token is, whatever stands around it; in the lowest bits of its code.
BREAK, ENDS, IS_NUMBER, IS_SIGN, UNIT_WORD, CAPITAL, IS_COMMON = (1 << i for i in range(7))
_FLAGS = np.uint64(0xFF)
_KINDS = ("", NUMBER, UNIT, NAME)
_KIND_CODES = np.array([0, *(xxhash.xxh64_intdigest(k) & ~0xFF for k in _KINDS[1:])], np.uint64)


class _Tokens(dict):
    """Token -> hash of its lower-case form, and its flags in place of the lowest 8 bits."""

    def __missing__(self, token: str) -> int:
        if len(self) > _CACHED:
            self.clear()
        c, low = token[0], token.lower()
        if c in ".!?\n":
            flags = BREAK | (ENDS if token.strip("\n") else 0)
        else:
            flags = IS_NUMBER if c.isdigit() or low in NUMBERS else 0
            flags |= IS_SIGN if c in "%$€£" else 0
            flags |= UNIT_WORD if low in UNITS else 0
            flags |= CAPITAL if c.isupper() and token[1:].islower() else 0
            flags |= IS_COMMON if low in COMMON else 0
        self[token] = found = xxhash.xxh64_intdigest(low) & ~0xFF | flags
        return found


@dataclass
class Template:
    """A text as template words: their codes, and what stands there."""

    codes: np.ndarray
    kind: np.ndarray  #: 0 for a literal word, else a place in _KINDS
    tokens: list[str]
    first: np.ndarray  #: tokens at which the template words begin
    last: np.ndarray  #: and end

    @cached_property
    def words(self) -> list[str]:
        """The text of every template word, lower-cased; those of a run are joined."""
        return [self.word(i) for i in range(len(self.codes))]

    @cached_property
    def kinds(self) -> list[str]:
        return [_KINDS[k] or w for k, w in zip(self.kind.tolist(), self.words, strict=True)]

    def word(self, i: int) -> str:
        part = self.tokens[self.first[i] : self.last[i] + 1]
        return " ".join(t.lower() for t in part if t[0] not in ".!?\n")

    def slots(self, i: int, size: int) -> list[str]:
        """Words of a window's placeholders, and nothing for its literal words."""
        return [self.word(j) if self.kind[j] else "" for j in range(i, i + size)]


def template(text: str | None, cache: _Tokens | None = None, plain: bool = False) -> Template:
    """The template of a whole text. A word in capitals throughout is no name; with ``plain``, neither is one that begins a sentence."""
    tokens = _TOKEN.findall(text or "")
    known = _Tokens() if cache is None else cache
    value = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    flags = (value & _FLAGS).astype(np.uint8)
    at = np.flatnonzero((flags & BREAK) == 0)
    own = flags[at]
    if not len(at):
        return Template(np.empty(0, np.uint64), np.empty(0, np.uint8), tokens, at, at)
    before = np.where(at > 0, flags[at - 1], BREAK)
    begins = (before & BREAK) != 0
    number = (own & IS_NUMBER) != 0
    unit = ~number & (((own & IS_SIGN) != 0) | (~begins & ((before & IS_NUMBER) != 0) & ((own & UNIT_WORD) != 0)))
    name = ~number & ~unit & ((own & CAPITAL) != 0) & ~(begins & (True if plain else (own & IS_COMMON) != 0))
    kind = (number + 2 * unit + 3 * name).astype(np.uint8)
    ended = np.cumsum((flags & ENDS) != 0)[at]
    alone = np.ones(len(at), bool)  # not one with the word before
    alone[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | (ended[1:] != ended[:-1])
    keep = np.flatnonzero(alone)
    codes = np.where(kind == 0, value[at] & ~_FLAGS, _KIND_CODES[kind])
    return Template(codes[keep], kind[keep], tokens, at[keep], at[np.append(keep[1:] - 1, len(at) - 1)])


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` template words, as signed longs."""
    n = len(codes) - size + 1
    if n <= 0 or not size:
        return np.empty(0, np.int64)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = (h ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


@dataclass
class Item:
    """A benchmark item: its window hashes by place, window length and slots; and the same of its plain template, where that differs."""

    item_id: int
    kinds: list[str]
    words: list[str]
    hashes: np.ndarray
    size: int
    plain: Item | None = None


def item_of(item_id: int, text: str | None, window: int = WINDOW) -> Item | None:
    found: list[Item] = []
    for plain in (False, True):
        t = template(text, plain=plain)
        size = min(window, len(t.kinds))
        if size and any(k[0] != "<" for k in t.kinds) and not (found and found[0].kinds == t.kinds):
            found.append(Item(item_id, t.kinds, t.words, windows(t.codes, size), size))
    if len(found) == 2:
        found[0].plain = found[1]
    return found[0] if found else None


def chains(hits: list[tuple[int, int]], least: float) -> Iterator[list[tuple[int, int]]]:
    """Chains of ``least`` or more hits, without a hit in common: both places ascend, and their distance drifts by DRIFT at most from hit to hit."""
    left = np.array(sorted(set(hits), key=lambda x: (x[1], x[0])), np.int64).reshape(-1, 2)
    while len(set(left[:, 0].tolist())) >= least:
        p, q = left[:, 0], left[:, 1]
        low = np.searchsorted(q, q - (p - p.min() + DRIFT))  # further back no distance is near enough
        length, back = np.ones(len(left), np.int64), np.full(len(left), -1)
        for j in range(1, len(left)):
            i = int(low[j])
            drift = np.abs((q[j] - p[j]) - (q[i:j] - p[i:j]))
            worth = np.where((p[i:j] < p[j]) & (q[i:j] < q[j]) & (drift <= DRIFT), length[i:j] * (DRIFT + 1) - drift, 0)
            if len(worth) and (k := len(worth) - 1 - int(worth[::-1].argmax())) >= 0 and worth[k] > 0:
                back[j], length[j] = i + k, length[i + k] + 1
        free = np.ones(len(left), bool)
        for j in np.argsort(-length, kind="stable").tolist():
            if length[j] < least:
                break
            links = []
            while j >= 0 and free[j]:
                links.append(j)
                j = int(back[j])
            if j < 0:
                free[links] = False
                yield [(int(p[i]), int(q[i])) for i in reversed(links)]
        if free.all():
            return
        left = left[free]


def judge(item: Item, hits: dict[tuple[int, int], list[str]], least: float = LEAST) -> tuple[float, float] | None:
    """Coverage and slot consistency of an item, or None; ``hits``: (place in item, place in document) -> words of the window's slots.

    Coverage is the share of the item's template words that lie in matched
    windows. Hits of one chain are judged together; those at one distance are a
    chain of their own too.
    """
    total = len(item.kinds)

    def share(places: list[int]) -> float:
        return len({p + i for p in set(places) for i in range(item.size)}) / total

    if share([p for p, _ in hits]) < least:
        return None
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, q in sorted(hits):
        runs[q - p].append((p, q))
    # a window covers its size at most, which bounds the hits of a chain from below
    need = max(1, -(-(least * total) // item.size))
    best = None
    for found in chain(runs.values(), chains(list(hits), need) if len(runs) > 1 else ()):
        if best and best[0] == 1:
            break
        covered = share([p for p, _ in found])
        if covered < least or (best and covered <= best[0]):
            continue
        own: dict[int, str] = {}
        for p, q in found:
            for i, word in enumerate(hits[p, q]):
                if item.kinds[p + i][0] == "<":
                    own.setdefault(p + i, word)
        there: dict[str, set[str]] = defaultdict(set)
        back: dict[str, set[str]] = defaultdict(set)
        for i, word in own.items():
            there[item.kinds[i] + item.words[i]].add(word)
            back[item.kinds[i] + word].add(item.words[i])
        good = sum(len(there[item.kinds[i] + item.words[i]]) == 1 and len(back[item.kinds[i] + w]) == 1 for i, w in own.items())
        fit = good / len(own) if own else 1.0
        if fit >= CONSISTENT:
            best = (covered, fit)
    return best


def places(t: Template, size: int, at: np.ndarray) -> Iterator[tuple[int, list[str]]]:
    """(place, words of the slots) of windows; of equal windows that are shorter than WINDOW, which are whole items, one for each filling."""
    seen: set[tuple[int, ...]] = set()
    h = windows(t.codes, size) if size < WINDOW else None
    for q in at.tolist():
        slots = t.slots(q, size)
        if h is not None:
            like = (int(h[q]), *map(hash, slots))
            if like in seen:
                continue
            seen.add(like)
        yield q, slots


class Index:
    """Items held against single texts; tables are joined by :func:`contamination`, which finds the same."""

    def __init__(self, items: list[Item]) -> None:
        self.items = [x for item in items for x in (item, item.plain) if x]

    def match(self, t: Template) -> list[tuple[int, float, float]]:
        """(item, coverage, consistency) of the items that the text holds."""
        out: dict[int, tuple[float, float]] = {}
        for item in self.items:
            h = windows(t.codes, item.size)
            hits = {(p, q): slots for p, own in enumerate(item.hashes.tolist()) for q, slots in places(t, item.size, np.flatnonzero(h == own))}
            if hits and (verdict := judge(item, hits)):
                out[item.item_id] = max(verdict, out.get(item.item_id, verdict))
        return sorted((item_id, *verdict) for item_id, verdict in out.items())


def _item_windows(batches: Batches) -> Batches:
    """Rows (item, text) as (h, item, plain, place, size, words): every window of both templates; words: how many the template has."""
    names = ["h", "item", "plain", "place", "size", "words"]
    for b in batches:
        for item, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x = item_of(0, text)
            for plain, y in enumerate((x, x and x.plain)):
                if y:
                    n = len(y.hashes)
                    columns = [pa.array(y.hashes), pa.array(np.full(n, item)), pa.array(np.full(n, plain, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, y.size, np.int32)), pa.array(np.full(n, len(y.kinds), np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names)


def contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, *keep, item_id, coverage, consistency``: a row for each document and benchmark item that it holds.

    Null and empty texts, and items without a literal word, match nothing; an
    item_id with several texts is held by a document that holds one of them;
    an item repeated in the benchmark counts once by its id; repeated documents
    (equal in doc_id, text and ``keep``) give their matches once; an empty
    benchmark gives no rows. Other columns are not read.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text")).distinct()
    items = materialize(items.withColumn("item", F.xxhash64("item_id", "item_text")), "items")
    theirs = mapped(items.select("item", "item_text"), _item_windows, "h long, item long, plain int, place int, size int, words int", "windows")
    sizes = sorted(r[0] for r in theirs.select("size").distinct().collect())  # WINDOW values at most
    given = docs.sparkSession.sparkContext.broadcast((sizes, buckets.as_array(buckets.bloom(theirs, "h"))))
    # columns by place: a caller's names may be anything
    texts = docs.select("doc_id", *keep, F.col("text").cast("string"))
    own = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(texts.schema[:-1])])
    columns = own.fieldNames()
    out = T.StructType([*own]).add("th", "long").add("h", "long").add("size", "integer").add("q", "integer").add("slots", T.ArrayType(T.StringType()))

    def found(batches: Batches) -> Batches:
        (sizes, bits), cache = given.value, _Tokens()
        for b in batches:
            at, rows = [], []
            for row, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                t = template(text, cache)
                th = None
                for size in sizes:
                    h = windows(t.codes, size)
                    for q, slots in places(t, size, np.flatnonzero(buckets.holds(bits, h))):
                        th = th or int(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))
                        at.append(row)
                        rows.append((th, int(h[q]), size, q, slots))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())]
                values = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]), *values], out.fieldNames())

    ours = mapped(texts, found, out, "hits").distinct()
    met = ours.join(theirs, ["h", "size"])
    by = [*columns, "th", "item", "plain"]  # th tells texts apart that share a doc_id
    covering = F.size(F.collect_set("place")) * F.first("size") >= LEAST * F.first("words")
    grouped = met.groupBy(*by).agg(F.collect_list(F.struct(F.col("place").alias("p"), "q", "slots")).alias("hits"), covering.alias("enough")).where("enough")
    ready = grouped.join(items, "item").select(*columns, "th", "item_id", "item_text", "plain", "hits")
    columns.append("th")
    done = T.StructType([*own]).add("th", "long").add("item_id", "long").add("coverage", "double").add("consistency", "double")

    def judged(batches: Batches) -> Batches:
        for b in batches:
            at, rows = [], []
            for row, (item_id, text, plain, hits) in enumerate(zip(*(c.to_pylist() for c in b.columns[len(columns) :]), strict=True)):
                item = item_of(item_id, text)
                if verdict := judge(item.plain if plain else item, {(x["p"], x["q"]): x["slots"] for x in hits}):
                    at.append(row)
                    rows.append((item_id, *verdict))
            if rows:
                values = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[: len(columns)]), *values], done.fieldNames())

    best = ready.mapInArrow(slim(judged), done).groupBy(*columns, "item_id").agg(F.max(F.struct("coverage", "consistency")).alias("best"))
    names = ["doc_id", *keep, "item_id", "coverage", "consistency"]
    return best.select(*columns[:-1], "item_id", "best.coverage", "best.consistency").toDF(*names)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. Repeated rows and other columns stay, whatever their names."""
    th = free(docs.columns, "_th")[0]
    bad = contamination(docs.select("doc_id", "text", text_hash().alias(th)), benchmark, (th,))
    gone = materialize(bad.select(F.col("doc_id").alias("doc"), F.col(th).alias("th")).distinct(), "contaminated")
    return without(docs, gone)


def query(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import bound_batches, table

    bound_batches(spark)
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
