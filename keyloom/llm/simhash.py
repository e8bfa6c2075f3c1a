"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two halves. Of two fingerprints that
differ in at most three bits, one half differs in at most one bit, so the pair
meets either under an equal half or under a half with one bit left out. Each
distinct fingerprint is indexed under its 2 halves and its 64 one-wildcard
halves, the index is joined by equality, and candidates are verified.

Copies are collapsed to distinct fingerprints first. A bucket emits only the
links of its own forest, never its pairs; a bucket too large to compare
directly is cut again by halves of its free bits, which finds the same links,
and one too large for a task is cut by its free bits before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from keyloom.llm import buckets
from keyloom.llm.common import binary_column, mapped, materialize, release, slim, text_hash, without
from keyloom.llm.buckets import groups
from keyloom.llm.graph import EDGES, Forest, components

HALF = 32
VARIANTS = 2 + 2 * HALF  #: keys of a fingerprint: its halves, and each with one bit left out
LIMIT = 3  #: bits in which linked fingerprints differ at most
DIRECT = 2048  #: buckets up to this size are compared directly
CROWDED = 65_536  #: fingerprints of a bucket from which it is cut by its free bits before the shuffle
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a whole text; 0 where it has no word."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    hash64 = xxhash.xxh64_intdigest
    if n <= shingle:
        return hash64(b" ".join(words), seed)
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, n) + 1
    end = np.cumsum(size) - 1
    start = end + 1 - size
    m = n - shingle + 1
    starts, ends = start[:m].tolist(), end[shingle - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, m, _CHUNK):
        h = np.array([hash64(line[s:e], seed) for s, e in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > m).tobytes(), "big")


def majority(hashes: np.ndarray) -> int:
    """Unsigned 64-bit fingerprint of a set of 64-bit hashes; 0 of the empty set."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """A table of ``doc_id, *keep, fp`` of every row; fp: the fingerprint's bits as a signed long."""
    names, out = ["doc_id", *keep, "fp"], docs.select("doc_id", *keep).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(b.num_columns - 1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names)

    return mapped(docs.select("doc_id", *keep, F.col("text").cast("string")), run, out, "fps")


def _pairs(x: np.ndarray, y: np.ndarray, limit: int, links: Forest) -> None:
    """Link all of x with all of y at ``limit`` or fewer bits, in blocks."""
    for i in range(0, len(x), 512):
        part = x[i : i + 512, None]
        for j in range(0, len(y), 4096):
            near = np.argwhere(np.bitwise_count(part ^ y[None, j : j + 4096]) <= limit)
            for a, b in near.tolist():
                links.union(int(x[i + a]), int(y[j + b]))


def _link(fps: np.ndarray, free: list[int], limit: int, links: Forest) -> None:
    """Link every pair of distinct ``fps`` at ``limit`` or fewer bits; they differ in ``free`` bits only."""
    if len(fps) < 2:
        return
    if len(fps) <= DIRECT or len(free) < 8:
        return _pairs(fps, fps, limit, links)
    for half in (free[: len(free) // 2], free[len(free) // 2 :]):
        rest = [b for b in free if b not in half]
        mask = np.uint64(sum(1 << b for b in half))
        for group in _groups(fps, fps & mask):
            _link(group, rest, limit, links)
        if limit < 2:  # then one half is equal
            continue
        for bit in half:
            one = np.uint64(1 << bit)
            for group in _groups(fps, fps & (mask ^ one)):
                on = group[(group & one) != 0]
                off = group[(group & one) == 0]
                _cross(on, off, rest, limit - 1, limit, links)


def _cross(on: np.ndarray, off: np.ndarray, free: list[int], limit: int, total: int, links: Forest) -> None:
    """Link ``on`` with ``off`` at ``total`` or fewer bits, of which ``limit`` may be ``free`` ones; they differ in the others."""
    if not len(on) or not len(off):
        return
    if min(len(on), len(off)) * max(len(on), len(off)) <= DIRECT * DIRECT or len(free) < 8:
        return _pairs(on, off, total, links)
    for half in (free[: len(free) // 2], free[len(free) // 2 :]):
        rest = [b for b in free if b not in half]
        mask = np.uint64(sum(1 << b for b in half))
        for bit in [None, *(half if limit > 1 else [])]:  # with limit 1, one half is equal
            keys = mask if bit is None else mask ^ np.uint64(1 << bit)
            ka, kb = on & keys, off & keys
            order_a, order_b = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
            sa, sb = ka[order_a], kb[order_b]
            for key in np.intersect1d(sa, sb):
                left = on[order_a[np.searchsorted(sa, key) : np.searchsorted(sa, key, "right")]]
                right = off[order_b[np.searchsorted(sb, key) : np.searchsorted(sb, key, "right")]]
                if bit is None:
                    _cross(left, right, rest, limit, total, links)
                    continue
                # where both sides agree in the bit, they have met without the wildcard
                flag = np.uint64(1 << bit)
                for x, y in ((left[(left & flag) != 0], right[(right & flag) == 0]), (left[(left & flag) == 0], right[(right & flag) != 0])):
                    _cross(x, y, rest, limit - 1, total, links)


def _groups(fps: np.ndarray, key: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, fps = key[order], fps[order]
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    for group in np.split(fps, cut):
        if len(group) > 1:
            yield group


def _bucket(code: int, fps: np.ndarray, links: Forest) -> None:
    """All links that this bucket alone is responsible for."""
    low, high = list(range(HALF)), list(range(HALF, 64))
    if code < 2:
        _link(fps, low if code == 0 else high, 3, links)
        return
    bit = (HALF + code - 2) if code < 2 + HALF else (code - 2 - HALF)
    one = np.uint64(1 << bit)
    _cross(fps[(fps & one) != 0], fps[(fps & one) == 0], low if code < 2 + HALF else high, 2, 3, links)


class _Links(Forest):
    """A forest of unsigned fingerprints."""

    def batches(self, size: int = 65536) -> Iterator[pa.RecordBatch]:
        members = list(self.up)
        for i in range(0, len(members), size):
            part = members[i : i + size]
            ends = [np.array(x, np.uint64).view(np.int64) for x in (part, [self.find(x) for x in part])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])


def link_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task's buckets. Rows: (key, part, fp), sorted by key and part, distinct."""
    links = _Links()
    for (keys, _, fps), first, last, _ in groups(batches, 2, 1 << 62):
        many = np.flatnonzero(last - first > 1)
        for i in many.tolist():
            _bucket(int(keys[first[i]]) >> HALF, fps[first[i] : last[i]].view(np.uint64), links)
    yield from links.batches()


def index(distinct: DataFrame) -> DataFrame:
    """``(key, fp)``: every fingerprint under its halves and one-wildcard halves.

    The key holds the variant's number above 32 bits: 0 and 1 the upper and
    lower half, then 32 variants of the upper and 32 of the lower half.
    """
    v = F.explode(F.sequence(F.lit(0), F.lit(1 + 2 * HALF))).alias("v")
    rows = distinct.select("fp", v)
    upper, lower = F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    half = F.when((F.col("v") == 0) | F.col("v").between(2, 1 + HALF), upper).otherwise(lower)
    gone = F.when(F.col("v") < 2, F.lit(0).cast("long")).otherwise(F.expr(f"shiftleft(1L, (v - 2) % {HALF})"))
    key = F.expr(f"shiftleft(cast(v as bigint), {HALF})").bitwiseOR(half.bitwiseAND(F.bitwise_not(gone)))
    return rows.select(key.alias("key"), "fp")


def variants(fps: np.ndarray) -> np.ndarray:
    """The 32-bit keys of unsigned fingerprints, a row each, in the order of :func:`index`."""
    halves = (fps >> np.uint64(HALF)).astype(np.uint32)[:, None], fps.astype(np.uint32)[:, None]
    but_one = ~(np.uint32(1) << np.arange(HALF, dtype=np.uint32))
    return np.concatenate((*halves, *(x & but_one for x in halves)), axis=1)


def candidates(rows: DataFrame, tag: str = "simhash", block: int = buckets.BLOCK, often: int = buckets.OFTEN, most: int = buckets.PART) -> DataFrame:
    """Distinct ``part, id``: rows (id, fp) whose fingerprints differ in LIMIT or fewer bits share a part, to be verified.

    The index of deletion variants, dealt out by :mod:`keyloom.llm.buckets`;
    what a chain of such links connects within a bucket is one part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fps = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
                yield pa.RecordBatch.from_arrays([*b.columns, binary_column(variants(fps))], ["id", "sketch", "bands"])

    signed = rows.toDF("id", "fp").mapInArrow(slim(run), "id long, sketch long, bands binary")
    return buckets.candidates(signed, VARIANTS, tag, block, often, most, LIMIT)


def cut_by_free_bits(rows: DataFrame) -> DataFrame:
    """``(key, part, fp)``: the rows of crowded buckets, a row for each eighth of the other half's 32 bits.

    Fingerprints of one bucket differ in that half in three bits at most, so
    they agree in one of its four eighths of the fingerprint: no link is lost,
    and a bucket of any size becomes buckets of a 256th of it or so.
    """
    v = F.shiftright("key", HALF)
    upper = (v == 0) | v.between(2, 1 + HALF)
    free = F.when(upper, F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))).otherwise(F.shiftrightunsigned("fp", HALF))
    cut = rows.withColumn("_free", free).withColumn("_s", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    value = F.expr("shiftright(_free, 8 * _s) & 255L")
    return cut.select("key", (F.col("_s") * 256 + value + 1).cast("int").alias("part"), "fp")


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Edges that connect distinct fingerprints exactly as all links at 3 or fewer bits do.

    Buckets are counted first; those of more than ``crowded`` fingerprints are
    cut by their free bits, so no bucket meets in one task whole.
    """
    rows = index(distinct)
    hot = materialize(rows.groupBy("key").count().where(F.col("count") > crowded).select("key"), "crowded")
    if hot.isEmpty():
        release(hot)
        dealt = rows.select("key", F.lit(0).alias("part"), "fp")
    else:
        calm = rows.join(hot, "key", "left_anti").select("key", F.lit(0).alias("part"), "fp")
        dealt = calm.union(cut_by_free_bits(rows.join(hot, "key", "left_semi")))
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "fp").select("key", "part", "fp").mapInArrow(slim(link_buckets), EDGES)


def near_duplicates(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, *keep, fp, component_id`` of every row.

    component_id: the smallest doc_id reachable over fingerprints that differ
    in at most three bits, the row's own included. Null and wordless texts have
    fingerprint 0 and link like any other; repeated rows stay repeated; rows
    without doc_id get the component of their fingerprint (null if no member
    has a doc_id). An empty table gives no rows. Other columns are not read.
    """
    fps = fingerprints(docs, shingle, keep)
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(distinct), "simhash")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = materialize(rooted.join(least, "root").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select("doc_id", *keep, "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id.

    Rows whose group has no doc_id at all keep one row per distinct text.
    Repeats of the same doc_id and text count as one document. Other columns
    stay, whatever their names.
    """
    found = materialize(near_duplicates(docs.select("doc_id", "text", text_hash().alias("th")), shingle, keep=("th",)), "found")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    met = found.select(F.col("doc_id").alias("doc"), "th")
    return without(docs, gone.select(F.col("doc_id").alias("doc"), "th"), met)


def query(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import bound_batches, table

    bound_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
