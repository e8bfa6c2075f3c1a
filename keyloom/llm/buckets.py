"""Candidates of a similarity join by band keys, without a bucket in one task and without pairs.

Rows are (id, sketch, bands): ids that share a band key are a bucket, and of a
bucket the ids that near sketches connect are a *part*, which the caller
verifies. Keys that very many rows have are found before the shuffle, from
counts that each task makes of its own rows, and their rows are dealt out as
pairs of blocks. A key that those counts miss is cut into blocks as its rows
stream by, and dealt out then. Either way a task holds two blocks at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from keyloom.llm.common import Batches, binary_rows, free, mapped, materialize, quoted, slim

BITS_APART = 15  #: of the 60 bits of two sketches, at most; a pair at 0.8 is further apart with probability 0.0001
BLOCK = 16_384  #: rows of a block
PART = 2048  #: ids of a part; a larger one is dealt out as pairs of halves of this size
WINDOW = 1 << 20  #: keys over which a task counts
OFTEN = 32  #: times that a key is met in a window before it is reported
ROWS_OUT = 1 << 16  #: of an Arrow batch of dealt rows
MOST_HOT = 1 << 20  #: keys that are sent to all tasks (24 MB), the most frequent; others are cut as they stream by
BLOOM_WORDS = 1 << 20  #: longs of the filters sent to tasks, whatever the corpus holds; a full one only filters less


def band_keys(b: pa.RecordBatch, bands: int) -> np.ndarray:
    """The keys of rows (id, sketch, bands): the band's number above the 32 bits of its hash."""
    return binary_rows(b.column(2), "<u4", bands).astype(np.int64) | (np.arange(bands, dtype=np.int64) << 32)


def _frequent(bands: int, often: int) -> Callable[[Batches], Batches]:
    """(key, n) of keys that a task meets ``often`` or more times in a window."""

    def run(batches: Batches) -> Batches:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            hot = n >= often
            return pa.RecordBatch.from_arrays([pa.array(keys[hot]), pa.array(n[hot].astype(np.int64))], ["key", "n"])

        for b in batches:
            if b.num_rows:
                held.append(band_keys(b, bands).ravel())
                size += len(held[-1])
                if size >= WINDOW:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return slim(run)


def hot_keys(signed: DataFrame, bands: int, block: int, often: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of more than ``block`` rows, ascending, and how many blocks each is cut into."""
    counts = signed.mapInArrow(_frequent(bands, often), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") > block).orderBy(F.desc("n"), "key").limit(MOST_HOT).toArrow()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], -(-n[order] // block) + 1  # one more, as windows may have missed some rows


def _number(members: np.ndarray) -> np.ndarray:
    """A number for each row of ascending ids, the same wherever the same ids meet; equal numbers only mean more to verify."""
    h = np.full(len(members), members.shape[1], np.uint64)
    for column in members.T:
        h = (h ^ column.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return (h >> np.uint64(1)).view(np.int64)


def _dealt(bands: int, hot: tuple[np.ndarray, np.ndarray]) -> Callable[[Batches], Batches]:
    """(key, id, sketch) of every band; a row of a hot key comes under a key of its own, below 0, for each pair of blocks that it is in."""
    names = ["key", "id", "sketch"]
    hot_key, blocks = hot

    def run(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            keys = band_keys(b, bands).ravel()
            ids, sketches = (np.repeat(c.to_numpy(zero_copy_only=False), bands) for c in b.columns[:2])
            if not len(hot_key):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, ids, sketches)], names)
                continue
            at = np.minimum(np.searchsorted(hot_key, keys), len(hot_key) - 1)
            hit = hot_key[at] == keys
            yield pa.RecordBatch.from_arrays([pa.array(x[~hit]) for x in (keys, ids, sketches)], names)
            hits = np.flatnonzero(hit)
            n = blocks[at[hits]]
            own = ((ids[hits].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
            total = np.cumsum(n - 1)
            i = 0
            while i < len(hits):
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + ROWS_OUT, "right")))
                row = np.repeat(np.arange(i, j), n[i:j] - 1)
                other = np.arange(len(row)) - np.repeat(np.cumsum(n[i:j] - 1) - (n[i:j] - 1), n[i:j] - 1)
                other += other >= own[row]  # all blocks but its own; a pair of blocks holds the pairs within them too
                pair = _number(np.stack([keys[hits[row]], np.minimum(other, own[row]), np.maximum(other, own[row])], axis=1)) | np.int64(-1 << 63)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pair, ids[hits[row]], sketches[hits[row]])], names)
                i = j

    return slim(run)


def groups(batches: Batches, keys: int, most: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, int | None]]:
    """Columns, bounds of groups of equal first ``keys`` columns, and a piece's number; rows are sorted by them.

    A group of more than ``most`` rows comes in pieces of about that size,
    numbered from 0; every other comes whole, with number None.
    """
    tail: list[list[np.ndarray]] = []  # of the last group, batch by batch
    size, piece = 0, 0

    def taken() -> tuple[list[np.ndarray], np.ndarray, np.ndarray, int | None]:
        columns = [np.concatenate(x) for x in zip(*tail, strict=True)]
        return columns, np.array([0]), np.array([len(columns[0])]), piece if piece or len(columns[0]) > most else None

    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])) + 1
        if tail and any(t[-1] != c[0] for t, c in zip(tail[-1][:keys], columns, strict=False)):
            yield taken()
            tail, size, piece = [], 0, 0
        end = int(cut[0]) if len(cut) else b.num_rows
        tail.append([c[:end].copy() for c in columns])
        size += end
        if len(cut):
            yield taken()
            if len(cut) > 1:
                yield columns, cut[:-1], cut[1:], None
            tail, size, piece = [[c[cut[-1] :].copy() for c in columns]], int(b.num_rows - cut[-1]), 0
        if size > most:
            columns = [np.concatenate(x) for x in zip(*tail, strict=True)]
            yield columns, np.array([0]), np.array([size]), piece
            # the group goes on with its last row, which any piece may hold again
            tail, size, piece = [[c[-1:].copy() for c in columns]], 1, piece + 1
    if tail:
        yield taken()


def _connected(ids: np.ndarray, sketches: np.ndarray, apart: int = BITS_APART) -> list[np.ndarray]:
    """Ascending ids of what the sketches connect, two or more each."""
    out, left = [], np.arange(len(ids))
    while len(left) > 1:
        members, left = [int(left[0])], left[1:]
        at = 0
        while at < len(members) and len(left):
            hit = np.bitwise_count((sketches[left] ^ sketches[members[at]]).view(np.uint64)) <= apart
            members.extend(left[hit].tolist())
            left = left[~hit]
            at += 1
        if len(members) > 1:
            out.append(np.sort(ids[members]))
    return out


def cut_part(members: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The part itself, or pairs of its halves of a ``most``, which hold every pair of members."""
    if len(members) <= most:
        yield members
        return
    half = max(1, most // 2)
    blocks = [members[i : i + half] for i in range(0, len(members), half)]
    for i, a in enumerate(blocks):
        for b in blocks[i + 1 :]:
            yield np.concatenate((a, b))


def _parts(ids: np.ndarray, sketches: np.ndarray, first: np.ndarray, last: np.ndarray, most: int, apart: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """(part, id) of the rows that have a partner by sketch within their group.

    A part is what may be linked within one bucket. Its number depends on its
    ids alone, so lines that share many bands are verified once.
    """
    parts, members = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    two = first[last - first == 2]
    two = two[(np.bitwise_count((sketches[two] ^ sketches[two + 1]).view(np.uint64)) <= apart) & (ids[two] != ids[two + 1])]
    if len(two):
        pairs = np.sort(np.stack([ids[two], ids[two + 1]], axis=1), axis=1)
        parts.append(np.repeat(_number(pairs), 2))
        members.append(pairs.ravel())
    for a, b in zip(*(x[last - first > 2].tolist() for x in (first, last)), strict=True):
        own, at = np.unique(ids[a:b], return_index=True)
        for found in _connected(own, sketches[a:b][at], apart):
            for part in cut_part(found, most):
                parts.append(np.repeat(_number(part[None, :]), len(part)))
                members.append(part)
    return np.concatenate(parts), np.concatenate(members)


FOUND = "part long, id long, key long, sketch long, block int"


def _near(most: int, limit: int | None = None, apart: int = BITS_APART) -> Callable[[Batches], Batches]:
    """Rows (key, id, sketch), sorted by key, as FOUND.

    A bucket gives the (part, id) of its rows with a partner; one of more than
    ``limit`` rows gives its rows with the block of each instead.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()]

    def made(n: int, **given: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in zip(names, kinds, strict=True)], names)

    def run(batches: Batches) -> Batches:
        for (keys, ids, sketches), first, last, piece in groups(batches, 1, 1 << 62 if limit is None else limit):
            if piece is not None:
                own, at = np.unique(ids, return_index=True)
                n = len(own)
                yield made(n, id=own, key=np.full(n, keys[0]), sketch=sketches[at], block=np.full(n, piece, np.int32))
                continue
            parts, members = _parts(ids, sketches, first, last, most, apart)
            if len(parts):
                yield made(len(parts), part=parts, id=members)

    return slim(run)


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Rows of crowded buckets (key, id, sketch, block), each with every other block of its bucket."""
    sizes = rows.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: (x != F.col("block")) | (F.col("blocks") == 1)))
    pair = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return rows.join(sizes, "key").withColumn("other", other).select(pair.alias("key"), "id", "sketch")


def candidates(signed: DataFrame, bands: int, tag: str, block: int = BLOCK, often: int = OFTEN, most: int = PART, apart: int = BITS_APART) -> DataFrame:
    """Distinct ``part, id`` of what must be verified; ``signed``: id, sketch and the bands' 32-bit hashes as bytes.

    Sketches are near that differ in ``apart`` bits at most. ``signed`` is read
    twice. Rows that repeat an id are one.
    """
    schema = "key long, id long, sketch long"
    hot = hot_keys(signed, bands, block, often)
    sent = signed.sparkSession.sparkContext.broadcast(hot)

    def deal(batches: Batches) -> Batches:
        yield from _dealt(bands, sent.value)(batches)

    gathered = signed.mapInArrow(deal, schema).repartition("key").sortWithinPartitions("key")
    found = mapped(gathered, _near(most, 2 * block, apart), FOUND, f"{tag}-bands")
    crowded = found.where("part is null").select("key", "id", "sketch", "block")
    # a pair of their blocks is what a task holds at once, so nothing is left crowded
    rest = _pairs_of_blocks(crowded).repartition("key").sortWithinPartitions("key").mapInArrow(_near(most, apart=apart), FOUND)
    return materialize(found.where("part is not null").select("part", "id").union(rest.select("part", "id")).distinct(), f"{tag}-near")


def _bit(column: str) -> tuple[Column, Column]:
    """The word of a hash (64-bit number) in a bit set of BLOOM_WORDS longs, and its bit there."""
    return F.col(column).bitwiseAND(F.lit(BLOOM_WORDS - 1)).cast("int"), F.expr(f"cast(shiftrightunsigned(`{column}`, 40) & 63 as int)")


def bloom(df: DataFrame, column: str) -> DataFrame:
    """A bit set that holds the column's hashes: ``w, b``, BLOOM_WORDS rows at most."""
    word, bit = _bit(column)
    return df.select(word.alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("b"))


def as_array(bits: DataFrame) -> np.ndarray:
    """The bit set as an array, for :func:`holds`."""
    rows, out = bits.toArrow(), np.zeros(BLOOM_WORDS, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit set may hold each of the hashes."""
    at = (hashes.view(np.uint64) >> np.uint64(40)) & np.uint64(63)
    return (bits[hashes & (BLOOM_WORDS - 1)].view(np.uint64) >> at) & np.uint64(1) != 0


def filtered(df: DataFrame, column: str, bits: DataFrame, within: bool) -> DataFrame:
    """Rows of ``df`` whose hash the bit set may hold, or those whose hash it doesn't hold. The bit set is broadcast, which its size bounds."""
    w, b = free(df.columns, "_w", "_b")
    word, bit = _bit(column)
    found = df.join(F.broadcast(bits.toDF(w, b)), word == F.col(w), "left")
    hit = F.coalesce(F.getbit(F.col(b), bit) == 1, F.lit(False))
    return found.where(hit if within else ~hit).select(*quoted(df.columns))
