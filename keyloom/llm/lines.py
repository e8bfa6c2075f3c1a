"""Fuzzy line deduplication by MinHash.

Lines are compared as sets of character shingles. Distinct lines are signed,
cut into bands, and lines that share a band are verified by exact Jaccard
similarity; distributed union-find makes components of the links, and of every
component the first line (smallest doc_id, then line number) stays.

Texts stay where they are: what is shuffled are ids, places and signatures.
Lines that share a band are first held against each other by one bit of each
of their minima (:mod:`keyloom.llm.buckets`, which also deals out crowded
bands); only lines with a partner by that are read again and verified, and each
task returns a forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from keyloom.llm import buckets
from keyloom.llm.common import Batches, binary_column, free, map_named, mapped, materialize, quoted, release, slim
from keyloom.llm.graph import EDGES, Forest, components

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 12  #: a pair at 0.8 shares a band with probability 0.991, at 0.85 with 0.999
MIN_CHARS = 1  #: shorter lines always stay; blank ones do so whatever this says
FEW = 5  #: lines of a part that are compared pair by pair
MANY = 32  #: sets of a part whose parities are compared first
CHUNK = 1 << 20  #: numbers of sets that are compared at once
KEPT = 1 << 22  #: numbers of a part's sets that are held
SEEN = 200_000  #: lines that a task remembers to have signed
SLICE = 8192  #: lines that are handed on at once
_LAST = (1 << 63) - 1
_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all shingles, line after line, and where each line's start."""
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    h = codes[: len(codes) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        h *= np.uint64(0x100000001B3)
        h ^= codes[i : len(codes) - SHINGLE + 1 + i]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    short = (h >> np.uint64(32)).astype(np.uint32)
    ends = np.cumsum(sizes)
    use = np.ones(len(short), bool)
    for i in range(1, SHINGLE):
        at = ends[:-1] - i
        use[at] = False
    return short[use], np.concatenate(([0], np.cumsum(sizes - SHINGLE + 1)[:-1]))


def signatures(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of every line: a sketch (one bit of each minimum) and the BANDS 32-bit hashes of its bands."""
    bands = np.empty((len(lines), BANDS), np.uint32)
    sketches = np.zeros(len(lines), np.int64)
    at = 0
    while at < len(lines):
        end, size = at, 0
        while end < len(lines) and (end == at or size + len(lines[end]) <= 1 << 16):
            size += len(lines[end])
            end += 1
        h, starts = _shingle_hashes(lines[at:end])
        minima = np.empty((ROWS * BANDS, end - at), np.uint32)
        scratch = np.empty_like(h)
        for k in range(ROWS * BANDS):
            np.multiply(h, _MUL[k], out=scratch)
            minima[k] = np.minimum.reduceat(scratch, starts)
            bit = (minima[k] * np.uint32(0x9E3779B1)) >> np.uint32(31)
            sketches[at:end] |= bit.astype(np.int64) << k
        for band in range(BANDS):
            key = np.zeros(end - at, np.uint64)
            for m in minima[band * ROWS : (band + 1) * ROWS]:
                key = (key ^ m) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            bands[at:end, band] = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = end
    return sketches, bands


def comparable(text: str | None, least: int = MIN_CHARS) -> tuple[list[int], list[str]]:
    """Numbers and texts of a text's lines that are compared: without outer spaces, in lower case, ``least`` characters or more, not blank."""
    own = [x.strip(" ") for x in text.lower().split("\n")] if text else []
    nos = [i for i, x in enumerate(own) if len(x) >= least and x and not x.isspace()]
    return nos, own if len(nos) == len(own) else [own[i] for i in nos]


def line_ids(own: list[str]) -> np.ndarray:
    """The lines' ids, signed 64-bit hashes of them."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x.encode("utf-8", "surrogatepass")) for x in own], np.uint64).view(np.int64)


def _sign(least: int) -> Callable[[Batches], Batches]:
    """Rows (doc, th, text) as a row for each line: its id and place, and sketch and bands where the task meets the line first."""
    names = ["_id", "_doc", "_th", "_no", "_sketch", "_bands"]

    def run(batches: Batches) -> Batches:
        seen: set[int] = set()

        def made(b: pa.RecordBatch, rows: list[int], nos: list[int], own: list[str]) -> pa.RecordBatch:
            ids = line_ids(own)
            if len(seen) > SEEN:
                seen.clear()
            new, place = [], np.full(len(own), -1)
            for i, ident in enumerate(ids.tolist()):
                if ident not in seen:
                    seen.add(ident)
                    place[i] = len(new)
                    new.append(own[i])
            sketches, bands = signatures(new)
            at, index = pa.array(rows, pa.int64()), pa.array(place, mask=place < 0)
            return pa.RecordBatch.from_arrays([pa.array(ids), b.column(0).take(at), b.column(1).take(at), pa.array(nos, pa.int32()), pa.array(sketches).take(index), binary_column(bands).take(index)], names)

        for b in batches:
            rows, nos, own = [], [], []
            for row, text in enumerate(b.column(2).to_pylist()):
                more, found = comparable(text, least)
                for i in range(0, len(found), SLICE):
                    part = found[i : i + SLICE]
                    rows += [row] * len(part)
                    nos += more[i : i + SLICE]
                    own += part
                    if len(own) >= SLICE:
                        yield made(b, rows, nos, own)
                        rows, nos, own = [], [], []
            if own:
                yield made(b, rows, nos, own)

    return slim(run)


def _wanted(least: int, bits: np.ndarray) -> Callable[[Batches], Batches]:
    """Rows (text) as (id, line) of the lines whose id the bit set may hold."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            own = [line for text in b.column(0).to_pylist() for line in comparable(text, least)[1]]
            ids = line_ids(own)
            hit = np.flatnonzero(buckets.holds(bits, ids))
            if len(hit):
                ids, first = np.unique(ids[hit], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([own[i] for i in hit[first].tolist()], pa.string())], ["id", "line"])

    return run


def shingles(line: str) -> frozenset[str]:
    return frozenset(line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1)))


def similar(x: frozenset[str], y: frozenset[str], least: float = SIMILARITY) -> bool:
    """Whether the exact Jaccard similarity is ``least`` or more."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(x & y)
    return both >= least * (len(x) + len(y) - both) - 1e-9


def link_lines(rows: list[tuple[int, str]], links: Forest, least: float = SIMILARITY) -> None:
    """Link all similar lines of ``rows`` (id, line). A component that can't hold a partner is passed over."""
    groups: list[tuple[list[tuple[int, frozenset[str]]], set[str]]] = []
    for ident, line in sorted(set(rows)):
        own = shingles(line)
        hits = []
        for k, (members, every) in enumerate(groups):
            if len(own & every) >= least * len(own) - 1e-9 and any(similar(own, other, least) for _, other in members):
                hits.append(k)
        if not hits:
            groups.append(([(ident, own)], set(own)))
            continue
        members, every = groups[hits[0]]
        links.union(members[0][0], ident)
        members.append((ident, own))
        every.update(own)
        for k in reversed(hits[1:]):
            more, others = groups.pop(k)
            links.union(members[0][0], more[0][0])
            members.extend(more)
            every.update(others)


def _sets(lines: list[str], side: int) -> tuple[np.ndarray, np.ndarray]:
    """Every line's shingles as a sorted row of 60-bit numbers, and how many there are.

    What is no shingle, or one again, is a number that no row of the other side has.
    """
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    width = int(length.max())
    codes = np.zeros((len(lines), width), np.int64)
    codes[np.arange(width) < length[:, None]] = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    n = width - SHINGLE + 1
    sets = np.zeros((len(lines), n), np.int64)
    for i in range(SHINGLE):
        sets = (sets << 12) | codes[:, i : i + n]
    unlike = (1 << 61) + (side << 40) + np.arange(n)
    sets = np.where(np.arange(n) < (length - SHINGLE + 1)[:, None], sets, unlike)
    sets.sort(axis=1)
    again = np.zeros_like(sets, bool)
    again[:, 1:] = sets[:, 1:] == sets[:, :-1]
    return np.where(again, unlike + (1 << 30), sets), length - SHINGLE + 1 - again.sum(axis=1)


def _alike(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of a and b, sets of n and m shingles, are similar."""
    both = np.concatenate((a, b), axis=1)
    both.sort(axis=1)
    common = (both[:, 1:] == both[:, :-1]).sum(axis=1)
    return common >= least * (n + m - common) - 1e-9


def similar_pairs(pairs: list[tuple[str, str]], least: float = SIMILARITY) -> np.ndarray:
    """Whether each pair's exact Jaccard similarity is ``least`` or more, many at a time.

    For lines of SHINGLE characters or more, all below U+1000: a shingle is then
    a number of 60 bits, and sets are sorted rows of a matrix.
    """
    out = np.zeros(len(pairs), bool)
    order = sorted(range(len(pairs)), key=lambda i: max(map(len, pairs[i])))
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and (end == at or (end + 1 - at) * max(map(len, pairs[order[end]])) <= 1 << 15):
            end += 1
        (a, n), (b, m) = (_sets([pairs[i][side] for i in order[at:end]], side) for side in (0, 1))
        out[order[at:end]] = _alike(a, b, n, m, least)
        at = end
    return out


def _numbers(line: str) -> np.ndarray:
    """A line's shingles as ascending 60-bit numbers; for lines as :func:`similar_pairs` takes them."""
    codes = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.int64)
    out = codes[: len(codes) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        out = (out << 12) | codes[i : len(codes) - SHINGLE + 1 + i]
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _parities(own: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` bits of a set, each the parity of how many numbers fall on it: two sets' bits differ in no more places than the sets in numbers."""
    at = (own.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bits.bit_length())
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(bool)).view(np.uint64)


def link_sets(rows: list[tuple[int, np.ndarray]], links: Forest, least: float = SIMILARITY) -> None:
    """Link the sets (ascending, not empty) of exact Jaccard similarity ``least`` or more."""
    link_made([i for i, _ in rows], lambda k: rows[k][1], links, least)


def link_made(idents: list[int], given: Callable[[int], np.ndarray], links: Forest, least: float = SIMILARITY) -> None:
    """:func:`link_sets` of sets that ``given`` gives by number: a search from set to set over those not reached yet.

    Of MANY sets or more the parities are compared first, which rule out most
    pairs that aren't similar and none that is. Sets of KEPT numbers in all are
    held; others are made again when they are needed, CHUNK numbers at once, so
    a part of very long ones is never held whole.
    """
    n, held, kept, size = len(idents), 0, {}, np.zeros(len(idents), np.int64)
    for k in range(n):
        own = given(k)
        size[k] = len(own)
        held += len(own)
        if held <= KEPT:
            kept[k] = own

    def made(k: int) -> np.ndarray:
        return kept[k] if k in kept else given(k)

    bits = 1 << min(15, max(9, int(4 * size.max(initial=1) - 1).bit_length()))
    parity = np.stack([_parities(made(k), bits) for k in range(n)]) if n >= MANY else None
    left = np.arange(n)
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            x = reached.pop()
            near = left[np.minimum(size[left], size[x]) >= least * np.maximum(size[left], size[x]) - 1e-9]
            if parity is not None and len(near):
                apart = np.concatenate([np.bitwise_count(parity[near[i : i + 256]] ^ parity[x]).sum(axis=1, dtype=np.int64) for i in range(0, len(near), 256)])
                near = near[apart <= (1 - least) / (1 + least) * (size[near] + size[x]) + 1e-6]
            if not len(near):
                continue
            own, upto, at, found = made(x), np.cumsum(size[near]), 0, []
            while at < len(near):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK, "right")))
                some = near[at:end]
                flat = np.concatenate([made(k) for k in some.tolist()])
                place = np.searchsorted(own, flat)
                same = own[np.minimum(place, len(own) - 1)] == flat
                both = np.add.reduceat(same, np.concatenate(([0], np.cumsum(size[some])[:-1])), dtype=np.int64)
                found.append(some[both >= least * (size[x] + size[some] - both) - 1e-9])
                at = end
            found = np.concatenate(found)
            for y in found.tolist():
                links.union(idents[x], idents[y])
            reached.extend(found.tolist())
            left = np.setdiff1d(left, found, assume_unique=True)


def _numbered(lines: list[str]) -> Callable[[int], np.ndarray]:
    """The shingles of each of ``lines`` as ascending numbers, exactly, for lines of any length and characters."""
    if all(len(x) >= SHINGLE and (x.isascii() or max(x) < "\u1000") for x in lines):
        return lambda k: _numbers(lines[k])
    known: dict[str, int] = {}
    return lambda k: np.sort(np.array([known.setdefault(x, len(known)) for x in shingles(lines[k])], np.int64))


def verify(batches: Batches) -> Batches:
    """Links of one task's parts; rows (part, id, line) sorted by part."""
    links, held, rows = Forest(), None, {}
    pairs: list[tuple[int, int, str, str]] = []

    def close() -> None:
        own = list(rows.items())
        plain = all(len(x) >= SHINGLE and (x.isascii() or max(x) < "\u1000") for _, x in own)
        if len(own) > FEW:
            link_made([i for i, _ in own], _numbered([x for _, x in own]), links)
        elif plain:
            pairs.extend((a[0], b[0], a[1], b[1]) for i, a in enumerate(own) for b in own[:i])
        else:
            link_lines(own, links)

    def settle() -> None:
        for (a, b, _, _), yes in zip(pairs, similar_pairs([p[2:] for p in pairs]).tolist(), strict=True):
            if yes:
                links.union(a, b)
        pairs.clear()

    for b in batches:
        for part, ident, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held != part:
                close()
                held, rows = part, {}
            rows[ident] = line
        settle()
    close()
    settle()
    yield from links.batches()


def _place(text: Column) -> list[Column]:
    """What a document is known by: doc_id (the last of all where there is none) and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(text)]


def line_roots(docs: DataFrame, met: DataFrame, min_chars: int = MIN_CHARS, block: int = buckets.BLOCK, often: int = buckets.OFTEN, most: int = buckets.PART) -> DataFrame:
    """``_id, _root`` of every line met twice or similar to another; lines of one component have one root."""
    twice = materialize(met.groupBy("_id").count().where("count > 1").select("_id"), "twice")
    signed = met.where("_bands is not null").select("_id", "_sketch", "_bands")
    near = buckets.candidates(signed, BANDS, "line", block, often, most)
    sent = docs.sparkSession.sparkContext.broadcast(buckets.as_array(buckets.bloom(near, "id")))

    def wanted(batches: Batches) -> Batches:
        yield from slim(_wanted(min_chars, sent.value))(batches)

    lines = materialize(docs.select(F.col("text").cast("string")).mapInArrow(wanted, "id long, line string").groupBy("id").agg(F.min("line").alias("line")), "texts")
    pairs = near.join(lines, "id").select("part", "id", "line")
    roots = components(pairs.repartition("part").sortWithinPartitions("part").mapInArrow(slim(verify), EDGES), "lines")
    roots = roots.select(F.col("node").alias("_id"), F.col("root").alias("_root")).union(roots.select("root", "root").distinct())
    found = materialize(roots.union(twice.join(roots, "_id", "left_anti").select("_id", F.col("_id").alias("_root"))), "roots")
    release(near, lines, twice)
    return found


def added(columns: list[str]) -> list[str]:
    """Names of the two columns that :func:`dedup_lines` adds to those: ``_lines`` and ``_removed`` where they are unused."""
    return free(columns, "_lines", "_removed")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, block: int = buckets.BLOCK, often: int = buckets.OFTEN, most: int = buckets.PART) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, and the number of its lines and of those removed (long; see :func:`added`).

    Blank lines always stay, and lines shorter than ``min_chars``. Rows that
    repeat a doc_id and text are one document and lose the same lines; rows
    without doc_id come last in the order that decides which line stays. A null
    text stays null with no lines. Other columns are passed on, whatever their
    names. An empty table gives no rows.
    """
    text = F.col("text").cast("string")
    met = mapped(docs.select(*_place(text), text), _sign(min_chars), "_id long, _doc long, _th long, _no int, _sketch long, _bands binary", "met")
    place = F.struct("_doc", "_th", "_no")
    roots = line_roots(docs, met, min_chars, block, often, most)
    places = buckets.filtered(met.select("_id", "_doc", "_th", "_no"), "_id", buckets.bloom(roots, "_id"), True)  # most lines stand alone
    again = materialize(places.join(roots, "_id").select("_root", "_doc", "_th", "_no"), "again")
    first = materialize(again.groupBy("_root").agg(F.min(place).alias("_keep")), "keep")
    gone = again.join(first, "_root").where(place != F.col("_keep")).groupBy("_doc", "_th").agg(F.collect_set("_no").alias("_nos"))
    names = added(docs.columns)
    doc, th, key, nos, doc2, th2 = free([*docs.columns, *names], "_doc", "_th", "_key", "_nos", "_doc2", "_th2")
    gone = materialize(gone.select(F.col("_doc").alias(doc2), F.col("_th").alias(th2), F.xxhash64("_doc", "_th").alias(key), F.col("_nos").alias(nos)), "gone")
    bits = buckets.bloom(gone, key)
    keyed = docs.withColumns(dict(zip((doc, th), _place(text), strict=True))).withColumn("text", text)
    keyed = keyed.withColumn(key, F.xxhash64(doc, th))
    total = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    columns = [*docs.columns, *names]
    # texts without a line to lose are not shuffled
    whole = buckets.filtered(keyed, key, bits, False).withColumns({names[0]: total, names[1]: F.lit(0).cast("long")}).select(*quoted(columns))
    some = buckets.filtered(keyed, key, bits, True).drop(key)
    joined = some.join(gone.drop(key), (F.col(doc) == F.col(doc2)) & (F.col(th) == F.col(th2)), "left").select(*quoted(docs.columns), nos)
    at = docs.columns.index("text")

    def cut(batches: Batches) -> Batches:
        for b in batches:
            texts, counts, lost = [], [], []
            for t, n in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                parts, out = t.split("\n") if t is not None else [], set(n or ())
                texts.append(t if not out else "\n".join(x for i, x in enumerate(parts) if i not in out))
                counts.append(len(parts))
                lost.append(len(out))
            own = [*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 : -1]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(lost, pa.int64())], columns)

    return whole.union(map_named(joined, cut, whole.schema))


def query(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import bound_batches, table

    bound_batches(spark)
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"))
