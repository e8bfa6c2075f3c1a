"""Best-fit packing of token pieces into fixed-length sequences.

Large items (above a third of the capacity) are matched greedily, the largest
with the largest that still fits, so a sequence holds at most two of them; the
smaller ones then go, largest first, to the smallest gap that takes them.

The rules only look at lengths, so they run on the histogram of lengths: at
most ``capacity`` counts, whatever the corpus holds. What they give is a table
of ranges ("the pieces of length L from rank r on go to these sequences"), and
each piece finds its range by its rank among the pieces of its length. Ranks
are counted in buckets, so a length that a third of all pieces have is split.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from keyloom.llm.common import Batches, free, map_named, mapped, materialize, quoted, slim

CAPACITY = 2048
BUCKETS = 20_000  #: of ranks in all, besides one for each length
BUCKET_ROWS = 200  #: least rows of a full bucket
VOCABULARY = "word_bpe_49k.json"
_CACHED = 48 << 20  #: bytes of words and ids that a worker remembers, in each of two generations
_ENTRY = 150  #: bytes of an entry besides its characters and ids
_STEP = 20_000  #: words of a text that are looked up at once
_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_ODD = re.compile("<\\||[\x1c-\x1f]")
#: Latin-1 characters that are neither letter, number, white space nor apostrophe; and a whole run of them away from apostrophes.
_MARK = r"\x00-\x08\x0e-\x1b!-&(-/:-@\[-`{-\x84\x86-\x9f\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7"
_RUN = re.compile(rf"[{_MARK}](?<![{_MARK}'].)[{_MARK}]*+(?!')", re.S)


class Encoder:
    """Token ids of texts by a word-level BPE vocabulary that drops white space.

    No token spans white space, so the ids of a text are those of its words;
    words met before come from a table of two generations, bounded in bytes.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        tokens = self.model.get_vocab()
        self.ends = np.zeros(max(tokens.values(), default=0) + 1, bool)  #: tokens that end a word
        self.ends[[i for token, i in tokens.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters, many to a call; they are told apart by the tokens that end a word."""
        out: list[bytes] = []
        groups = [words[i : i + 256] for i in range(0, len(words), 256)]
        found = self.model.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False) if groups else []
        for group, x in zip(groups, found, strict=True):
            ids = np.array(x.ids, "<u4")
            data, cut = ids.tobytes(), [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(cut) == len(group) + 1 and cut[-1] == len(data):
                out.extend([data[a:b] for a, b in zip(cut, cut[1:], strict=False)])
            else:
                out.extend(self._ids(group))
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _ODD.search(text):
            return self._ids([text])[0]
        try:
            text.encode("latin-1")
            text = _RUN.sub(r" \g<0> ", text.lower())
        except UnicodeEncodeError:
            pass
        words, parts = text.split(), []
        for i in range(0, len(words), _STEP):
            part = words[i : i + _STEP]
            self._learn(set(part))
            parts.append(b"".join(map(self.known.__getitem__, part)))
        return b"".join(parts)

    def _learn(self, words: set[str]) -> None:
        """Have the ids of all these words in the table."""
        new = words.difference(self.known)
        if not new:
            return
        if self.held > _CACHED:  # the older generation goes
            self.before, self.known, self.held, new = self.known, {}, 0, words
        met = {w: ids for w in new if (ids := self.before.get(w)) is not None}
        plain = [w for w in new if w not in met and _LETTERS.fullmatch(w)]
        other = list(new.difference(met, plain))
        met.update(zip(plain, self._words(plain), strict=True))
        met.update(zip(other, self._ids(other), strict=True))
        self.known.update(met)
        self.held += sum(map(len, met)) + sum(map(len, met.values())) + _ENTRY * len(met)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The Encoder of a Python worker; it stays for the worker's next task."""
    return Encoder(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _cut(schema: T.StructType, capacity: int, vocabulary: str | None) -> Callable[[Batches], Batches]:
    """Rows (doc_id, text) as the pieces of :func:`pieces`; a column more than its own is a random number."""
    names = schema.fieldNames()
    step = 4 * capacity

    def run(batches: Batches) -> Batches:
        own, draw = encoder(vocabulary or vocabulary_path()), np.random.default_rng()
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                data = own.encode(text) + b"\0\0\0\0"
                for k, i in enumerate(range(0, len(data), step)):
                    part = data[i : i + step]
                    at.append(row)
                    piece.append(k)
                    start.append(i // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if "ids" in names:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array(ids, pa.list_(pa.int32()))] if "ids" in names else []
            columns += [pa.array(draw.integers(0, 1 << 30, len(at)), pa.int32())] if len(columns) < len(names) else []
            yield pa.RecordBatch.from_arrays(columns, names)
        own.before = {}  # the worker stays for other tasks

    return slim(run)


def _pieces(docs: DataFrame, with_ids: bool = False) -> tuple[DataFrame, T.StructType]:
    out = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return docs.select("doc_id", F.col("text").cast("string")), out.add("ids", T.ArrayType(T.IntegerType())) if with_ids else out


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]``: every document's ids and a closing 0, cut where longer than ``capacity``.

    A null or empty text is the closing 0 alone; repeated rows and null doc_ids
    give their own pieces. ``vocabulary``: a tokenizers file, by default the
    public word-level one, found on each executor.
    """
    texts, out = _pieces(docs, with_ids)
    return texts.mapInArrow(_cut(out, capacity, vocabulary), out)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Groups of equal sequences: ``(sequences, [(length, items, offset), ...])``.

    ``counts``: pieces of each length, 1 to ``capacity``.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    made: list[tuple[int, list[int], int]] = []
    while large:  # the largest with the largest that fits; large is ascending
        a = large[-1]
        k = bisect_left(large, capacity - a + 1)
        if k == len(large) and left[a] == 1:
            k -= 1
        b = large[k - 1] if k > 0 else None
        if b is None:
            made.append((left[a], [a], capacity - a))
            left[a] = 0
        elif a == b:
            n = left[a] // 2
            made.append((n, [a, a], capacity - 2 * a))
            left[a] -= 2 * n
        else:
            n = min(left[a], left[b])
            made.append((n, [a, b], capacity - a - b))
            left[a] -= n
            left[b] -= n
        large = [n for n in large if left[n]]

    groups: list[tuple[int, list[tuple[int, int, int]]]] = []
    by_gap: dict[int, list[tuple[int, list[tuple[int, int, int]]]]] = {}
    gaps: list[int] = []

    def place(n: int, items: list[tuple[int, int, int]], gap: int) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append((n, items))

    for n, lengths, gap in made:
        items, offset = [], 0
        for size in lengths:
            items.append((size, 1, offset))
            offset += size
        place(n, items, gap)
    for size in sorted((n for n in left if left[n]), reverse=True):
        c = left[size]
        while c:
            k = bisect_left(gaps, size)
            if k == len(gaps):
                each = capacity // size
                if c // each:
                    place(c // each, [(size, each, 0)], capacity - each * size)
                if c % each:
                    place(1, [(size, c % each, 0)], capacity - c % each * size)
                break
            gap = gaps[k]
            n, items = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[k]
            each, offset = gap // size, capacity - gap
            full = min(n, c // each)
            if full:
                place(full, [*items, (size, each, offset)], gap - each * size)
                c -= full * each
                n -= full
            if n and c:  # fewer than fill one gap
                place(1, [*items, (size, c, offset)], gap - c * size)
                c, n = 0, n - 1
            if n:
                place(n, items, gap)
    for some in by_gap.values():
        groups.extend(some)
    return groups


class Places:
    """Where the piece of a length and rank goes: arrays bounded by the plan, not by the corpus."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        rows, base, seen = [], 0, dict.fromkeys(counts, 0)
        for n, items in plan(counts, capacity):
            for size, each, offset in items:
                rows.append((size, seen[size], each, offset, base))
                seen[size] += n * each
            base += n
        assert seen == {n: c for n, c in counts.items()}
        self.sequences = base
        rows.sort()
        self.rows = np.array(rows, np.int64).reshape(-1, 5)
        self.cut = np.searchsorted(self.rows[:, 0], np.arange(capacity + 2))

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty_like(rank), np.empty_like(rank)
        for size in np.unique(length):
            at = length == size
            own = self.rows[self.cut[size] : self.cut[size + 1]]
            r = rank[at]
            hit = own[np.searchsorted(own[:, 1], r, "right") - 1]
            i = r - hit[:, 1]
            sequence[at] = hit[:, 4] + i // hit[:, 2]
            offset[at] = hit[:, 3] + i % hit[:, 2] * size
        return sequence, offset


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (see :func:`pieces`) with ``sequence_id`` and ``offset`` (long).

    Pieces alike in every column are interchangeable; ties in doc_id are broken
    by piece, start and checksum. An empty table gives no rows; other columns of
    ``cut`` are passed on.
    """
    salt = free([*cut.columns, "sequence_id", "offset"], "_salt")[0]
    # pieces alike in every column are told apart by a number that is written down with them
    return _packed(materialize(cut.withColumn(salt, (F.rand(7) * (1 << 30)).cast("int")), "pieces"), salt, capacity)


def _packed(cut: DataFrame, salt: str, capacity: int) -> DataFrame:
    """A written table of pieces, each with a number in the column ``salt``, with their places."""
    spark = cut.sparkSession
    columns = [c for c in cut.columns if c != salt]
    split, bucket, rank, size = free([*cut.columns, "sequence_id", "offset"], "_split", "_bucket", "_rank", "_length")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = Places(counts, capacity)
    rows = max(BUCKET_ROWS, -(-sum(counts.values()) // BUCKETS))
    splits = spark.createDataFrame([(n, -(-c // rows)) for n, c in counts.items()], f"{size} long, {split} long")
    cut = cut.join(F.broadcast(splits), F.col("length") == F.col(size)).withColumn(bucket, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", salt), F.col(split)))
    ahead: dict[int, dict[int, int]] = {}
    for r in cut.groupBy("length", bucket).count().orderBy("length", bucket).collect():
        own = ahead.setdefault(r["length"], {"next": 0})
        own[r[bucket]] = own["next"]
        own["next"] += r["count"]
    given = spark.sparkContext.broadcast((places, ahead))
    w = W.partitionBy("length", bucket).orderBy("doc_id", "piece", "start", "ids_crc32", salt)
    ranked = cut.withColumn(rank, F.row_number().over(w).cast("long") - 1)
    out = cut.select(*quoted(columns)).schema.add("sequence_id", "long").add("offset", "long")
    names = out.fieldNames()

    def run(batches: Batches) -> Batches:
        places, ahead = given.value
        for b in batches:
            length, bucket, rank = (b.column(b.num_columns - i).to_numpy(zero_copy_only=False) for i in (3, 2, 1))
            base = np.array([ahead[n][k] for n, k in zip(length.tolist(), bucket.tolist(), strict=True)], np.int64)
            sequence, offset = places(length, base + rank)
            yield pa.RecordBatch.from_arrays([*b.columns[:-3], pa.array(sequence), pa.array(offset)], names)

    return map_named(ranked.select(*quoted(columns), F.col(size), bucket, rank), run, out)


def query(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import bound_batches, table

    bound_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their places. Null and empty texts are a closing 0 each; other columns are not read."""
    texts, out = _pieces(docs)
    kind = T.StructType([*out]).add("_salt", "integer")
    packed = _packed(mapped(texts, _cut(kind, capacity, vocabulary), kind, "pieces"), "_salt", capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
