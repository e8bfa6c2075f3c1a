"""Near-duplicate documents at an exact Jaccard similarity of word shingles.

Distinct shingle sets get a SimHash fingerprint, and its deletion variants
(:mod:`keyloom.llm.simhash`) find all that differ in three bits or fewer. Sets
at 0.8 mostly differ in more, so the sets are signed by MinHash too, and cut
into bands; those that share a band and have a near sketch are candidates as
well. Candidates of either kind are read again and verified by exact Jaccard
similarity, and union-find makes components of the links. Buckets are dealt out
by :mod:`keyloom.llm.buckets`, and what several buckets hold alike is verified
once.

Only ids, fingerprints, sketches and bands are shuffled; texts are read again
for the sets that have a partner.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from keyloom.llm import buckets, simhash
from keyloom.llm.common import Batches, binary_column, mapped, materialize, release, slim, text_hash, without
from keyloom.llm.decontaminate import windows
from keyloom.llm.graph import EDGES, Forest, components
from keyloom.llm.lines import link_sets

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 24  #: a pair at 0.8 shares a band with probability 0.9999
SKETCH = 60  #: minima that give a sketch one bit each; buckets.BITS_APART of them may differ
PART = 256  #: sets that are held against each other at once
_CHUNK = 1 << 16
_rng = np.random.default_rng(23)
_MUL = _rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Ascending 64-bit hashes of a text's word shingles; a shorter text is one shingle, a wordless one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    codes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(windows(codes, min(shingle, len(words))).view(np.uint64))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of every set, none empty: a sketch and the BANDS 32-bit hashes of its bands."""
    sketches, bands = np.zeros(len(sets), np.int64), np.empty((len(sets), BANDS), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= _CHUNK):
            size += len(sets[end])
            end += 1
        h = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate(([0], np.cumsum([len(x) for x in sets[at : end - 1]], dtype=np.int64)))
        scratch = np.empty_like(h)
        for band in range(BANDS):
            key = np.zeros(end - at, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                np.multiply(h, _MUL[k], out=scratch)
                low = np.minimum.reduceat(scratch, starts)
                if k < SKETCH:
                    sketches[at:end] |= ((low * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.int64) << k
                key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            bands[at:end, band] = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = end
    return sketches, bands


def node_of(own: np.ndarray) -> int:
    """A set's id, a 64-bit hash of it; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """A table of ``doc, th, node, fp, sketch, bands`` of rows (doc, th, text); sketch and bands are null for the empty set.

    fp: the SimHash fingerprint's bits as a signed long.
    """
    out = docs.select("doc", "th").schema.add("node", "long").add("fp", "long").add("sketch", "long").add("bands", "binary")
    names = out.fieldNames()

    def run(batches: Batches) -> Batches:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(2).to_pylist()]
            full = [i for i, x in enumerate(sets) if len(x)]
            sketches, bands = signatures([sets[i] for i in full])
            place = np.full(len(sets), -1)
            place[full] = np.arange(len(full))
            index = pa.array(place, mask=place < 0)
            fps = np.array([simhash.majority(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([node_of(x) for x in sets], pa.int64()), pa.array(fps), pa.array(sketches).take(index), binary_column(bands).take(index)], names)

    return mapped(docs, run, out, "doc-signed")


def _verify(batches: Batches) -> Batches:
    """Links of one task's parts; rows (part, id, shingles) sorted by part."""
    links, held, rows = Forest(), None, {}
    for b in batches:
        for part, ident, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held != part:
                link_sets(list(rows.items()), links)
                held, rows = part, {}
            rows[ident] = np.frombuffer(own, np.uint64)
    link_sets(list(rows.items()), links)
    yield from links.batches()


def _sets(shingle: int):
    def run(batches: Batches) -> Batches:
        for b in batches:
            own = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["id", "own"])

    return slim(run)


def _roots(texts: DataFrame, nodes: DataFrame, shingle: int, block: int, often: int, most: int) -> DataFrame:
    """``node, root`` of the sets that are linked to another; ``texts``: th, text; ``nodes``: node, th (of one of its texts), fp, sketch, bands."""
    full = nodes.where("bands is not null")
    close = simhash.candidates(full.select("node", "fp"), "doc-simhash", block, often, most)
    far = buckets.candidates(full.select("node", "sketch", "bands"), BANDS, "doc", block, often, most)
    near = materialize(close.union(far).distinct(), "doc-both")
    release(close, far)
    wanted = materialize(nodes.join(near.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("th"), "doc-wanted")
    found = buckets.filtered(texts.select("text", "th"), "th", buckets.bloom(wanted, "th"), True)
    found = found.join(wanted, "th", "left_semi").dropDuplicates(["th"]).select("text")
    sets = mapped(found, _sets(shingle), "id long, own binary", "doc-sets")
    pairs = near.join(sets, "id").select("part", "id", "own")
    roots = components(pairs.repartition("part").sortWithinPartitions("part").mapInArrow(slim(_verify), EDGES), "docs")
    release(near, wanted, sets)
    return roots


def keep_one(docs: DataFrame, shingle: int = SHINGLE, block: int = buckets.BLOCK, often: int = buckets.OFTEN, most: int = PART) -> DataFrame:
    """``docs`` with one row of each group of documents linked at a Jaccard similarity of SIMILARITY or more: that of the smallest doc_id.

    Null and wordless texts are one group. Rows whose group has no doc_id at all
    keep one row per distinct text. Repeats of the same doc_id and text count as
    one document. Other columns stay, whatever their names; an empty table gives
    no rows.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").alias("doc"), text_hash().alias("th"), text.alias("text"))
    met = _signed(texts, shingle)
    nodes = materialize(met.groupBy("node").agg(F.min("doc").alias("rep"), F.min("th").alias("th"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("bands").alias("bands")), "doc-nodes")
    roots = _roots(texts, nodes, shingle, block, often, most)
    rooted = materialize(nodes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root")), "doc-rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("rep").alias("first")), "doc-least")
    named = materialize(rooted.join(least, "root").select("node", "first"), "doc-named")
    gone = met.select("doc", "th", "node").join(named, "node").where(~F.col("doc").eqNullSafe(F.col("first"))).select("doc", "th")
    gone = materialize(gone, "doc-gone")
    release(nodes, rooted, least, named)
    return without(docs, gone, met.select("doc", "th"))
