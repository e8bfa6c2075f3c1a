"""Integrity checks, groups, digests, percentiles and tallies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from keyloom.operators.prefix import div, neighbour, numbered, running_total


def contiguity_violations(keys: DataFrame) -> DataFrame:
    """One row ``violations``: ordinals that don't follow the one before, the first being 0."""
    rows = neighbour(keys, "ordinal", "_previous", ahead=False, default=F.lit(-1).cast("long"))
    return rows.agg(F.count_if(F.col("ordinal") != F.col("_previous") + 1).alias("violations"))


def monotonic_violations(keys: DataFrame, start: str = "record_start") -> DataFrame:
    """One row ``violations``: starts below the start before."""
    rows = neighbour(keys, start, "_previous", ahead=False)
    return rows.agg(F.count_if(F.col(start) < F.col("_previous")).alias("violations"))


def section_violations(sections: DataFrame, by: tuple[str, ...] = ("dict_id",)) -> DataFrame:
    """Sections (*by, position, start, end) that don't begin where the one before, of the same container, ends."""
    before = F.lag("end").over(W.partitionBy(*by).orderBy("position"))
    return sections.withColumn("_before", before).where(F.col("_before").isNotNull() & (F.col("start") != F.col("_before")))


def duplicate_groups(keys: DataFrame) -> DataFrame:
    """One row ``entries, distinct_keys, duplicate_groups, duplicate_rows``."""
    groups = keys.groupBy("key").count()
    return groups.agg(
        F.sum("count").alias("entries"), F.count("*").alias("distinct_keys"), F.count_if(F.col("count") > 1).alias("duplicate_groups"),
        F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias("duplicate_rows"),
    )


def ordinals_by_key(keys: DataFrame) -> DataFrame:
    """``key, ordinals``: ascending, comma-joined."""
    return keys.groupBy("key").agg(F.array_join(F.sort_array(F.collect_list("ordinal")), ",").alias("ordinals"))


def first_of_group(keys: DataFrame) -> DataFrame:
    """``key, ordinal, group_size``: the lowest row of each key."""
    return keys.groupBy("key").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("group_size"))


def group_violations(keys: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``*by, key, ordinal, group_size``: lowest rows of keys whose looked-up group differs from the rows that have the key.

    ``keys``: *by, ordinal, key, norm_key. The first member of a duplicate group
    stands for all: a lookup of its key must give that many rows, the first of
    them its own.
    """
    groups = keys.groupBy(*by, "key").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("group_size"), F.first("norm_key").alias("norm_key"))
    found = groups.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("key").alias("_key"), F.col("norm_key").alias("_norm"))
    same = F.col("_norm") == F.col("norm_key")
    for c in by:
        same = same & (F.col(f"_{c}") == F.col(c))
    hits = found.join(keys, same).where(F.col("key") == F.col("_key")).groupBy(*[f"_{c}" for c in by], "_key").agg(F.min("ordinal").alias("_first"), F.count("*").alias("_n"))
    cond = F.col("key") == F.col("_key")
    for c in by:
        cond = cond & (F.col(f"_{c}") == F.col(c))
    wrong = F.col("_n").isNull() | (F.col("_n") != F.col("group_size")) | (F.col("_first") != F.col("ordinal"))
    return groups.join(hits, cond, "left").where(wrong).select(*by, "key", "ordinal", "group_size")


CHUNK = 1 << 20  #: characters of lines that are handed on as one row


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one partition, in its order, as rows (part, no, data) of about CHUNK characters."""
    from pyspark import TaskContext

    part, no, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int64()), pa.array(["".join(held)])], ["part", "no", "data"])

    for b in batches:
        for line in b.column(0).to_pylist():
            held.append(line + "\n")
            size += len(line) + 1
            if size >= CHUNK:
                yield row()
                no, held, size = no + 1, [], 0
    if held:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256()
    for b in batches:
        for data in b.column(2).to_pylist():
            sha.update(data.encode())
    yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest()])], ["digest"])


def set_digest(rows: DataFrame, line: Column, order: Column | None = None) -> DataFrame:
    """One row ``digest``: SHA-256 of the lines by ``order`` (their own, if not given), each ended by a line break.

    The lines are sorted and joined in parallel; one task then reads the joined
    pieces in order, a piece at a time, as the digest's definition asks for.
    """
    lines = rows.select((line if order is None else order).alias("_o"), line.alias("_l"))
    ranged = lines.repartitionByRange("_o", "_l").sortWithinPartitions("_o", "_l").select("_l")
    pieces = ranged.mapInArrow(_joined, "part int, no long, data string")
    start = rows.sparkSession.createDataFrame([(-1, 0, "")], "part int, no long, data string")  # so that no rows have a digest too
    return pieces.union(start).repartition(1).sortWithinPartitions("part", "no").mapInArrow(_hashed, "digest string")


def digest_tree(rows: DataFrame, order: list[Column], line: Column, leaf: int = 4096) -> DataFrame:
    """One row ``digest`` of any number of rows: a tree of SHA-256.

    A leaf is the digest of ``leaf`` lines in order, joined by line breaks; a
    node is that of the digests of ``leaf`` nodes below, joined. There is one
    level of nodes at least, and as many as lead to one root, so no row gathers
    more than ``leaf`` others.
    """
    at = numbered(rows.withColumn("_line", line), order, "_place").select("_place", F.col("_line").alias("_text"))
    n = at.count()

    def level(nodes: DataFrame, sep: str) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct("_place", "_text")))
        return nodes.groupBy(div("_place", leaf).alias("_up")).agg(F.sha2(F.array_join(F.transform(own, lambda x: x["_text"]), sep), 256).alias("_text")).withColumnRenamed("_up", "_place")

    nodes, left = level(at, "\n"), -(-n // leaf)
    while True:
        nodes, left = level(nodes, ""), -(-left // leaf)
        if left <= 1:
            return nodes.select(F.col("_text").alias("digest"))


def ordered_digest(rows: Iterator[tuple], with_payload: bool) -> tuple[str, str | None]:
    """Key and payload digests of (ordinal, key, payload) in ordinal order.

    Keys: ordinal and length as 64-bit big-endian integers, then the key's
    UTF-8. Payloads: the key part, then length and bytes of the payload.
    Streams from ``DataFrame.toLocalIterator``; nothing is held.
    """
    keys, payloads = hashlib.sha256(), hashlib.sha256()
    for ordinal, key, *rest in rows:
        data = key.encode()
        part = ordinal.to_bytes(8, "big") + len(data).to_bytes(8, "big") + data
        keys.update(part)
        if with_payload:
            body = rest[0].encode() if isinstance(rest[0], str) else bytes(rest[0])
            payloads.update(part + len(body).to_bytes(8, "big") + body)
    return keys.hexdigest(), payloads.hexdigest() if with_payload else None


def line_digest(rows: Iterator[tuple], kind: str) -> tuple[str, str]:
    """Version-1 protocol digests of (key, payload): keys and texts each ended by a line break; resources by their own digests."""
    keys, payloads = hashlib.sha256(), hashlib.sha256()
    for key, payload in rows:
        keys.update(key.encode() + b"\n")
        payloads.update(payload.encode() + b"\n" if kind == "mdx" else hashlib.sha256(payload).digest())
    return keys.hexdigest(), payloads.hexdigest()


def payload_bytes(entries: DataFrame, payload: str) -> DataFrame:
    return entries.agg(F.sum(F.octet_length(payload).cast("long")).alias("payload_bytes"), F.count("*").alias("entries"))


def percentiles(values: DataFrame, value: str, by: tuple[str, ...] = (), ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """``*by, n, p50, ...``: nearest-rank lower percentiles, the (n - 1) * p div 100-th value from 0.

    Ranks come from counts of distinct values, summed over range partitions, so
    neither equal values nor a group of all rows land in one task.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranked = running_total(counts, [F.col(value)], "_c", by, "_hi").withColumn("_lo", F.col("_hi") - F.col("_c"))
    totals = ranked.groupBy(*by).agg(F.max("_hi").alias("_n")).select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(by)], "_n")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_t{i}"))
    placed = ranked.join(F.broadcast(totals) if not by else totals, same)  # without groups, one row
    at = {p: F.expr(f"(_n - 1) * {p} div 100") for p in ps}
    pick = [F.max(F.when((k >= F.col("_lo")) & (k < F.col("_hi")), F.col(value))).alias(f"p{p}") for p, k in at.items()]
    return placed.groupBy(*by).agg(F.max("_n").alias("n"), *pick)


def tally(rows: DataFrame, by: Column | str, out: str = "value") -> DataFrame:
    """``out, count``, most frequent first, ties by value."""
    named = by if isinstance(by, Column) else F.col(by)
    return rows.groupBy(named.alias(out)).count().orderBy(F.desc("count"), out)


def agreement(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row of the four counts of two yes-or-no observers."""
    return rows.agg(
        F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("first_only"), F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither")
    )


def memory_estimate(keys: DataFrame) -> DataFrame:
    """One row: bytes of a compact lookup index (text, bounds, order, digests) by the keys' normal forms."""
    sums = keys.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length("norm_key").cast("long")), F.lit(0)).alias("text_bytes"))
    return sums.withColumns({"bounds_bytes": 4 * (F.col("entries") + 1), "order_bytes": 4 * F.col("entries"), "digest_bytes": 4 * F.col("entries")}).withColumn(
        "locator_bytes", F.col("text_bytes") + F.col("bounds_bytes") + F.col("order_bytes") + F.col("digest_bytes")
    )


def locator_violations(keys: DataFrame, entries: int, size: int) -> DataFrame:
    """Ceilings that a lookup index of the keys would break: ``limit, value, max``."""
    found = memory_estimate(keys)
    rows = F.array(*[F.struct(F.lit(name).alias("limit"), F.col(column).cast("long").alias("value"), F.lit(most).cast("long").alias("max")) for name, column, most in (("locator_entries", "entries", entries), ("locator_bytes", "locator_bytes", size))])
    return found.select(F.explode(rows).alias("x")).select("x.*").where("value > max")
