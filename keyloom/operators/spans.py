"""Record spans, blocks, and the pieces of records in blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keyloom.operators.prefix import div, neighbour, running_start


def record_spans(entries: DataFrame, payload: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``*by, ordinal, key, record_start, record_end, len`` of records laid end to end in ordinal order."""
    size = F.octet_length(F.col(payload)).cast("long")
    rows = running_start(entries.withColumn("len", size), F.col("len"), by=by, out="record_start")
    return rows.select(*by, "ordinal", "key", "record_start", (F.col("record_start") + F.col("len")).alias("record_end"), "len")


def record_ends(keys: DataFrame, total: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` (ordinal, record_start) with ``record_end``: the next start, and the stream's length for the last."""
    return neighbour(keys, "record_start", "record_end", default=F.lit(total).cast("long"), by=by)


def span_violations(spans: DataFrame, total: int) -> DataFrame:
    """Spans that end before they start or beyond the stream."""
    return spans.where((F.col("record_start") > F.col("record_end")) | (F.col("record_end") > total) | (F.col("record_start") < 0))


def chunks(spans: DataFrame, block: int) -> DataFrame:
    """``ordinal, chunk, block, block_from, block_to``: a record's piece of every fixed-size block it crosses; none for an empty one."""
    first, last = div("record_start", block), div(F.col("record_end") - 1, block)
    full = spans.where("record_end > record_start")
    rows = full.select("ordinal", "record_start", "record_end", F.posexplode(F.sequence(first, last)).alias("chunk", "block"))
    lo, hi = F.col("block") * block, (F.col("block") + 1) * block
    return rows.select(
        "ordinal", F.col("chunk").cast("long").alias("chunk"), "block",
        (F.greatest("record_start", lo) - lo).alias("block_from"), (F.least("record_end", hi) - lo).alias("block_to"),
    )


def chunks_of(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """The same for blocks of any sizes (block, decomp_offset, decomp_size).

    The block table is cut into pages of the stream first, so the overlap is an
    equality join on pages and not a comparison of every span with every block.
    """
    page = 1 << 20
    span_pages = spans.where("record_end > record_start").withColumn("_p", F.explode(F.sequence(div("record_start", page), div(F.col("record_end") - 1, page))))
    own = blocks.where("decomp_size > 0").withColumn("_end", F.col("decomp_offset") + F.col("decomp_size"))
    block_pages = own.withColumn("_p", F.explode(F.sequence(div("decomp_offset", page), div(F.col("_end") - 1, page))))
    lo, hi = F.greatest("record_start", "decomp_offset"), F.least("record_end", "_end")
    hit = span_pages.join(block_pages, "_p").where(lo < hi).where(div(lo, page) == F.col("_p"))
    return hit.select("ordinal", "block", (lo - F.col("decomp_offset")).alias("block_from"), (hi - F.col("decomp_offset")).alias("block_to"))


def assemble(pieces: DataFrame) -> DataFrame:
    """``ordinal, payload``: pieces (ordinal, chunk, data) concatenated in order."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", "data")))
    return pieces.groupBy("ordinal").agg(F.concat_ws("", F.transform(ordered, lambda x: x["data"])).alias("payload"))


def record_blocks(spans: DataFrame, block: int) -> DataFrame:
    """``block, entries, first_ordinal, last_ordinal``: the records that start in each block."""
    return spans.groupBy(div("record_start", block).alias("block")).agg(
        F.count("*").alias("entries"), F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.sum("len").alias("decomp_size")
    )


def key_blocks(keys: DataFrame, rows: int) -> DataFrame:
    """``block, entry_start, entry_count, first_key, last_key`` of blocks of ``rows`` keys."""
    return keys.groupBy(div("ordinal", rows).alias("block")).agg(
        F.min("ordinal").alias("entry_start"), F.count("*").alias("entry_count"),
        F.min_by("key", "ordinal").alias("first_key"), F.max_by("key", "ordinal").alias("last_key"),
    )


def block_of(probes: DataFrame, blocks: DataFrame, value: str, start: str, count: str) -> DataFrame:
    """Each probe with the block whose [start, start + count) holds ``value``; absent where none does.

    The nearest block start at or before a value is carried forward over the
    union of both sides, bucket by bucket; blocks are few, probes are not.
    """
    page = 1 << 16
    own = blocks.where(F.col(count) > 0).withColumn("_to", F.col(start) + F.col(count))
    paged = own.withColumn("_p", F.explode(F.sequence(div(start, page), div(F.col("_to") - 1, page))))
    return probes.withColumn("_p", div(value, page)).join(paged, "_p").where((F.col(value) >= F.col(start)) & (F.col(value) < F.col("_to"))).drop("_p", "_to")
