"""Lookups as joins of a table of queries with a table of keys.

A keys table has ``ordinal, key, norm_key``; a queries table ``query_id, query,
norm_query``. Neither side is hinted: sizes decide, and large sides are shuffled
on the normal form, where adaptive execution splits hot groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from keyloom.functions.keys import norm_key

RAW, NORMALIZED = "RawExact", "HeaderNormalized"


def with_norm(keys: DataFrame, **flags: bool) -> DataFrame:
    """Keys with their normal form; flags as for :func:`norm_key`."""
    return keys.withColumn("norm_key", norm_key(F.col("key"), **flags))


def batch(queries: DataFrame, **flags: bool) -> DataFrame:
    return queries.withColumn("norm_query", norm_key(F.col("query"), **flags))


def locate(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """``query_id, query, basis, ordinal``: a row per match.

    If any key of the query's normal form equals the query as written, only
    such keys match (RawExact); else all of them do (HeaderNormalized). Equal
    texts have equal normal forms, so one join finds both.
    """
    exact = queries.join(keys.select("key"), F.col("query") == F.col("key"), "left_semi").select(F.col("query_id").alias("_raw"))
    known = queries.join(exact.distinct(), F.col("query_id") == F.col("_raw"), "left").withColumn("_raw", F.col("_raw").isNotNull())
    return (
        known.join(keys.select("ordinal", "key", "norm_key"), F.col("norm_query") == F.col("norm_key"))
        .where(~F.col("_raw") | (F.col("key") == F.col("query")))
        .select("query_id", "query", F.when(F.col("_raw"), RAW).otherwise(NORMALIZED).alias("basis"), "ordinal")
    )


def _groups(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """``query_id, basis, match_count, first_ordinal`` of the queries that match: one join, and one aggregation that begins before its shuffle."""
    hits = queries.join(keys.select("ordinal", "key", "norm_key"), F.col("norm_query") == F.col("norm_key"))
    raw = F.when(F.col("key") == F.col("query"), F.col("ordinal"))
    found = hits.groupBy("query_id").agg(F.count(raw).alias("_raws"), F.min(raw).alias("_raw"), F.count("*").alias("_all"), F.min("ordinal").alias("_first"))
    exact = F.col("_raws") > 0
    return found.select("query_id", F.when(exact, RAW).otherwise(NORMALIZED).alias("basis"), F.when(exact, F.col("_raws")).otherwise(F.col("_all")).alias("match_count"), F.when(exact, F.col("_raw")).otherwise(F.col("_first")).alias("first_ordinal"))


def matches(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """``query_id, query, basis, match_count, first_ordinal``: a row per query, nulls and 0 where nothing matches. Query ids are distinct."""
    return queries.select("query_id", "query").join(_groups(queries, keys), "query_id", "left").withColumn("match_count", F.coalesce("match_count", F.lit(0)).cast("long"))


def match_lists(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """``query_id, basis, ordinals``: ascending lists; for batches whose groups fit a row."""
    return locate(queries, keys).groupBy("query_id", "basis").agg(F.sort_array(F.collect_list("ordinal")).alias("ordinals"))


def nth_match(lists: DataFrame, i: int) -> DataFrame:
    """``query_id, ordinal``: the i-th match from 0, null past the end."""
    return lists.select("query_id", F.try_element_at("ordinals", F.lit(i + 1)).alias("ordinal"))


def _firsts(keys: DataFrame, by: str, most: int, out: str) -> DataFrame:
    """``by, out``: the lowest ``most`` ordinals of each value, cut before their shuffle."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.asc_nulls_last("ordinal")))
    ranked = keys.where(F.col(by).isNotNull()).select(by, "ordinal").withColumn("_at", place).where(F.col("_at") <= most)
    return ranked.groupBy(by).agg(F.collect_list("ordinal").alias(out))


def nth(queries: DataFrame, keys: DataFrame, i: int) -> DataFrame:
    """``nth_match(match_lists(queries, keys), i)`` for groups of any size.

    A query meets only the lowest i + 1 ordinals of its text and of its normal
    form, so nothing grows with the queries times the keys of a group. Rows that
    repeat a query_id are one query.
    """
    found = queries.join(_firsts(keys, "key", i + 1, "_raw"), F.col("query") == F.col("key"), "left").join(_firsts(keys, "norm_key", i + 1, "_all"), F.col("norm_query") == F.col("norm_key"), "left")
    lists = found.where("_raw is not null or _all is not null").groupBy("query_id").agg(F.count("_raw").alias("_raws"), F.flatten(F.collect_list("_raw")).alias("_raw"), F.flatten(F.collect_list("_all")).alias("_all"))
    return nth_match(lists.select("query_id", F.sort_array(F.when(F.col("_raws") > 0, F.col("_raw")).otherwise(F.col("_all"))).alias("ordinals")), i)


def records(queries: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (ordinal, ...) for queries (query_id, ordinal); absent where there is no such record."""
    return queries.join(found, "ordinal").select("query_id", "ordinal", *[c for c in found.columns if c != "ordinal"])


def lookup(queries: DataFrame, keys: DataFrame, records: DataFrame) -> DataFrame:
    """Each query's lowest match with its record's columns; queries without a match are absent."""
    return _groups(queries, keys).select("query_id", F.col("first_ordinal").alias("ordinal")).join(records, "ordinal")


def prefix_keys(keys: DataFrame, prefix: str, most: int, **flags: bool) -> DataFrame:
    """The first ``most`` keys whose normal form starts with the prefix's, by (normal form, ordinal)."""
    want = norm_key(F.lit(prefix), **flags)
    hits = keys.where(F.startswith(F.col("norm_key"), want)).orderBy("norm_key", "ordinal")
    return hits.limit(most).select("ordinal", "key", "norm_key")


def keys_at(probes: DataFrame, keys: DataFrame) -> DataFrame:
    """``pos, ordinal, key`` for probes (pos, ordinal): repeats kept, null where out of range."""
    return probes.join(keys.select("ordinal", "key"), "ordinal", "left").select("pos", "ordinal", "key")


def at(table: DataFrame, ordinal: int) -> DataFrame:
    """The row of one ordinal, if there is one."""
    return table.where(F.col("ordinal") == ordinal)


def block_at(probes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``ordinal, block``: the key block of each probed ordinal (probes: ordinal; blocks: block, entry_start, entry_count); absent where out of range."""
    from keyloom.operators.spans import block_of

    return block_of(probes, blocks, "ordinal", "entry_start", "entry_count").select("ordinal", "block")


def sample(table: DataFrame, entries: int) -> DataFrame:
    """First, middle and last row."""
    return table.where(F.col("ordinal").isin(0, entries // 2, entries - 1))
