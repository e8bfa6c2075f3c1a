"""Registered queries over real containers, and their SQL.

CUST (customer: name -> segment and address, as text) and PAGES (pages: path ->
html, as resources) are written as containers of both wire versions in the
shared folder, several files each, once for a session and folder of tables;
what the queries return is read back from the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keyloom.operators import audit, locate, spans
from keyloom.operators.prefix import numbered
from keyloom.operators.stored import fresh_path, materialize
from keyloom.plans import artifacts
from keyloom.plans.registry import register, table
from keyloom.sources import dictionary, sinks
from keyloom.sources.wire.crypto import Passcode
from keyloom.sources.wire.writer import Style

ROWS = 400  #: of a file: several files even of small tables
CODE, USER = "00112233445566778899aabbccddeeff", "reader@example.com"
STYLES = {
    "v2": Style(2, keys=50, record_bytes=1000, attributes={"Title": "Customers & <more>", "Description": "written from a table"}),
    "v1": Style(1, keys=50, record_bytes=1000, codec="none"),
    "utf16": Style(2, "UTF-16", keys=60, record_bytes=777),
    "gb18030": Style(1, "GB18030", keys=60, record_bytes=777),
    "strip": Style(2, keys=50, record_bytes=1000, attributes={"StripKey": "Yes"}),
    "ciphered": Style(2, keys=50, record_bytes=1000, encrypted=3, passcode=Passcode(CODE, USER)),
}
_written: dict[tuple[str, str, str, str], DataFrame] = {}


def entries(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """``ordinal, key, payload`` of CUST (mdx) or PAGES (mdd)."""
    if kind == "mdx":
        t = table(spark, d, "customer")
        key = F.when(F.col("c_custkey") % 10 == 0, F.upper("c_name")).otherwise(F.col("c_name"))
        rows, order = t.select("c_custkey", key.alias("key"), F.concat_ws("\n", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("payload")), "c_custkey"
    else:
        t = table(spark, d, "pages")
        key = F.concat(F.lit("\\"), F.replace(F.regexp_replace("url", "^https?://", ""), F.lit("/"), F.lit("\\")))
        rows, order = t.select("page_id", key.alias("key"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")), "page_id"
    return numbered(rows, [F.col(order)], "ordinal").select("ordinal", "key", "payload")


_CUST = "select row_number() over (order by c_custkey) - 1 as ordinal, case when c_custkey % 10 = 0 then upper(c_name) else c_name end as key, c_mktsegment || chr(10) || c_nationkey as text from customer"
_PAGES = r"select row_number() over (order by page_id) - 1 as ordinal, '\' || replace(regexp_replace(url, '^https?://', ''), '/', '\') as key, coalesce(html, '') as body from pages"


def files(spark: SparkSession, d: str, kind: str, style: str = "v2") -> DataFrame:
    """``path, first, entries`` of the containers, which are written at the first call."""
    at = (spark.sparkContext.applicationId, d, kind, style)
    if at not in _written:
        _written[at] = materialize(sinks.write_containers(entries(spark, d, kind), fresh_path(spark, f"{kind}-{style}"), kind, ROWS, STYLES[style]), "files")
    return _written[at]


def read(spark: SparkSession, d: str, kind: str, style: str = "v2", **options: str) -> DataFrame:
    """The containers as the data source reads them."""
    dictionary.register(spark)
    paths = ",".join(sorted(r["path"] for r in files(spark, d, kind, style).select("path").collect()))
    own = {"passcode.regcode": CODE, "passcode.userid": USER} if STYLES[style].encrypted & 1 else {}
    return spark.read.format(kind).options(entriesPerPartition="150", **own, **options).load(paths)


def _number() -> Column:
    """The place of a file, from its name."""
    return F.regexp_extract("dict_id", r"part-(\d+)\.", 1).cast("long")


def whole(df: DataFrame) -> DataFrame:
    """Rows of files with the ordinal that they have in all of them together."""
    return df.withColumn("ordinal", _number() * ROWS + F.col("ordinal")).drop("dict_id")


def _keys(spark: SparkSession, d: str, kind: str, style: str = "v2") -> DataFrame:
    """All keys with their normal form, as one dictionary."""
    paths = ",".join(sorted(r["path"] for r in files(spark, d, kind, style).select("path").collect()))
    dictionary.register(spark)
    return whole(dictionary.keys_table(spark, kind, paths))


# scans


@register(f"select ordinal, key from ({_CUST})")
def mdx_key_scan(spark, d):
    return whole(read(spark, d, "mdx", columns="keys"))


@register(f"select ordinal, key, text from ({_CUST})")
def mdx_entry_scan(spark, d):
    return whole(read(spark, d, "mdx")).select("ordinal", "key", "text")


@register(f"select ordinal, key, text from ({_CUST})")
def mdx_entry_scan_version_1(spark, d):
    return whole(read(spark, d, "mdx", "v1")).select("ordinal", "key", "text")


@register(f"select ordinal, key, text from ({_CUST})")
def mdx_entry_scan_utf16(spark, d):
    return whole(read(spark, d, "mdx", "utf16")).select("ordinal", "key", "text")


@register(f"select ordinal, key, text from ({_CUST})")
def mdx_entry_scan_gb18030(spark, d):
    return whole(read(spark, d, "mdx", "gb18030")).select("ordinal", "key", "text")


@register(f"select ordinal, key, text from ({_CUST})")
def mdx_entry_scan_ciphered(spark, d):
    return whole(read(spark, d, "mdx", "ciphered")).select("ordinal", "key", "text")


@register(f"select ordinal, key, sha256(body) as sha256, strlen(body)::bigint as len from ({_PAGES})")
def mdd_resource_scan(spark, d):
    return whole(read(spark, d, "mdd")).select("ordinal", "key", F.sha2("bytes", 256).alias("sha256"), "len")


@register(f"select ordinal, key, sha256(body) as sha256, strlen(body)::bigint as len from ({_PAGES})")
def mdd_resource_scan_version_1(spark, d):
    return whole(read(spark, d, "mdd", "v1")).select("ordinal", "key", F.sha2("bytes", 256).alias("sha256"), "len")


_FILES = f"select ordinal // {ROWS} as file, count(*)::bigint as entries from ({{}}) group by 1"


@register(f"select 'mdx' as kind, file, entries, entries = 0 as is_empty from ({_FILES.format(_CUST)}) union all select 'mdd', file, entries, entries = 0 from ({_FILES.format(_PAGES)})")
def container_lengths(spark, d):
    """Entries by the files' metadata alone: no key or record block is read."""
    one = lambda kind: read(spark, d, kind, table="header").select(F.lit(kind).alias("kind"), _number().alias("file"), "entries", (F.col("entries") == 0).alias("is_empty"))
    return one("mdx").union(one("mdd"))


@register(f"select file, 2 as wire_version, 'Dictionary' as tag_name, '2.0' as engine, 'UTF-8' as encoding_label, false as key_case_sensitive, false as strip_key, 0 as encrypted, 'Customers & <more>' as title, 'written from a table' as description from ({_FILES.format(_CUST)})")
def mdx_headers(spark, d):
    return read(spark, d, "mdx", table="header").select(_number().alias("file"), "wire_version", "tag_name", F.col("generated_by_engine_version").alias("engine"), "encoding_label", "key_case_sensitive", "strip_key", "encrypted", "title", "description")


@register(f"with a(position, name, value) as (values (0, 'GeneratedByEngineVersion', '1.2'), (1, 'RequiredEngineVersion', '1.2'), (2, 'Format', 'Html'), (3, 'Encoding', 'UTF-8')) select file, position, name, value from ({_FILES.format(_CUST)}), a")
def mdx_attributes(spark, d):
    return read(spark, d, "mdx", "v1", table="attributes").select(_number().alias("file"), "position", "name", "value")


# point access


@register(f"select ordinal, key from ({_CUST}) where ordinal % {ROWS} = 137")
def mdx_key_at(spark, d):
    """The same ordinal of every file, by a filter that the source takes: a block of each file is read."""
    own = {"spark.sql.python.filterPushdown.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        found = read(spark, d, "mdx", columns="keys", pushdown="true").where("ordinal = 137")
        found._jdf.queryExecution().executedPlan()  # planned with the setting
        return whole(materialize(found, "key-at"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@register(f"with k as ({_CUST}), p as (select o_orderkey as pos, o_custkey * 2 as ordinal from orders) select pos, p.ordinal, key from p left join k on k.ordinal = p.ordinal")
def mdx_keys_at(spark, d):
    probes = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") * 2).alias("ordinal"))
    return locate.keys_at(probes, whole(read(spark, d, "mdx", columns="keys")))


@register(f"with k as ({_PAGES}), p as (select page_id as pos, page_id * 3 as ordinal from pages) select pos, p.ordinal, key from p left join k on k.ordinal = p.ordinal")
def mdd_keys_at(spark, d):
    probes = table(spark, d, "pages").select(F.col("page_id").alias("pos"), (F.col("page_id") * 3).alias("ordinal"))
    return locate.keys_at(probes, whole(read(spark, d, "mdd", columns="keys")))


@register(f"with k as ({_PAGES}) select k.ordinal, key, strlen(body)::bigint as len, sha256(body) as sha256 from k where ordinal % {ROWS} in (0, 7, 199)")
def mdd_resource_at(spark, d):
    """Resources of some ordinals of every file."""
    return whole(read(spark, d, "mdd").where("ordinal in (0, 7, 199)")).select("ordinal", "key", "len", F.sha2("bytes", 256).alias("sha256"))


_SPANS = "select ordinal, key, (sum(size) over w - size)::bigint as record_start, (sum(size) over w)::bigint as record_end from ({}) window w as (partition by ordinal // {} order by ordinal)"
_CUST_SPANS = _SPANS.format(f"select ordinal, key, strlen(text) as size from ({_CUST})", ROWS)
_PAGE_SPANS = _SPANS.format(f"select ordinal, key, strlen(body) as size from ({_PAGES})", ROWS)


@register(f"select ordinal, key, record_start, record_end from ({_CUST_SPANS})")
def mdx_record_spans(spark, d):
    """Places in each file's decoded stream, read without any record."""
    return whole(read(spark, d, "mdx", columns="spans")).select("ordinal", "key", "record_start", "record_end")


@register(f"select ordinal, key, record_start, record_end from ({_PAGE_SPANS}) where ordinal % {ROWS} in (0, 7, 199)")
def mdd_span_at(spark, d):
    return whole(read(spark, d, "mdd", columns="spans").where("ordinal in (0, 7, 199)")).select("ordinal", "key", "record_start", "record_end")


# lookups

_QUERIES = "select c_custkey as query_id, case when c_custkey % 3 = 0 then lower(c_name) when c_custkey % 3 = 1 then c_name else c_name || '?' end as query from customer"


def _customer_queries(spark: SparkSession, d: str, **flags: bool) -> DataFrame:
    t = table(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 3 == 0, F.lower("c_name")).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(F.concat("c_name", F.lit("?")))
    return locate.batch(t.select(F.col("c_custkey").alias("query_id"), text.alias("query")), **flags)


def _located(norm: str) -> str:
    return f"with k as ({_CUST}), q as ({_QUERIES}), m as (select query_id, ordinal, key = query as raw from q join k on {norm.format('query')} = {norm.format('key')}), f as (select query_id, bool_or(raw) as exact from m group by 1), h as (select m.query_id, ordinal, exact from m join f on f.query_id = m.query_id where raw or not exact) select q.query_id, q.query, any_value(case when exact then 'RawExact' when not exact then 'HeaderNormalized' end) as basis, count(ordinal)::bigint as match_count, min(ordinal) as first_ordinal from q left join h on h.query_id = q.query_id group by 1, 2"


@register(_located("lower({})"))
def mdx_locate(spark, d):
    return locate.matches(_customer_queries(spark, d), _keys(spark, d, "mdx"))


@register(_located("lower(regexp_replace({}, '[\\x00-/:-@\\[-`{{-\\x7f]', '', 'g'))"))
def mdx_locate_stripped(spark, d):
    """The same with containers whose header strips keys."""
    return locate.matches(_customer_queries(spark, d, strip=True), _keys(spark, d, "mdx", "strip"))


@register(rf"with k as ({_PAGES}), q as (select page_id as query_id, '/' || regexp_replace(url, '^https?://', '') as query from pages) select query_id, count(*)::bigint as match_count, min(ordinal) as first_ordinal from q join k on replace(ltrim(query, '/\'), '/', '\') = replace(ltrim(key, '/\'), '/', '\') group by 1")
def mdd_lookup(spark, d):
    t = table(spark, d, "pages").select(F.col("page_id").alias("query_id"), F.concat(F.lit("/"), F.regexp_replace("url", "^https?://", "")).alias("query"))
    found = locate.matches(locate.batch(t, case_sensitive=True, resource_path=True), _keys(spark, d, "mdd"))
    return found.where("match_count > 0").select("query_id", "match_count", "first_ordinal")


@register(f"select ordinal, key from ({_CUST}) where starts_with(lower(key), 'customer#00000001') order by lower(key), ordinal limit 40")
def mdx_prefix_keys(spark, d):
    return locate.prefix_keys(_keys(spark, d, "mdx"), "CUSTOMER#00000001", 40).select("ordinal", "key")


# blocks

_KEYBLOCKS = "select ordinal // {rows} as file, ordinal % {rows} // {keys} as block, min(ordinal % {rows})::bigint as entry_start, count(*)::bigint as entry_count, arg_min(key, ordinal) as first_key, arg_max(key, ordinal) as last_key from ({table}) group by 1, 2"


@register(_KEYBLOCKS.format(rows=ROWS, keys=50, table=_CUST))
def mdx_key_blocks(spark, d):
    """Key blocks as the index has them; entry starts are running sums of the counts."""
    blocks = read(spark, d, "mdx", table="key_blocks")
    return blocks.select(_number().alias("file"), "block", "entry_start", "entry_count", "first_key", "last_key")


@register(f"with s as (select ordinal // {ROWS} as file, max(record_end) as total from ({_CUST_SPANS}) group by 1) select file, unnest(range((total + 999) // 1000)) as block, unnest(range((total + 999) // 1000)) * 1000 as decomp_offset, least(1000, total - unnest(range((total + 999) // 1000)) * 1000)::bigint as decomp_size from s")
def mdx_record_blocks(spark, d):
    """Record blocks as the index has them; places in the stream are running sums of the sizes."""
    return read(spark, d, "mdx", table="record_blocks").select(_number().alias("file"), "block", "decomp_offset", "decomp_size")


@register(f"select ordinal, ordinal % {ROWS} // 50 as block from ({_CUST})")
def mdx_block_of_ordinal(spark, d):
    """The key block of every ordinal, by a join with the blocks' ranges in all files together."""
    blocks = read(spark, d, "mdx", table="key_blocks").select((_number() * 1000 + F.col("block")).alias("block"), (_number() * ROWS + F.col("entry_start")).alias("entry_start"), "entry_count")
    found = locate.block_at(whole(read(spark, d, "mdx", columns="keys")).select("ordinal"), blocks)
    return found.select("ordinal", (F.col("block") % 1000).alias("block"))


@register(f"with s as ({_PAGE_SPANS}), c as (select ordinal, record_start, record_end, unnest(range(record_start // 1000, (record_end - 1) // 1000 + 1)) as block from s where record_end > record_start) select ordinal, block, (greatest(record_start, block * 1000) - block * 1000)::bigint as block_from, (least(record_end, (block + 1) * 1000) - block * 1000)::bigint as block_to from c")
def mdd_span_chunks(spark, d):
    """Pieces of every resource in the record blocks that it crosses; files lie end to end, a gap apart."""
    gap = 1 << 40
    rows = read(spark, d, "mdd", columns="spans").withColumn("_at", _number() * gap)
    own = whole(rows).select("ordinal", (F.col("record_start") + F.col("_at")).alias("record_start"), (F.col("record_end") + F.col("_at")).alias("record_end"))
    blocks = read(spark, d, "mdd", table="record_blocks").select((_number() * gap + F.col("block")).alias("block"), (F.col("decomp_offset") + _number() * gap).alias("decomp_offset"), "decomp_size")
    found = spans.chunks_of(own, blocks)
    return found.select("ordinal", (F.col("block") % gap).alias("block"), "block_from", "block_to")


@register(f"select 0::bigint as violations, count(*)::bigint as sections from ({_FILES.format(_CUST)}), range(7)")
def mdx_section_violations(spark, d):
    sections = read(spark, d, "mdx", table="sections")
    return audit.section_violations(sections).agg(F.count("*").alias("violations")).join(sections.agg(F.count("*").alias("sections")))


# memory, limits, damage


@register(f"with n as (select ordinal // {ROWS} as file, sum(strlen(key)) as bytes, count(*) as n from ({_CUST}) group by 1) select file, (bytes + 12 * n + 4)::bigint as locator_bytes, true as charged from n")
def mdx_memory_usage(spark, d):
    """What an open container is charged with after its first lookup."""
    usage = read(spark, d, "mdx", table="memory", locator="true")
    parts = F.col("metadata_bytes") + F.col("locator_bytes") + F.col("key_cache_bytes") + F.col("record_cache_bytes")
    charged = (F.col("current_bytes") == parts) & (F.col("peak_bytes") >= F.col("current_bytes")) & (F.col("metadata_bytes") > 0)
    return usage.select(_number().alias("file"), "locator_bytes", charged.alias("charged"))


@register(f"with n as (select sum(strlen(lower(key))) + 12 * count(*) + 4 as size, count(*) as n from ({_CUST})) select 'locator_entries' as \"limit\", n::bigint as value, 99::bigint as max from n where n > 99 union all select 'locator_bytes', size::bigint, 999 from n where size > 999")
def mdx_locator_limits(spark, d):
    """Ceilings that a lookup over all files would break, before it is made."""
    return audit.locator_violations(_keys(spark, d, "mdx"), 99, 999)


@register(f"select file, 'LimitExceeded' as error from ({_FILES.format(_CUST)})")
def mdx_limit_errors(spark, d):
    """A ceiling that is too low for the key blocks is an error row of every file."""
    rows = read(spark, d, "mdx", columns="keys", mode="PERMISSIVE", **{"limit.decompressed_block_bytes": "300"})
    return rows.where("_error is not null").select(_number().alias("file"), F.regexp_extract("_error", "^([A-Za-z]+):", 1).alias("error"))


# audits


_ORDERED = "select ordinal // {rows} as file, printf('%016x%016x', ordinal % {rows}, strlen(key)) || hex(encode(key)) as k, printf('%016x', strlen(body)) || hex(encode(body)) as b, ordinal, strlen(body) as size from ({table})"
_DIGESTS = "select file, 'passed' as status, count(*)::bigint as entries, sum(size)::bigint as payload_bytes, 'zlib' as tags, sha256(unhex(string_agg(k, '' order by ordinal))) as key_sha256, sha256(unhex(string_agg(k || b, '' order by ordinal))) as payload_sha256 from ({rows}) group by 1"


def _audited(spark: SparkSession, d: str, kind: str, style: str, protocol: str) -> DataFrame:
    listed = files(spark, d, kind, style).select("path", F.lit(kind).alias("kind"))
    done = artifacts.audit(listed, protocol=protocol)
    return done.select(F.regexp_extract("path", r"part-(\d+)\.", 1).cast("long").alias("file"), "status", "entries", "payload_bytes", "tags", "key_sha256", "payload_sha256")


@register(_DIGESTS.format(rows=_ORDERED.format(rows=ROWS, table=f"select ordinal, key, text as body from ({_CUST})")))
def mdx_audit(spark, d):
    """Every key and record read, looked up, compared and digested, a file to a task."""
    return _audited(spark, d, "mdx", "v2", "ordered")


@register(_DIGESTS.format(rows=_ORDERED.format(rows=ROWS, table=_PAGES)))
def mdd_audit(spark, d):
    return _audited(spark, d, "mdd", "v2", "ordered")


@register(f"select ordinal // {ROWS} as file, 'passed' as status, count(*)::bigint as entries, sum(strlen(text))::bigint as payload_bytes, 'none' as tags, sha256(string_agg(key || chr(10), '' order by ordinal)) as key_sha256, sha256(string_agg(text || chr(10), '' order by ordinal)) as payload_sha256 from ({_CUST}) group by 1")
def mdx_audit_version_1(spark, d):
    """The older protocol of digests, over containers of the older version."""
    return _audited(spark, d, "mdx", "v1", "lines")


@register(f"select ordinal // {ROWS} as file, 'passed' as status, count(*)::bigint as entries, sum(strlen(body))::bigint as payload_bytes, 'none' as tags, sha256(string_agg(key || chr(10), '' order by ordinal)) as key_sha256, sha256(unhex(string_agg(sha256(body), '' order by ordinal))) as payload_sha256 from ({_PAGES}) group by 1")
def mdd_audit_version_1(spark, d):
    return _audited(spark, d, "mdd", "v1", "lines")


@register(f"select ordinal // {ROWS} as file, count(*)::bigint as resources, sum(strlen(body))::bigint as bytes, true as agree from ({_PAGES}) group by 1")
def mdd_streamed_resources(spark, d):
    """Resources copied chunk by chunk against their materialized bytes."""
    listed = files(spark, d, "mdd").select("path")
    return artifacts.streamed(listed).select(F.regexp_extract("path", r"part-(\d+)\.", 1).cast("long").alias("file"), "resources", "bytes", "agree")


@register(f"select ordinal // {ROWS} as file, count(*)::bigint as entries, 0 as problems, 'none' as tags from ({_CUST}) group by 1")
def mdx_version_1_probe(spark, d):
    """The second implementation of version 1's geometry, which shares no code with the reader."""
    listed = files(spark, d, "mdx", "v1").select("path", F.lit("mdx").alias("kind"))
    return artifacts.probe(listed).select(F.regexp_extract("path", r"part-(\d+)\.", 1).cast("long").alias("file"), "entries", F.size("problems").alias("problems"), "tags")


@register(f"with g as (select ordinal // {ROWS} as file, key, count(*) as n from ({_CUST}) group by 1, 2) select file, sum(n)::bigint as entries, count(*)::bigint as distinct_keys, count_if(n > 1)::bigint as duplicate_groups from g group by 1")
def mdx_group_facts(spark, d):
    found = artifacts.group_facts(read(spark, d, "mdx", columns="keys"))
    return found.select(_number().alias("file"), "entries", "distinct_keys", "duplicate_groups")


@register(f"select 0::bigint as violations, count(distinct key)::bigint as groups from ({_CUST})")
def mdx_group_violations(spark, d):
    """Every distinct key looked up: its group is the rows that have it, the lowest first."""
    keys = _keys(spark, d, "mdx")
    return audit.group_violations(keys).agg(F.count("*").alias("violations")).join(keys.agg(F.count_distinct("key").alias("groups")))


@register(f"select sha256(string_agg(ordinal || chr(9) || key, chr(10) order by ordinal) || chr(10)) as digest from ({_CUST})")
def mdx_key_digest(spark, d):
    line = F.concat_ws("\t", F.col("ordinal").cast("string"), "key")
    return audit.set_digest(whole(read(spark, d, "mdx", columns="keys")), line, F.col("ordinal"))


