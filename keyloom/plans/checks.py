"""Registered queries of the catalogue's rules, and their SQL.

Documents of the catalogue are made of ``documents``: faults are planted by
changing values of derived columns, so every row is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keyloom.functions import keys as K
from keyloom.plans import catalogue, rules
from keyloom.plans.registry import register, table

_SHA = "a" * 64


def _broken(source: str, keys: str, named: dict[str, str]) -> str:
    """SQL of a row for each condition that holds."""
    hits = ", ".join(f"case when {cond} then '{name}' end" for name, cond in named.items())
    return f"select {keys}, unnest(list_filter([{hits}], lambda x: x is not null)) as violation from ({source})"


def _pick(by: int, *values: str | None) -> Column:
    """The value at ``doc_id % by`` of those given, the last one for the rest."""
    out = F.lit(values[-1])
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(F.col("doc_id") % by == i, F.lit(v)).otherwise(out)
    return out.cast("string")


def _sql_pick(by: int, *values: str | None) -> str:
    say = lambda v: "null" if v is None else f"'{v}'"
    return f"case doc_id % {by} " + " ".join(f"when {i} then {say(v)}" for i, v in enumerate(values[:-1])) + f" else {say(values[-1])} end"


_REVIEW = {
    "status": (4, "approved", "pending", "rejected", "drafted"), "license": (7, "Unknown", " unverified ", "", "MIT"), "licenseUrl": (9, None, "ftp://x.example/", "https://licenses.example/mit"),
    "reviewedBy": (6, None, " ", "someone"), "reviewedAt": (8, None, "nope", "2026-01-01T00:00:00Z"), "notes": (10, None, " ", "fine"),
}
_REVIEW_ROWS = "select doc_id, doc_id % 3 <> 0 as testing, doc_id % 5 = 0 as redistribution, " + ", ".join(f"{_sql_pick(*v)} as {k}" for k, v in _REVIEW.items()) + " from documents"


@register(_broken(_REVIEW_ROWS, "doc_id", {
    "unknown status": "status not in ('approved', 'pending', 'rejected')",
    "no license": "trim(license) = ''",
    "malformed license url": "licenseUrl like 'ftp%'",
    "empty reviewer": "trim(reviewedBy) = ''",
    "bad review time": "reviewedAt = 'nope'",
    "no notes": "notes is null",
    "approved without testing": "status = 'approved' and not testing",
    "approved without reviewer, time or notes": "status = 'approved' and (reviewedBy is null or reviewedAt is null or coalesce(trim(notes), '') = '')",
    "testing before approval": "status <> 'approved' and testing",
    "redistribution without license": "redistribution and (licenseUrl is null or lower(trim(license)) in ('unknown', 'unverified'))",
}))
def review_violations(spark: SparkSession, d: str) -> DataFrame:
    said = [_pick(*v).alias(k) for k, v in _REVIEW.items()]
    review = F.struct((F.col("doc_id") % 3 != 0).alias("testingAllowed"), (F.col("doc_id") % 5 == 0).alias("redistributionAllowed"), *said)
    found = table(spark, d, "documents").select("doc_id", review.alias("review"))
    return catalogue.review_violations(found).select("doc_id", "violation")


_LOCK = {
    "kind": (11, "zip", "mdx"), "resolvedUrl": (12, "https://b.example/x", "https://10.0.0.1/x", "https://A.example:443/y"), "path": (13, "../x.mdx", "/x.mdx", None), "sha256": (14, "AB", None, _SHA),
    "entryCountBasis": (15, "guess", "publisher", rules.OBSERVED), "keySha256": (16, None, "x", _SHA), "payloadSha256": (17, None, _SHA), "logicalDigestBasis": (18, "guess", None, "independent"), "logicalObservation": (19, None, "o"),
}
_LOCK_ROWS = (
    "select doc_id, case when doc_id % 20 = 0 then 0 else n_chars end as bytes, case when doc_id % 21 = 0 then null else 7 end as expected, case when doc_id % 22 = 0 then 6 else 7 end as observed, "
    + ", ".join(f"{_sql_pick(*v)} as {k}" for k, v in _LOCK.items() if k != "path")
    + f", coalesce({_sql_pick(*_LOCK['path'])}, 'selected/' || (doc_id // 2) || '.mdx') as path, 's/' || doc_id as source_path from documents"
)
_HEX = "regexp_matches({0}, '^[0-9a-f]{{64}}$')"


@register(_broken(_LOCK_ROWS, "path, source_path", {
    "unknown kind": "kind <> 'mdx'",
    "bad path": "path in ('../x.mdx', '/x.mdx') or kind <> 'mdx'",
    "resolved url not allowed": "resolvedUrl like 'https://10%'",
    "resolved on another origin": "resolvedUrl not like 'https://A%'",
    "bytes out of range": "bytes < 1",
    "malformed digest": f"not coalesce({_HEX.format('sha256')}, false)",
    "entries out of range": "expected is null",
    "unknown basis of the count": "entryCountBasis = 'guess'",
    "malformed logical digest": f"not {_HEX.format('keySha256')} or not {_HEX.format('payloadSha256')}",
    "unknown basis of the digests": "logicalDigestBasis = 'guess'",
    "one digest without the other": "(keySha256 is null) <> (payloadSha256 is null)",
    "basis without both digests": "logicalDigestBasis is not null and (keySha256 is null or payloadSha256 is null)",
    "digests without a basis": "keySha256 is not null and payloadSha256 is not null and logicalDigestBasis is null",
    "basis and observation don''t go together": "(logicalDigestBasis is null) <> (logicalObservation is null)",
    "own count differs from the expected one": f"entryCountBasis = '{rules.OBSERVED}' and observed is distinct from expected",
}) + f" union all select path, source_path, 'repeated path' from ({_LOCK_ROWS}) where path in (select path from ({_LOCK_ROWS}) group by 1 having count(*) > 1)")
def lock_violations(spark: SparkSession, d: str) -> DataFrame:
    observer = F.struct(F.lit(1).cast("long").alias("binaryBytes"), F.lit(_SHA).alias("binarySha256"), F.lit(rules.OBSERVER_MODE).alias("mode"), F.lit(1).cast("long").alias("timeoutMs"), F.lit("t").alias("tool"), F.lit("1").alias("version"))
    own = {k: _pick(*v) for k, v in _LOCK.items()}
    half = F.concat(F.lit("selected/"), F.expr("doc_id div 2").cast("string"), F.lit(".mdx"))
    own |= {
        "path": F.coalesce(own["path"], half), "sourcePath": F.concat(F.lit("s/"), F.col("doc_id").cast("string")), "url": F.lit("https://a.example/x"),
        "bytes": F.when(F.col("doc_id") % 20 == 0, 0).otherwise(F.col("n_chars")).cast("long"), "expectedEntries": F.when(F.col("doc_id") % 21 != 0, 7).cast("long"),
        "observedEntries": F.when(F.col("doc_id") % 22 == 0, 6).otherwise(7).cast("long"), "observation": F.lit("o"), "observationError": F.lit(None).cast("string"), "observer": observer,
    }
    artifacts = table(spark, d, "documents").select(*[v.alias(k) for k, v in own.items()])
    rows = artifacts.select(F.lit(None).cast("string").alias("id"), "path", "sourcePath", F.struct(*artifacts.columns).alias("a"))
    found = rules.broken(rows, rules.locked(F.col("a")), keep=["path", "sourcePath"])
    again = rows.groupBy("path").count().where("count > 1").select("path")
    return found.union(rows.join(again, "path", "left_semi").select("path", "sourcePath", F.lit("repeated path"))).toDF("path", "source_path", "violation")


@register("with a as (select doc_id::varchar as path, n_chars::bigint as bytes, sha256(text) as sha from documents), h as (select doc_id::varchar as path, n_chars::bigint as length, case when doc_id % 4 = 0 then 'other' else sha256(text) end as sha from documents where doc_id % 3 <> 0) select a.path, bytes, case when bytes > 20000 then 'refuse' when h.length = bytes and h.sha = a.sha then 'reuse' else 'fetch' end as action from a left join h on h.path = a.path")
def sync_actions(spark: SparkSession, d: str) -> DataFrame:
    """A third of the files isn't there, and a quarter of the others has other bytes."""
    t = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"), "doc_id")
    here = t.where("doc_id % 3 <> 0").select("path", F.col("bytes").alias("length"), F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("sha256")).alias("sha"))
    return catalogue.sync_plan(t, here, 20_000, 1 << 62)


_CLASSES = ("Io", "Truncated", "ChecksumMismatch", "LimitExceeded", "AllocationFailed", "MissingPasscode", "InvalidPasscode", "InvalidFormat", "Decode", "Unsupported", "InvalidData", "Other")
_ABOUT = ("key", "record", "generated engine version", "encoding x", "is encrypted", "zlib stream", "LZO stream", "geometry")


@register(f"with e as (select doc_id, {_sql_pick(len(_CLASSES), *_CLASSES)} as class, {_sql_pick(len(_ABOUT) + 5, *_ABOUT)} as about from documents) select doc_id, case when class = 'Decode' then case when about like '%key%' then 'key-decode' else 'record-decode' end when class = 'Unsupported' then case when about like '%engine%' then 'unsupported-version' when about like '%encoding%' then 'unsupported-encoding' when about like '%encrypt%' then 'unsupported-encryption' else 'unsupported-compression' end when class = 'InvalidData' then case when about ilike '%zlib%' or about ilike '%lzo%' then 'compression-failure' else 'invalid-geometry' end when class = 'Io' then 'io' when class = 'Truncated' then 'truncated' when class = 'ChecksumMismatch' then 'checksum-mismatch' when class = 'LimitExceeded' then 'limit-exceeded' when class = 'AllocationFailed' then 'allocation-failed' when class in ('MissingPasscode', 'InvalidPasscode') then 'passcode-required' when class = 'InvalidFormat' then 'invalid-geometry' else 'unclassified' end as category from e")
def error_categories(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.select("doc_id", catalogue.error_category(_pick(len(_CLASSES), *_CLASSES), _pick(len(_ABOUT) + 5, *_ABOUT)).alias("category"))


@register("select doc_id, replace(replace(replace(source, 'src1', '<one>'), 'src2', '<two>') || '/' || lang, 'src3/' || lang, '<three>') as message from documents")
def redacted_paths(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics without local roots; the longest root is replaced first."""
    t = table(spark, d, "documents")
    one = F.concat_ws("/", "source", "lang")
    return t.select("doc_id", K.redact(one, {"src1": "<one>", "src2": "<two>"} | {f"src3/{x}": "<three>" for x in ("en", "de", "fr", "es")}).alias("message"))


@register("select count(*)::bigint as artifacts, count_if(doc_id % 3 = 0)::bigint as self_observed, count_if(doc_id % 4 = 0 or doc_id % 5 = 0)::bigint as without_digests from documents")
def verify_notices(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    at = lambda n: F.when(F.col("doc_id") % n != 0, _SHA)
    return catalogue.verify_notices(t.select(_pick(3, rules.OBSERVED, "publisher").alias("entryCountBasis"), at(4).alias("keySha256"), at(5).alias("payloadSha256")))


@register("with a as (select doc_id, case when doc_id % 2 = 0 then 'mdx' else 'mdd' end as kind, source || '/' || doc_id as path from documents) select doc_id, kind, path from a where kind = 'mdx' and contains(path, 'c1')")
def selected_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of one kind with a needle in their path: here the filters are what is asked for."""
    t = table(spark, d, "documents").select("doc_id", _pick(2, "mdx", "mdd").alias("kind"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return catalogue.with_path(catalogue.of_kind(t, "mdx"), "c1")


@register("with l as (select doc_id::varchar as path, doc_id % 7 as n, case when doc_id % 11 = 0 then 'x' else sha256(text) end as k from documents), a as (select case when doc_id % 13 = 0 then 'new/' || doc_id else doc_id::varchar end as path, case when doc_id % 5 = 0 then 99 else doc_id % 7 end as n, sha256(text) as k, doc_id % 17 as o from documents), j as (select coalesce(l.path, a.path) as path, l.path as lp, a.path as ap, l.n as ln, a.n as an, l.k as lk, a.k as ak, a.o from l full join a on l.path = a.path) select path, unnest(list_filter([case when ap is null then 'not in the audit' end, case when lp is null then 'not in the lock' end, case when ap is null or o = 1 then 'no outcome' end, case when o = 2 then 'audit failed' end, case when lp is not null and ap is not null and ln <> an then 'another number of entries' end, case when lp is not null and ap is not null and lk <> ak then 'digests of the lock differ' end, case when o = 3 then 'audit differs from its outcome' end], lambda x: x is not null)) as violation from j")
def baseline_violations(spark: SparkSession, d: str) -> DataFrame:
    """A lock, an audit and its outcomes with other paths, counts, digests and failures."""
    t = table(spark, d, "documents").withColumns({"p": F.col("doc_id").cast("string"), "n": F.col("doc_id") % 7, "k": F.sha2("text", 256)})
    lock = t.select(F.col("p").alias("path"), F.lit("mdx").alias("kind"), F.col("n").alias("expectedEntries"), F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("k")).alias("keySha256"), F.col("k").alias("payloadSha256"))
    path = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("new/"), "p")).otherwise(F.col("p"))
    audit = t.select(path.alias("path"), F.lit("mdx").alias("kind"), F.when(F.col("doc_id") % 5 == 0, 99).otherwise(F.col("n")).alias("entries"), F.col("k").alias("key_sha256"), F.col("k").alias("payload_sha256"), "doc_id")
    o = F.col("doc_id") % 17
    outcomes = audit.where(o != 1).select("path", F.when(o == 2, "failed").otherwise("passed").alias("status"), F.when(o == 3, F.col("entries") + 1).otherwise(F.col("entries")).alias("entries"), "key_sha256", "payload_sha256")
    return catalogue.baseline_violations(lock, audit.drop("doc_id"), outcomes)
