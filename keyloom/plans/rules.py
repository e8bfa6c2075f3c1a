"""Rules of the catalogue's documents, as tables of violations: empty where all is well.

A rule is a name and a condition that holds for rows that break it; a null
condition is no violation, so rules say what absence means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from keyloom.functions.keys import SAFE_INTEGER, origin, public_https, relative_path_ok
from keyloom.operators import audit

KINDS = ("mdx", "mdd")
SHA256 = "^[0-9a-f]{64}$"
ENTRY_ID = r"^[a-z0-9]([a-z0-9._-]*[a-z0-9])?$"
OBSERVED = "self-observed"  #: basis of counts and digests that this engine found itself
COUNT_BASES = ("independent", "publisher", OBSERVED)
DIGEST_BASES = ("independent", OBSERVED)
OBSERVER_MODE = "metadata-open-and-count"
SOURCE_KIND = "index-inventory-v1"

Rules = dict[str, Column]


def broken(rows: DataFrame, rules: Rules, *, keep: list[str] | None = None) -> DataFrame:
    """A row (``keep``, or all columns) with ``violation`` for each rule that a row breaks."""
    hits = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(*(keep or rows.columns), F.explode(hits).alias("violation"))


def text(c: Column) -> Column:
    """Whether a value is a text that says something."""
    return c.isNotNull() & (F.trim(c) != "")


def lacks(c: Column) -> Column:
    return ~F.coalesce(text(c), F.lit(False))


def number(c: Column, least: int = 0) -> Column:
    """Whether a value is no whole number from ``least`` to the largest that all readers of JSON keep."""
    return ~F.coalesce(c.between(least, SAFE_INTEGER), F.lit(False))


def no_digest(c: Column) -> Column:
    return ~F.coalesce(c.rlike(SHA256), F.lit(False))


def no_time(c: Column) -> Column:
    return F.try_to_timestamp(c).isNull()


def no_web_url(c: Column) -> Column:
    return ~F.coalesce(c.rlike(r"^https?://[^/\s?#]+([/?#]\S*)?$"), F.lit(False))


def review(r: Column) -> Rules:
    approved, known = r["status"] == "approved", r["status"].isin("approved", "pending", "rejected")
    said = F.lower(F.trim(r["license"]))
    return {
        "unknown status": ~F.coalesce(known, F.lit(False)),
        "testing not said": r["testingAllowed"].isNull(),
        "redistribution not said": r["redistributionAllowed"].isNull(),
        "no license": lacks(r["license"]),
        "malformed license url": r["licenseUrl"].isNotNull() & no_web_url(r["licenseUrl"]),
        "empty reviewer": r["reviewedBy"].isNotNull() & lacks(r["reviewedBy"]),
        "bad review time": r["reviewedAt"].isNotNull() & no_time(r["reviewedAt"]),
        "no notes": r["notes"].isNull(),
        "approved without testing": approved & ~F.coalesce(r["testingAllowed"], F.lit(False)),
        "approved without reviewer, time or notes": approved & (r["reviewedBy"].isNull() | r["reviewedAt"].isNull() | lacks(r["notes"])),
        "testing before approval": ~F.coalesce(approved, F.lit(False)) & F.coalesce(r["testingAllowed"], F.lit(False)),
        "redistribution without license": F.coalesce(r["redistributionAllowed"], F.lit(False)) & (r["licenseUrl"].isNull() | F.coalesce(said.isin("unknown", "unverified"), F.lit(False))),
    }


def observer(o: Column) -> Rules:
    """Of who counted; null is nobody, and no violation."""
    rules = {
        "observer without size": number(o["binaryBytes"], 1),
        "observer without digest": no_digest(o["binarySha256"]),
        "observer of another mode": ~F.coalesce(o["mode"] == OBSERVER_MODE, F.lit(False)),
        "observer without timeout": number(o["timeoutMs"], 1),
        "observer without tool or version": lacks(o["tool"]) | lacks(o["version"]),
    }
    return {name: o.isNotNull() & rule for name, rule in rules.items()}


def entry(e: DataFrame) -> Rules:
    """Of an entry's own fields: id, title, infoUrl, artifacts."""
    return {
        "malformed id": ~F.coalesce(F.col("id").rlike(ENTRY_ID), F.lit(False)),
        "no title": lacks(F.col("title")),
        "malformed info url": no_web_url(F.col("infoUrl")),
        "no artifacts": F.coalesce(F.size("artifacts"), F.lit(0)) < 1,
    }


def source(a: Column) -> Rules:
    """Of what every artifact has: kind, where it is from and where it goes."""
    return {
        "unknown kind": ~F.coalesce(a["kind"].isin(*KINDS), F.lit(False)),
        "malformed source path": lacks(a["sourcePath"]) | a["sourcePath"].rlike(r"[\t\r\n\x00]"),
        "url not allowed": ~F.coalesce(public_https(a["url"]), F.lit(False)),
        "bad path": ~F.coalesce(relative_path_ok(a["path"], a["kind"]), F.lit(False)),
    }


def acquired(a: Column) -> Rules:
    """Of an artifact that was fetched: what was got, and who counted it."""
    counted = a["observedEntries"].isNotNull()
    return source(a) | {
        "resolved url not allowed": ~F.coalesce(public_https(a["resolvedUrl"]), F.lit(False)),
        "resolved on another origin": ~F.coalesce(origin(a["url"]) == origin(a["resolvedUrl"]), F.lit(False)),
        "bytes out of range": number(a["bytes"], 1),
        "malformed digest": no_digest(a["sha256"]),
        "observed entries out of range": counted & number(a["observedEntries"]),
        "empty observation": (a["observation"].isNotNull() & lacks(a["observation"])) | (a["observationError"].isNotNull() & lacks(a["observationError"])),
        "count without provenance": counted & (a["observation"].isNull() | a["observationError"].isNotNull() | a["observer"].isNull()),
    } | observer(a["observer"])


def locked(a: Column) -> Rules:
    """Of a lock's artifact: counts and digests with the basis of each."""
    key, payload, basis = a["keySha256"].isNotNull(), a["payloadSha256"].isNotNull(), a["logicalDigestBasis"].isNotNull()
    own = F.coalesce(a["entryCountBasis"] == OBSERVED, F.lit(False))
    return acquired(a) | {
        "entries out of range": number(a["expectedEntries"]),
        "unknown basis of the count": ~F.coalesce(a["entryCountBasis"].isin(*COUNT_BASES), F.lit(False)),
        "malformed logical digest": (key & no_digest(a["keySha256"])) | (payload & no_digest(a["payloadSha256"])),
        "unknown basis of the digests": basis & ~a["logicalDigestBasis"].isin(*DIGEST_BASES),
        "one digest without the other": key != payload,
        "basis without both digests": basis & ~(key & payload),
        "digests without a basis": key & payload & ~basis,
        "basis and observation don't go together": basis != a["logicalObservation"].isNotNull(),
        "own count differs from the expected one": own & ~F.coalesce(a["observedEntries"] == a["expectedEntries"], F.lit(False)),
    }


def drafted(a: Column) -> Rules:
    """Of a draft's artifact, which has no counts or digests to go by yet."""
    early = ("expectedEntries", "entryCountBasis", "keySha256", "payloadSha256", "logicalDigestBasis", "logicalObservation")
    return acquired(a) | {f"{name} in a draft": a[name].isNotNull() for name in early}


def chosen(a: Column, kind: str) -> Rules:
    """Of a selection's artifact, of type ``kind``."""
    return source(a) | {"kind of another selection": ~F.coalesce(a["kind"] == kind, F.lit(False)), "advertised bytes out of range": number(a["advertisedBytes"], 1)}


def selected_source(s: Column) -> Rules:
    """Of the inventory that a selection was made from."""
    return {
        "unknown kind of source": ~F.coalesce(s["kind"] == SOURCE_KIND, F.lit(False)),
        "malformed inventory digest": no_digest(s["inventorySha256"]),
        "malformed set digest": no_digest(s["selectedSetSha256"]),
        "root not allowed": ~F.coalesce(public_https(s["root"]), F.lit(False)),
        "bad snapshot time": no_time(s["snapshotAt"]),
        "unknown selected type": ~F.coalesce(s["selectedType"].isin(*KINDS), F.lit(False)),
        "selected count out of range": number(s["selectedCount"], 1),
        "selected bytes out of range": number(s["selectedAdvertisedBytes"], 1),
    }


def binding(b: Column) -> Rules:
    """Of a draft's tie to the selection that it acquired."""
    s = b["source"]
    return selected_source(s) | {
        "bound counts out of range": number(b["advertisedBytes"], 1) | number(b["artifactCount"], 1) | number(b["entryCount"], 1),
        "malformed bound digest": no_digest(b["artifactSetSha256"]) | no_digest(b["selectionSha256"]),
        "bound bytes differ": b["advertisedBytes"] != s["selectedAdvertisedBytes"],
        "bound count differs": b["artifactCount"] != s["selectedCount"],
        "entries aren't artifacts": b["entryCount"] != b["artifactCount"],
    }


def repeated(rows: DataFrame, key: str, what: str) -> DataFrame:
    """``id, path, violation`` of values that rows share."""
    again = rows.groupBy(key).count().where(f"count > 1 and `{key}` is not null").select(F.col(key).alias("_again"))
    return rows.join(again, F.col(key) == F.col("_again"), "left_semi").select("id", "path", F.lit(f"repeated {what}").alias("violation"))


def _entries(entries: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    """Artifacts of entries (id, title, infoUrl, review, artifacts), and ``id, path, violation`` of both."""
    own = broken(entries, entry(entries) | review(F.col("review")), keep=["id"]).select("id", F.lit(None).cast("string").alias("path"), "violation")
    artifacts = entries.select("id", "review", F.explode_outer("artifacts").alias("a")).where("a is not null").select("id", "review", F.col("a.path").alias("path"), F.col("a.sourcePath").alias("sourcePath"), "a")
    own = own.union(broken(artifacts, rules(F.col("a")), keep=["id", "path"]))
    ids = entries.select("id", F.lit(None).cast("string").alias("path"))
    return artifacts, own.union(repeated(ids, "id", "id")).union(repeated(artifacts, "path", "path")).union(repeated(artifacts, "sourcePath", "source path"))


def lock_violations(entries: DataFrame) -> DataFrame:
    """``id, path, violation`` of a lock's entries."""
    return _entries(entries, locked)[1]


def source_set(artifacts: DataFrame, local: bool = False) -> DataFrame:
    """One row ``digest`` of a set of artifacts (kind, sourcePath, path, advertisedBytes, url), in the order of its lines; ``local``: with their local paths."""
    parts = ["kind", "sourcePath", *(["path"] if local else []), F.col("advertisedBytes").cast("string"), "url"]
    return audit.set_digest(artifacts, F.concat_ws("\t", *parts))


def _bound(artifacts: DataFrame, count: int, size: int, digest: str, local: bool) -> DataFrame:
    """``id, path, violation``: what artifacts differ in from what is said of all of them."""
    said = artifacts.agg(F.count("*").alias("n"), F.coalesce(F.sum("advertisedBytes"), F.lit(0)).alias("size")).join(source_set(artifacts, local))
    rules = {"another number of artifacts": F.col("n") != count, "another sum of bytes": F.col("size") != size, "sum of bytes out of range": F.col("size") > SAFE_INTEGER, "another set of artifacts": F.col("digest") != digest}
    none = F.lit(None).cast("string")
    return broken(said.select(none.alias("id"), none.alias("path"), "n", "size", "digest"), rules, keep=["id", "path"])


def selection_violations(entries: DataFrame, about: dict) -> DataFrame:
    """``id, path, violation`` of a selection's entries; ``about``: its source (see :func:`selected_source`)."""
    spark = entries.sparkSession
    artifacts, own = _entries(entries, lambda a: chosen(a, about["selectedType"]))
    none = F.lit(None).cast("string")
    one = spark.createDataFrame([about], "kind string, inventorySha256 string, root string, snapshotAt string, selectedType string, selectedCount long, selectedAdvertisedBytes long, selectedSetSha256 string")
    head = broken(one.select(none.alias("id"), none.alias("path"), F.struct("*").alias("s")), selected_source(F.col("s")), keep=["id", "path"])
    rest = broken(entries, {"not one artifact": F.coalesce(F.size("artifacts"), F.lit(0)) != 1, "not approved": ~F.coalesce(F.col("review.status") == "approved", F.lit(False))}, keep=["id"]).select("id", none.alias("path"), "violation")
    whole = _bound(artifacts.select("a.*"), about["selectedCount"], about["selectedAdvertisedBytes"], about["selectedSetSha256"], False)
    return own.union(head).union(rest).union(whole)


OUTCOME_FIELDS = ("title", "infoUrl", "kind", "sourcePath", "url", "resolvedUrl", "bytes", "sha256")


def outcome(kind: str) -> Rules:
    """Of an acquisition's outcome (entryId, title, infoUrl, review, kind, sourcePath, path, url, advertisedBytes, status, acquisition, bytes, resolvedUrl, sha256, error)."""
    got, failed = F.col("status") == "acquired", F.col("status") == "acquisition-error"
    facts = F.struct("kind", "sourcePath", "path", "url")
    return source(facts) | review(F.col("review")) | {
        "malformed id": ~F.coalesce(F.col("entryId").rlike(ENTRY_ID), F.lit(False)),
        "no title": lacks(F.col("title")),
        "malformed info url": no_web_url(F.col("infoUrl")),
        "kind of another selection": ~F.coalesce(F.col("kind") == kind, F.lit(False)),
        "advertised bytes out of range": number(F.col("advertisedBytes"), 1),
        "unknown outcome": ~F.coalesce(got | failed, F.lit(False)),
        "acquired in no known way": got & ~F.coalesce(F.col("acquisition").isin("downloaded", "reused"), F.lit(False)),
        "bytes differ from those advertised": got & ~F.coalesce(F.col("bytes") == F.col("advertisedBytes"), F.lit(False)),
        "resolved on another origin": got & ~F.coalesce(public_https(F.col("resolvedUrl")) & (origin(F.col("url")) == origin(F.col("resolvedUrl"))), F.lit(False)),
        "malformed digest": got & no_digest(F.col("sha256")),
        "error of what was acquired": got & F.col("error").isNotNull(),
        "facts of what was not acquired": failed & (F.col("acquisition").isNotNull() | F.col("bytes").isNotNull() | F.col("resolvedUrl").isNotNull() | F.col("sha256").isNotNull()),
        "failure without error": failed & lacks(F.col("error")),
    }


def draft_violations(entries: DataFrame, outcomes: DataFrame, bound: dict) -> DataFrame:
    """``id, path, violation`` of a draft: its entries, its outcomes, how they pair up, and the selection that binds them (``bound``: artifactCount, advertisedBytes, artifactSetSha256, kind)."""
    artifacts, own = _entries(entries, drafted)
    rows = outcomes.withColumn("id", F.col("entryId"))
    facts = broken(rows, outcome(bound["kind"]), keep=["id", "path"])
    again = repeated(rows, "id", "id").union(repeated(rows, "path", "path")).union(repeated(rows, "sourcePath", "source path"))
    named = entries.select(F.col("id").alias("e_id"), "title", "infoUrl", "review")
    left = artifacts.select("id", F.col("path").alias("l_path"), "a").join(named, F.col("id") == F.col("e_id"))
    mine = left.select("l_path", F.struct("id", *[F.col(f) if f in ("title", "infoUrl") else F.col(f"a.{f}") for f in OUTCOME_FIELDS], "review").alias("mine"))
    theirs = rows.select(F.col("path").alias("r_path"), "status", F.struct("id", *OUTCOME_FIELDS, "review").alias("theirs"))
    both = mine.join(theirs, F.col("l_path") == F.col("r_path"), "full_outer")
    got = F.coalesce(F.col("status") == "acquired", F.lit(False))
    pairs = {
        "artifact without outcome": F.col("r_path").isNull(),
        "acquired but not in the draft": got & F.col("l_path").isNull(),
        "in the draft but not acquired": F.col("l_path").isNotNull() & F.col("r_path").isNotNull() & ~got,
        "outcome differs from its artifact": got & F.col("l_path").isNotNull() & ~F.col("mine").eqNullSafe(F.col("theirs")),
    }
    paired = broken(both.select(F.coalesce("mine.id", "theirs.id").alias("id"), F.coalesce("l_path", "r_path").alias("path"), "l_path", "r_path", "status", "mine", "theirs"), pairs, keep=["id", "path"])
    whole = _bound(outcomes, bound["artifactCount"], bound["advertisedBytes"], bound["artifactSetSha256"], True)
    return own.union(facts).union(again).union(paired).union(whole)


def _names(schema, prefix: str = "") -> set[str]:
    if isinstance(schema, ArrayType):
        return _names(schema.elementType, prefix)
    if not isinstance(schema, StructType):
        return set()
    return {x for f in schema for x in {prefix + f.name} | _names(f.dataType, f"{prefix}{f.name}.")}


def unknown_fields(spark: SparkSession, path: str, schema: StructType) -> list[str]:
    """Names of fields, at any depth, that the JSON documents at ``path`` have and the schema hasn't."""
    return sorted(_names(spark.read.option("multiLine", True).json(path).schema) - _names(schema))
