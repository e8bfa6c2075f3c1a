"""The catalogue pipeline as DataFrame plans: inventory, selection, import, promotion, baselines, audits.

A check returns a table of violations, which is empty where all is well.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keyloom.functions.keys import SAFE_INTEGER, canonical_url, classify_url, decoded_path, directory, file_type, html_attribute, stem, url_id
from keyloom.operators import audit
from keyloom.operators.stored import fresh_path, materialize
from keyloom.plans import rules
from keyloom.sources import sinks

INVENTORY = "path string, type string, bytes long, url string, parent string"
REVIEW = "struct<status:string,testingAllowed:boolean,redistributionAllowed:boolean,license:string,licenseUrl:string,reviewedBy:string,reviewedAt:string,notes:string>"
OBSERVER = "struct<binaryBytes:long,binarySha256:string,mode:string,timeoutMs:long,tool:string,version:string>"
ARTIFACT = f"struct<kind:string,sourcePath:string,url:string,resolvedUrl:string,path:string,bytes:long,sha256:string,expectedEntries:long,entryCountBasis:string,keySha256:string,payloadSha256:string,logicalDigestBasis:string,logicalObservation:string,observedEntries:long,observation:string,observationError:string,observer:{OBSERVER}>"
ENTRY = f"id string, title string, infoUrl string, review {REVIEW}, artifacts array<{ARTIFACT}>"
LOCK = f"schemaVersion int, catalog struct<name:string,scope:string>, entries array<struct<id:string,title:string,infoUrl:string,review:{REVIEW},artifacts:array<{ARTIFACT}>>>"
MANIFEST = "path string, kind string, bytes long, sha256 string, entries long, key_sha256 string, payload_sha256 string"
AUDIT = "path string, kind string, entries long, key_sha256 string, payload_sha256 string"


# readers -------------------------------------------------------------------


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document by a strict schema; malformed fields fail, and ``rules.unknown_fields`` names unknown ones."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str, columns: int = 7) -> DataFrame:
    """A manifest by tabs; comments and blank lines are skipped; columns: 5 (version 1) or 7."""
    schema = ", ".join(MANIFEST.split(", ")[:columns])
    return spark.read.schema(schema).csv(path, sep="\t", comment="#", header=True, enforceSchema=False, mode="FAILFAST")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """An audit by tabs; a path that it has twice fails."""
    found = spark.read.schema(AUDIT).csv(path, sep="\t", comment="#", header=True, enforceSchema=False, mode="FAILFAST")
    again = [r["path"] for r in repeated(found, "path").limit(5).collect()]
    if again:
        raise ValueError(f"paths that the audit has twice: {', '.join(again)}")
    return found


def _identity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files (path, length) with their SHA-256, read in pieces."""
    from pyarrow import fs

    for b in batches:
        found = []
        for path in b.column(0).to_pylist():
            files, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
            sha = hashlib.sha256()
            with files.open_input_stream(inner, compression=None) as f:
                while data := f.read(1 << 20):
                    sha.update(data)
            found.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found)], ["file", "length", "sha"])


def identities(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, sha`` of all files below ``folder``; paths are relative to it. Files of any size are streamed."""
    root = folder.rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    bare = F.regexp_replace("file", "^file:/*", "/")
    start = len(root.removeprefix("file://")) if root.startswith(("/", "file:")) else len(root)
    relative = F.substr(bare if root.startswith(("/", "file:")) else F.col("file"), F.lit(start + 2))
    return listed.repartition("path").mapInArrow(_identity, "file string, length long, sha string").select(relative.alias("path"), "length", "sha")


def verify_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Manifest rows whose file, at their path below ``folder``, is missing or differs in length or SHA-256."""
    seen = identities(spark, folder).select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("sha").alias("_sha"))
    found = manifest.join(seen, F.col("path") == F.col("_path"), "left")
    return found.where(F.col("_sha").isNull() | (F.col("_length") != F.col("bytes")) | (F.col("_sha") != F.col("sha256"))).select("path", "bytes", "_length", "sha256", "_sha")


def verify_notices(artifacts: DataFrame) -> DataFrame:
    """One row: artifacts, those counted by this engine only, and those without both logical digests."""
    own = F.coalesce(F.col("entryCountBasis") == rules.OBSERVED, F.lit(False))
    return artifacts.agg(F.count("*").alias("artifacts"), F.count_if(own).alias("self_observed"), F.count_if(F.col("keySha256").isNull() | F.col("payloadSha256").isNull()).alias("without_digests"))


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of one kind."""
    return rows.where(F.col("kind") == kind)


def with_path(rows: DataFrame, needle: str) -> DataFrame:
    """Rows whose path has ``needle`` in it."""
    return rows.where(F.contains(F.col("path"), F.lit(needle)))


def sync_plan(artifacts: DataFrame, present: DataFrame, most_file: int, most_total: int) -> DataFrame:
    """``path, bytes, action``: what to do so that a folder holds the approved artifacts.

    ``artifacts``: path, bytes, sha256; ``present``: path, length, sha. Actions:
    reuse, fetch, or refuse, for a file above ``most_file`` and for all where
    their sum is above ``most_total``. The fetching itself is left to a caller.
    """
    here = present.select(F.col("path").alias("_path"), F.col("length").alias("_length"), F.col("sha").alias("_sha"))
    total = artifacts.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_total"))  # one row
    found = artifacts.join(here, F.col("path") == F.col("_path"), "left").join(F.broadcast(total))
    same = F.coalesce((F.col("_length") == F.col("bytes")) & (F.col("_sha") == F.col("sha256")), F.lit(False))
    action = F.when((F.col("bytes") > most_file) | (F.col("_total") > most_total), "refuse").when(same, "reuse").otherwise("fetch")
    return found.select("path", "bytes", action.alias("action"))


# inventory -----------------------------------------------------------------

_ROW = r"(?s)<tr[^>]*class=\"[^\"]*\bfile\b[^\"]*\"[^>]*>(.*?)</tr>"


def page_rows(pages: DataFrame) -> DataFrame:
    """``url, href, bytes``: rows of stored index pages (url, html); bytes -1: a directory."""
    rows = pages.select("url", F.explode(F.regexp_extract_all("html", F.lit(_ROW), F.lit(1))).alias("row"))
    href = html_attribute(F.regexp_extract("row", "href=\"([^\"]*)\"", 1))
    return rows.select("url", href.alias("href"), F.regexp_extract("row", "data-order=\"(-?[0-9]+)\"", 1).cast("long").alias("bytes"))


def crawl(pages: DataFrame, root: str, most_pages: int = 100_000) -> tuple[DataFrame, int]:
    """Files reachable from ``root`` over stored pages, breadth first, and the number of pages.

    Each round joins the frontier with the stored pages and drops the pages
    seen before; files are (path, type, bytes, url, parent).
    """
    spark = pages.sparkSession
    inside = ~F.col("href").rlike(r"^(\.|/|[A-Za-z][A-Za-z0-9+.-]*:)|/\.\.?(/|$)")
    rows = materialize(page_rows(pages).where(inside).withColumn("child", F.concat("url", "href")), "page-rows")
    # each round's pages are a folder of their own; what was seen is all of them
    base, count, rounds = fresh_path(spark, "crawl"), 1, 0
    spark.createDataFrame([(root,)], "url string").write.parquet(f"{base}/round=0")
    seen = lambda n: spark.read.schema("url string").parquet(*[f"{base}/round={i}" for i in range(n + 1)])
    while True:
        frontier = spark.read.schema("url string").parquet(f"{base}/round={rounds}")
        links = frontier.join(rows, "url").where("bytes = -1").select(F.col("child").alias("url")).distinct()
        links.join(seen(rounds), "url", "left_anti").write.parquet(f"{base}/round={rounds + 1}")
        new = spark.read.schema("url string").parquet(f"{base}/round={rounds + 1}").count()
        if not new:
            break
        count, rounds = count + new, rounds + 1
        if count > most_pages:
            raise ValueError(f"more than {most_pages} pages")
    files = rows.join(seen(rounds), "url").where("bytes >= 0")
    path = decoded_path(F.substr("child", F.lit(len(root) + 1)))
    return files.select(path.alias("path"), file_type(path).alias("type"), "bytes", F.col("child").alias("url"), F.col("url").alias("parent")).distinct(), count


def inventory_json(files: DataFrame, root: str, pages: int, snapshot: str) -> str:
    """The inventory's document: totals, the set's digest and its files by URL. A listing is a document's worth of rows by contract."""
    totals, digest = inventory_totals(files).first(), listing_fingerprint(files).first()
    if not totals["safe"]:
        raise ValueError("the sum of advertised bytes is out of range")
    listed = [r.asDict() for r in files.select("path", "type", "bytes", "url", "parent").orderBy("url").toLocalIterator()]
    return sinks.stable_json({"root": root, "snapshotAt": snapshot, "pages": pages, "fileCount": totals["file_count"], "advertisedBytes": totals["advertised_bytes"] or 0, "listingSha256": digest["digest"], "files": listed})


def inventory_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("file_count"), F.sum("bytes").alias("advertised_bytes"), (F.coalesce(F.sum("bytes"), F.lit(0)) <= SAFE_INTEGER).alias("safe"))


def listing_fingerprint(files: DataFrame) -> DataFrame:
    """One row ``digest`` of a listing: bytes, tab, URL, in the order of URLs."""
    return audit.set_digest(files, F.concat_ws("\t", F.col("bytes").cast("string"), "url"), F.col("url"))


def denominator_digest(artifacts: DataFrame) -> DataFrame:
    """One row ``digest`` of what was audited: SHA-256, bytes, source path, in the order of paths."""
    return audit.set_digest(artifacts, F.concat_ws("\t", "sha256", F.col("bytes").cast("string"), "sourcePath"), F.col("sourcePath"))


# selection -----------------------------------------------------------------


def select(files: DataFrame, kind: str, folder: str = "selected") -> DataFrame:
    """Inventory files of one type as selected artifacts with ids and local paths below ``folder``. (A selection without any is refused by :func:`selection_source`.)"""
    return files.where(F.col("type") == kind).select(
        url_id(F.col("url"), 24).alias("id"), stem(F.col("path")).alias("title"), F.col("parent").alias("info_url"), F.col("path").alias("source_path"),
        F.col("bytes").alias("advertised_bytes"), F.lit(kind).alias("kind"), "url", F.concat(F.lit(f"{folder}/{kind}/"), url_id(F.col("url"), 32), F.lit(f".{kind}")).alias("local_path"),
    )


def selection_source(selected: DataFrame, inventory: str, root: str, snapshot: str, kind: str) -> dict:
    """What a selection says of the inventory that it is from (``inventory``: the document's text); an empty one is an error."""
    rows = selected.select("kind", F.col("source_path").alias("sourcePath"), F.col("advertised_bytes").alias("advertisedBytes"), "url")
    n, size = rows.agg(F.count("*"), F.sum("advertisedBytes")).first()
    if not n:
        raise ValueError(f"the inventory has no file of type {kind}")
    return {"kind": rules.SOURCE_KIND, "inventorySha256": hashlib.sha256(inventory.encode()).hexdigest(), "root": root, "snapshotAt": snapshot, "selectedType": kind, "selectedCount": n, "selectedAdvertisedBytes": size, "selectedSetSha256": rules.source_set(rows).first()["digest"]}


def selection_violations(selected: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """Selected rows that aren't the inventory's, and inventory rows that aren't selected."""
    own = selected.select(F.col("source_path").alias("path"), F.col("advertised_bytes").alias("bytes"), "url")
    want = files.where(F.col("type") == kind).select("path", "bytes", "url")
    return own.exceptAll(want).withColumn("side", F.lit("selected")).union(want.exceptAll(own).withColumn("side", F.lit("inventory")))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` met twice or more. (A set whose add is not looked at never notices; uniqueness is meant, and checked here.)"""
    return rows.groupBy(key).count().where("count > 1")


def companions(resources: DataFrame, texts: DataFrame) -> DataFrame:
    """Resource files that have a text dictionary of the same directory and stem, by bytes."""
    key = lambda c: F.struct(directory(decoded_path(F.col(c))), F.lower(stem(decoded_path(F.col(c)))))
    return resources.withColumn("_k", key("path")).join(texts.select(key("path").alias("_k")).distinct(), "_k", "left_semi").drop("_k").orderBy("bytes", "path")


def within_budget(rows: DataFrame, ceiling: int) -> DataFrame:
    """Rows with the running sum of bytes before them, and whether they still fit. The order is that of bytes and path."""
    from keyloom.operators.prefix import numbered, running_start

    placed = numbered(rows, [F.col("bytes"), F.col("path")], "ordinal")
    return running_start(placed, F.col("bytes"), out="before").withColumn("fits", F.col("before") + F.col("bytes") <= ceiling)


def basename_groups(files: DataFrame) -> DataFrame:
    """Basenames that more than one file has, percent-decoded, in normal form C and lower case."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    named = nfc(files.select(plain.alias("basename")), "basename").select(F.lower("basename").alias("basename"))
    return named.groupBy("basename").agg(F.count("*").alias("files")).where("files > 1")


def nfc(values: DataFrame, column: str) -> DataFrame:
    """``values`` with ``column`` in Unicode normal form C, which Spark has no function for."""
    place = values.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [None if v is None else unicodedata.normalize("NFC", v) for v in b.column(place).to_pylist()]
            yield b.set_column(place, b.schema.field(place), pa.array(own, b.schema.field(place).type))

    return values.mapInArrow(run, values.schema)


# import --------------------------------------------------------------------


def import_candidates(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Draft entries (title, type, url, downloadable, downloadUrls) as candidates and URLs.

    Entries of the same signature are one candidate with its occurrences; every
    URL has its class, roles and the candidates that refer to it.
    """
    urls = F.transform("downloadUrls", canonical_url)
    rows = entries.withColumns({"_info": canonical_url(F.col("url")), "_down": F.array_sort(F.array_distinct(urls))})
    rows = rows.withColumn("id", url_id(F.to_json(F.struct("title", "type", "downloadable", "_info", "_down")), 24))
    candidates = rows.groupBy("id").agg(
        F.first("title").alias("title"), F.first("type").alias("declared_type"), F.first("downloadable").alias("downloadable"), F.count("*").alias("occurrences"),
        F.first(F.array_sort(F.array_distinct(F.transform(F.concat(F.array("_info"), "_down"), lambda u: url_id(u, 16))))).alias("url_ids"),
    )
    info = rows.select("id", F.col("_info").alias("url"), F.lit("info").alias("role"))
    down = rows.select("id", F.explode("_down").alias("url"), F.lit("download").alias("role"))
    bridge = info.unionByName(down).groupBy("url").agg(F.sort_array(F.collect_set("role")).alias("roles"), F.sort_array(F.collect_set("id")).alias("references"))
    return candidates, bridge.select(url_id(F.col("url"), 16).alias("id"), "url", classify_url(F.col("url")).alias("classification"), "roles", "references")


# lock and promotion ---------------------------------------------------------


def approved(lock: DataFrame) -> DataFrame:
    """Artifacts of approved entries that may be tested, by path."""
    rows = lock.select(F.explode("entries").alias("e")).where("e.review.status = 'approved' and e.review.testingAllowed")
    return rows.select(F.col("e.id").alias("entry_id"), F.explode("e.artifacts").alias("a")).select("entry_id", "a.*").orderBy("path")


def review_violations(reviews: DataFrame) -> DataFrame:
    """Reviews (entry_id, review) that break a rule, with the rule."""
    return rules.broken(reviews, rules.review(F.col("review")))


def lock_violations(artifacts: DataFrame) -> DataFrame:
    """Lock artifacts (columns as in ARTIFACT) that break a rule, with the rule; what they share is another violation."""
    fields = [f for f in artifacts.columns if f != "id"]
    rows = artifacts.withColumn("id", F.lit(None).cast("string")) if "id" not in artifacts.columns else artifacts
    rows = rows.select("id", "path", "sourcePath", F.struct(*fields).alias("a"))
    own = rules.broken(rows, rules.locked(F.col("a")), keep=["id", "path"])
    return own.union(rules.repeated(rows, "path", "path")).union(rules.repeated(rows, "sourcePath", "source path")).select("path", "violation")


def promote(draft: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Draft artifacts with their outcome: promoted, excluded, acquisition-error, or missing where there is none, which :func:`promoted` refuses."""
    found = draft.join(outcomes.select("path", "ok", "acquired", "error"), "path", "left")
    status = F.when(F.col("acquired").isNull(), "missing").when(~F.col("acquired"), "acquisition-error").when(F.col("ok"), "promoted").otherwise("excluded")
    return found.withColumn("status", status)


def promoted(draft: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The artifacts of :func:`promote` that go into the lock; an artifact without an outcome is an error."""
    found = promote(draft, outcomes)
    lost = [r["path"] for r in found.where("status = 'missing'").select("path").limit(5).collect()]
    if lost:
        raise ValueError(f"artifacts without an outcome: {', '.join(lost)}")
    return found.where("status = 'promoted'")


def pair_violations(lock: DataFrame, outcomes: DataFrame, fields: list[str]) -> DataFrame:
    """Paths of which lock and outcomes differ in a field or which one of them lacks."""
    both = lock.select("path", F.struct(*fields).alias("_l")).join(outcomes.select("path", F.struct(*fields).alias("_o")), "path", "full_outer")
    return both.where(~F.col("_l").eqNullSafe(F.col("_o"))).select("path", F.when(F.col("_l").isNull(), "outcomes only").when(F.col("_o").isNull(), "lock only").otherwise("differs").alias("side"))


def major_version_exclusions(results: DataFrame) -> DataFrame:
    """Excluded results whose error is about the version of the format."""
    return results.where((F.col("status") == "excluded") & F.coalesce(F.col("error"), F.lit("")).rlike("(?i)(major|engine) version"))


# baselines and audits --------------------------------------------------------


def baseline_merge(lock: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lock artifacts with the audit's digests, and the paths that only one side has."""
    a, b = lock.select("path"), found.select("path")
    lonely = a.join(b, "path", "left_anti").withColumn("side", F.lit("lock")).union(b.join(a, "path", "left_anti").withColumn("side", F.lit("audit")))
    return lock.drop("keySha256", "payloadSha256").join(found.select("path", F.col("key_sha256").alias("keySha256"), F.col("payload_sha256").alias("payloadSha256"), F.col("entries").alias("observedEntries")), "path"), lonely


def zip_violations(denominator: DataFrame, outcomes: DataFrame, fields: list[str]) -> DataFrame:
    """Positions at which two lists ordered by path differ."""
    from keyloom.operators.prefix import numbered

    a, b = (numbered(x.select(*fields), [F.col("path")], "position").select("position", F.struct(*fields).alias(n)) for x, n in ((denominator, "_a"), (outcomes, "_b")))
    return a.join(b, "position", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("position")


def audit_summary(outcomes: DataFrame) -> DataFrame:
    """One row: passed, failed, entries, and whether all passed."""
    ok = F.col("status") == "passed"
    return outcomes.agg(
        F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, F.col("entries"))), F.lit(0)).alias("entries"),
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("complete_success"),
    )


def compression_strata(blocks: DataFrame) -> DataFrame:
    """``tags, artifacts``: artifacts by the set of their blocks' codecs."""
    sets = blocks.groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    return sets.groupBy("tags").agg(F.count("*").alias("artifacts"))


#: Errors by their class alone, in the words of a report.
BY_CLASS = {
    "Io": "io", "Truncated": "truncated", "ChecksumMismatch": "checksum-mismatch", "LimitExceeded": "limit-exceeded", "AllocationFailed": "allocation-failed",
    "MissingPasscode": "passcode-required", "InvalidPasscode": "passcode-required", "InvalidFormat": "invalid-geometry",
}


def error_category(error_class: Column, message: Column) -> Column:
    """One of fifteen categories of a typed error; some classes by what their message is about, unknown ones ``unclassified``."""
    low = F.lower(F.coalesce(message, F.lit("")))
    unsupported = F.when(low.contains("engine version"), "unsupported-version").when(low.contains("encoding"), "unsupported-encoding").when(low.contains("encrypt"), "unsupported-encryption").otherwise("unsupported-compression")
    out = F.when(error_class == "Decode", F.when(low.contains("key"), "key-decode").otherwise("record-decode"))
    out = out.when(error_class == "Unsupported", unsupported)
    out = out.when(error_class == "InvalidData", F.when(low.contains("lzo") | low.contains("zlib"), "compression-failure").otherwise("invalid-geometry"))
    for name, category in BY_CLASS.items():
        out = out.when(error_class == name, category)
    return out.otherwise("unclassified")


def audit_report(geometry: DataFrame, outcomes: DataFrame, artifacts: DataFrame) -> dict:
    """What version 1 artifacts (path, bytes, sha256, sourcePath) are: by their geometry (see ``artifacts.probe``), by the reader's outcomes, and where both agree."""
    rows = artifacts.select("path", "bytes").join(geometry.drop("kind"), "path").join(outcomes.select("path", "status", "error_class", "error"), "path")
    ok, accepted = F.size("problems") == 0, F.col("status") == "passed"
    one = rows.agg(
        F.count("*").alias("artifacts"), F.sum("bytes").alias("bytes"), F.count_if(ok).alias("conforming"), F.sum(F.when(ok, F.col("entries"))).alias("declaredEntries"),
        F.sum(F.when(ok, F.col("key_blocks"))).alias("keyBlocks"), F.sum(F.when(ok, F.col("record_blocks"))).alias("recordBlocks"),
        F.count_if(accepted).alias("accepted"), F.sum(F.when(accepted, F.col("bytes"))).alias("acceptedBytes"), F.sum(F.when(accepted, F.col("entries"))).alias("acceptedEntries"),
    ).first().asDict()
    counts = lambda df, by: {r["value"]: r["count"] for r in audit.tally(df, by).collect()}
    return one | {
        "denominator": denominator_digest(artifacts).first()["digest"],
        "compressionStrata": counts(rows.where(ok), "tags"),
        "rejectedCategories": counts(rows.where(~accepted), error_category(F.col("error_class"), F.col("error"))),
        "agreement": audit.agreement(rows, ok, accepted).first().asDict(),
    }


def baseline_violations(lock: DataFrame, found: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``path, violation``: why an audit's digests can't be a lock's baselines: not the lock's artifacts, not all passed, or not the outcomes' facts.

    ``lock``: path, kind, expectedEntries, keySha256, payloadSha256; ``found``: as AUDIT; ``outcomes``: path, status, entries, key_sha256, payload_sha256.
    """
    a = found.select(F.col("path").alias("a_path"), F.struct("entries", "key_sha256", "payload_sha256").alias("a"), F.col("kind").alias("a_kind"), F.col("entries").alias("a_entries"), "key_sha256", "payload_sha256")
    o = outcomes.select(F.col("path").alias("o_path"), "status", F.struct("entries", "key_sha256", "payload_sha256").alias("o"))
    rows = lock.join(a, F.col("path") == F.col("a_path"), "full_outer").join(o, F.coalesce("path", "a_path") == F.col("o_path"), "full_outer")
    has = F.col("path").isNotNull() & F.col("a_path").isNotNull()
    why = {
        "not in the audit": F.col("path").isNotNull() & F.col("a_path").isNull(),
        "not in the lock": F.col("path").isNull(),
        "no outcome": F.col("o_path").isNull(),
        "audit failed": F.col("status") != "passed",
        "another kind": has & (F.col("kind") != F.col("a_kind")),
        "another number of entries": has & (F.col("expectedEntries") != F.col("a_entries")),
        "digests of the lock differ": has & ((F.col("keySha256") != F.col("key_sha256")) | (F.col("payloadSha256") != F.col("payload_sha256"))),
        "audit differs from its outcome": F.col("a_path").isNotNull() & F.col("o_path").isNotNull() & ~F.col("a").eqNullSafe(F.col("o")),
    }
    return rules.broken(rows.select(F.coalesce("path", "a_path", "o_path").alias("where"), "*"), why, keep=["where"]).withColumnRenamed("where", "path")


# writers ---------------------------------------------------------------------


def manifest_lines(manifest: DataFrame) -> DataFrame:
    """Lines of the manifest by path; the header is the writer's."""
    cols = [c.split()[0] for c in MANIFEST.split(", ")]
    return manifest.orderBy("path").select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).alias("value"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The manifest as one file, ordered by path, replaced as a whole. A catalogue is a file's worth of rows by contract."""
    head = "\t".join(c.split()[0] for c in MANIFEST.split(", "))
    sinks.write_atomic(path, "".join(f"{x}\n" for x in [head, *(r["value"] for r in manifest_lines(manifest).toLocalIterator())]))


def audit_lines(outcomes: DataFrame) -> DataFrame:
    """Lines of an audit by path: path, kind, entries and both digests, by tabs; the header is the writer's."""
    cols = [c.split()[0] for c in AUDIT.split(", ")]
    return outcomes.orderBy("path").select(F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("value"))


def write_audit(outcomes: DataFrame, path: str) -> None:
    """The audit as one file, written only where every artifact passed."""
    summary = audit_summary(outcomes).first()
    if not summary["complete_success"] or not summary["passed"]:
        raise ValueError(f"{summary['failed']} of {summary['passed'] + summary['failed']} artifacts failed; no audit is written")
    head = "\t".join(c.split()[0] for c in AUDIT.split(", "))
    sinks.write_atomic(path, "".join(f"{x}\n" for x in [head, *(r["value"] for r in audit_lines(outcomes).toLocalIterator())]))
