"""Rules of the catalogue's documents, its reports and its files."""

from __future__ import annotations

import copy
import hashlib
import html
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from keyloom.functions import keys as K
from keyloom.plans import artifacts, catalogue, rules
from keyloom.sources.wire.errors import ContainerError
from tests.encode import container
from tests.test_wire import G15

SHA = "a" * 64
REVIEW = {"status": "approved", "testingAllowed": True, "redistributionAllowed": False, "license": "MIT", "licenseUrl": None, "reviewedBy": "r", "reviewedAt": "2026-01-02T03:04:05Z", "notes": "fine"}
OBSERVER = {"binaryBytes": 1, "binarySha256": SHA, "mode": rules.OBSERVER_MODE, "timeoutMs": 1, "tool": "t", "version": "1"}
ARTIFACT = {
    "kind": "mdx", "sourcePath": "a/b.mdx", "url": "https://a.example/b.mdx", "resolvedUrl": "https://A.example:443/c.mdx", "path": "selected/b.mdx", "bytes": 3, "sha256": SHA, "expectedEntries": 5,
    "entryCountBasis": rules.OBSERVED, "keySha256": SHA, "payloadSha256": SHA, "logicalDigestBasis": "independent", "logicalObservation": "o", "observedEntries": 5, "observation": "o", "observationError": None, "observer": OBSERVER,
}
ENTRY = {"id": "e-1", "title": "t", "infoUrl": "http://a.example/", "review": REVIEW, "artifacts": [ARTIFACT]}


def changed(entry, path, value):
    out = copy.deepcopy(entry)
    at = out
    for k in path[:-1]:
        at = at[k]
    at[path[-1]] = value
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, _parse_datatype_string(schema))


def violations(df):
    return sorted(r.violation for r in df.collect())


A = ("artifacts", 0)
BROKEN = [
    (("id",), "Upper", "malformed id"), (("title",), " ", "no title"), (("infoUrl",), "ftp://x", "malformed info url"), (("artifacts",), [], "no artifacts"),
    (("review", "status"), "other", ["testing before approval", "unknown status"]), (("review", "notes"), " ", "approved without reviewer, time or notes"), (("review", "reviewedAt"), "x", "bad review time"),
    (("review", "license"), "", "no license"), (("review", "testingAllowed"), False, "approved without testing"), (("review", "redistributionAllowed"), True, "redistribution without license"),
    ((*A, "kind"), "zip", ["bad path", "unknown kind"]), ((*A, "sourcePath"), "a\tb", "malformed source path"), ((*A, "url"), "https://10.0.0.1/x", ["resolved on another origin", "url not allowed"]),
    ((*A, "resolvedUrl"), "https://b.example/c", "resolved on another origin"), ((*A, "path"), "../b.mdx", "bad path"), ((*A, "bytes"), 0, "bytes out of range"), ((*A, "sha256"), "AA", "malformed digest"),
    ((*A, "expectedEntries"), None, ["entries out of range", "own count differs from the expected one"]), ((*A, "entryCountBasis"), "guess", "unknown basis of the count"),
    ((*A, "keySha256"), None, ["basis without both digests", "one digest without the other"]), ((*A, "keySha256"), "x", "malformed logical digest"), ((*A, "logicalDigestBasis"), "guess", "unknown basis of the digests"),
    ((*A, "logicalObservation"), None, "basis and observation don't go together"), ((*A, "observedEntries"), 4, "own count differs from the expected one"), ((*A, "observer"), None, "count without provenance"),
    ((*A, "observer", "mode"), "guess", "observer of another mode"), ((*A, "observer", "timeoutMs"), 0, "observer without timeout"), ((*A, "observation"), " ", "empty observation"),
]


def test_lock_rules(spark):
    assert violations(rules.lock_violations(frame(spark, [ENTRY], catalogue.ENTRY))) == []
    rows = [changed(changed(changed(changed(ENTRY, path, value), ("id",), value if path == ("id",) else f"e-{i}"), *(((*A, "path"), f"p/{i}.mdx") if path not in (("artifacts",), (*A, "path")) else (("title",), value if path == ("title",) else "t"))), *(((*A, "sourcePath"), f"s/{i}.mdx") if path not in (("artifacts",), (*A, "sourcePath")) else (("title",), "t"))) for i, (path, value, _) in enumerate(BROKEN)]
    found = {}
    for r in rules.lock_violations(frame(spark, rows, catalogue.ENTRY)).collect():
        found.setdefault(r.id, []).append(r.violation)
    for i, (path, value, want) in enumerate(BROKEN):
        assert sorted(found.get("Upper" if path == ("id",) else f"e-{i}", [])) == ([want] if isinstance(want, str) else want), (path, value)
    assert violations(rules.lock_violations(frame(spark, [ENTRY, ENTRY], catalogue.ENTRY))) == sorted(["repeated id", "repeated path", "repeated source path"] * 2)
    flat = frame(spark, [ARTIFACT, changed(ARTIFACT, ("bytes",), 0)], catalogue.ARTIFACT.removeprefix("struct<").removesuffix(">"))
    assert violations(catalogue.lock_violations(flat)) == sorted(["bytes out of range", *["repeated path", "repeated source path"] * 2])


CHOSEN = "id string, title string, infoUrl string, review " + catalogue.REVIEW + ", artifacts array<struct<kind:string,sourcePath:string,url:string,path:string,advertisedBytes:long>>"


def test_selection_rules(spark):
    entry = ENTRY | {"artifacts": [{k: ARTIFACT[k] for k in ("kind", "sourcePath", "url", "path")} | {"advertisedBytes": 3}]}
    rows = frame(spark, [entry], CHOSEN)
    files = spark.createDataFrame([("a/b.mdx", "mdx", 3, "https://a.example/b.mdx", "https://a.example/")], catalogue.INVENTORY)
    about = catalogue.selection_source(catalogue.select(files, "mdx"), "{}", "https://a.example/", "2026-01-01T00:00:00Z", "mdx")
    assert about["selectedSetSha256"] == hashlib.sha256(b"mdx\ta/b.mdx\t3\thttps://a.example/b.mdx\n").hexdigest()
    assert violations(rules.selection_violations(rows, about)) == []
    assert violations(rules.selection_violations(rows, about | {"selectedCount": 2, "root": "http://x/", "selectedSetSha256": SHA})) == ["another number of artifacts", "another set of artifacts", "root not allowed"]
    pending = frame(spark, [changed(changed(entry, ("review", "status"), "pending"), ("review", "testingAllowed"), False)], CHOSEN)
    assert violations(rules.selection_violations(pending, about | {"selectedType": "mdd"})) == ["kind of another selection", "not approved"]
    with pytest.raises(ValueError, match="no file"):
        catalogue.selection_source(catalogue.select(files, "mdd"), "{}", "https://a.example/", "2026-01-01T00:00:00Z", "mdd")


OUTCOME = f"entryId string, title string, infoUrl string, review {catalogue.REVIEW}, kind string, sourcePath string, path string, url string, advertisedBytes long, status string, acquisition string, bytes long, resolvedUrl string, sha256 string, error string"


def test_draft_rules(spark):
    early = dict.fromkeys(("expectedEntries", "entryCountBasis", "keySha256", "payloadSha256", "logicalDigestBasis", "logicalObservation"))
    entry = ENTRY | {"artifacts": [ARTIFACT | early]}
    got = {"entryId": "e-1", "title": "t", "infoUrl": "http://a.example/", "review": REVIEW, "advertisedBytes": 3, "status": "acquired", "acquisition": "downloaded", "error": None} | {k: ARTIFACT[k] for k in ("kind", "sourcePath", "path", "url", "bytes", "resolvedUrl", "sha256")}
    lost = got | {"entryId": "e-2", "sourcePath": "c.mdx", "path": "selected/c.mdx", "status": "acquisition-error", "acquisition": None, "bytes": None, "resolvedUrl": None, "sha256": None, "error": "gone"}

    def check(entries, outcomes, **other):
        rows = frame(spark, outcomes, OUTCOME)
        bound = {"artifactCount": 2, "advertisedBytes": 6, "artifactSetSha256": rules.source_set(frame(spark, [got, lost], OUTCOME), True).first()["digest"], "kind": "mdx"} | other
        return violations(rules.draft_violations(frame(spark, entries, catalogue.ENTRY), rows, bound))

    assert check([entry], [got, lost]) == []
    assert check([entry], [got | {"bytes": 4}, lost]) == ["bytes differ from those advertised", "outcome differs from its artifact"]
    assert check([entry], [lost], artifactCount=1, advertisedBytes=3) == ["another set of artifacts", "artifact without outcome"]
    assert check([], [got, lost]) == ["acquired but not in the draft"]
    assert check([entry], [got, lost | {"bytes": 3, "error": None}]) == ["facts of what was not acquired", "failure without error"]
    assert check([ENTRY], [got, lost], advertisedBytes=7) == sorted(["another sum of bytes", *(f"{k} in a draft" for k in early)])
    with pytest.raises(ValueError, match="without an outcome"):
        catalogue.promoted(spark.createDataFrame([("p",)], "path string"), spark.createDataFrame([], "path string, ok boolean, acquired boolean, error string"))


def test_binding_rules(spark):
    source = {"kind": rules.SOURCE_KIND, "inventorySha256": SHA, "root": "https://a.example/", "snapshotAt": "2026-01-01T00:00:00Z", "selectedType": "mdx", "selectedCount": 2, "selectedAdvertisedBytes": 6, "selectedSetSha256": SHA}
    bound = {"advertisedBytes": 6, "artifactCount": 2, "entryCount": 2, "artifactSetSha256": SHA, "selectionSha256": SHA, "source": source}
    schema = "b struct<advertisedBytes:long,artifactCount:long,entryCount:long,artifactSetSha256:string,selectionSha256:string,source:struct<kind:string,inventorySha256:string,root:string,snapshotAt:string,selectedType:string,selectedCount:long,selectedAdvertisedBytes:long,selectedSetSha256:string>>"
    check = lambda b: violations(rules.broken(frame(spark, [{"b": b}], schema), rules.binding(F.col("b"))))
    assert check(bound) == []
    assert check(bound | {"advertisedBytes": 7, "entryCount": 3}) == ["bound bytes differ", "entries aren't artifacts"]
    assert check(bound | {"selectionSha256": "x", "artifactCount": 0}) == ["bound count differs", "bound counts out of range", "entries aren't artifacts", "malformed bound digest"]
    assert check(changed(bound, ("source", "snapshotAt"), "then")) == ["bad snapshot time"]


def test_manifest_is_written_whole(spark, tmp_path):
    rows = [("b/x.mdx", "mdx", 3, SHA, 1, SHA, None), ("a/x.mdx", "mdx", 4, SHA, 2, None, None)]
    path = tmp_path / "manifest.tsv"
    catalogue.write_manifest(spark.createDataFrame(rows, catalogue.MANIFEST), str(path))
    assert path.read_text().split("\n")[1].startswith("a/x.mdx\tmdx\t4\t") and len(list(tmp_path.iterdir())) == 1
    assert [(r.path, r.entries, r.key_sha256) for r in catalogue.read_manifest(spark, str(path)).orderBy("path").collect()] == [("a/x.mdx", 2, None), ("b/x.mdx", 1, SHA)]
    results = spark.createDataFrame([("excluded", "Unsupported: required engine version (major=3)"), ("excluded", "other"), ("promoted", "engine version")], "status string, error string")
    assert catalogue.major_version_exclusions(results).count() == 1


def test_chunks_reach_a_writer_in_order(spark, tmp_path):
    from keyloom.sources import sinks

    folder = str(tmp_path)

    def write(rows):
        for r in rows:
            with open(f"{folder}/{r['ordinal']}", "ab") as f:
                f.write(r["data"].encode())

    pieces = spark.createDataFrame([(o, c, f"{o}:{c};") for o in range(5) for c in range(7)], "ordinal long, chunk int, data string").repartition(6)
    sinks.for_each_chunk(pieces, write)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {str(o): "".join(f"{o}:{c};" for c in range(7)) for o in range(5)}
    line = sinks.outcome_json(spark.createDataFrame([("p", 1)], "path string, entries long")).first().value
    assert json.loads(line) == {"path": "p", "entries": 1}


def test_unknown_fields(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"schemaVersion": 1, "more": 2, "entries": [{"id": "x", "review": {"status": "x", "mood": "y"}}]}))
    assert rules.unknown_fields(spark, str(tmp_path / "x.json"), _parse_datatype_string(catalogue.LOCK)) == ["entries.review.mood", "more"]


def test_categories(spark):
    one = [
        (ContainerError("Unsupported", "generated engine version", major=3), "unsupported-version"), (ContainerError("Unsupported", "encoding 'x'"), "unsupported-encoding"), (ContainerError("Unsupported", "encrypted version 1 keyword section"), "unsupported-encryption"),
        (ContainerError("Unsupported", "record block: compression tag 03000000"), "unsupported-compression"), (ContainerError("Decode", "key"), "key-decode"), (ContainerError("Decode", "record"), "record-decode"), (ContainerError("InvalidData", "zlib stream: x"), "compression-failure"),
        (ContainerError("InvalidData", "lzo stream is cut"), "compression-failure"), (ContainerError("InvalidData", "record starts decrease"), "invalid-geometry"), (ContainerError("InvalidFormat", "x"), "invalid-geometry"), (ContainerError("Io", "x"), "io"), (ContainerError("Truncated", "x"), "truncated"),
        (ContainerError("ChecksumMismatch", "x"), "checksum-mismatch"), (ContainerError("LimitExceeded", "x"), "limit-exceeded"), (ContainerError("AllocationFailed", "x"), "allocation-failed"), (ContainerError("MissingPasscode", "x"), "passcode-required"), (ContainerError("InvalidPasscode", "x"), "passcode-required"),
    ]
    df = spark.createDataFrame([(e.kind, str(e), want) for e, want in one] + [("Other", "x", "unclassified")], "kind string, message string, want string")
    assert df.where(catalogue.error_category(F.col("kind"), F.col("message")) != F.col("want")).collect() == []
    assert len({want for _, want in one}) + 1 == 15


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    for text in ("a&amp;lt;b", "&#x41;&#65;&#128512;", "&QUOT;&apos;&lt;&gt;", "&unknown; &", "&#xD800;&", "a&ampb", "&&amp;&", ""):
        want = text if "D800" in text or "unknown" in text or "ampb" in text else html.unescape(text.replace("&QUOT;", "&quot;"))
        assert one(K.html_attribute(F.lit(text))) == want, text
    said = "open /home/u/corpus/a.mdx failed in /home/u\x07\n"
    assert one(K.redact(F.lit(said), {"/home/u": "<home>", "/home/u/corpus/": "<corpus>"})) == "open <corpus>/a.mdx failed in <home>?\n"
    assert one(K.field_text(F.lit("a\t\nb c"))) == "a b c" and len(one(K.redact(F.lit("x" * 9000), {}))) == 4096
    names = spark.createDataFrame([("a/Caf\u00e9.mdx",), ("b/cafe\u0301.mdx",), ("c/CAF%C3%89.mdx",), ("d/x+y.mdx",)], "path string")
    assert [(r.basename, r.files) for r in catalogue.basename_groups(names).collect()] == [("caf\u00e9.mdx", 3)]
    rows = spark.createDataFrame([("mdx", "a/b.mdx"), ("mdd", "a/c.mdd")], "kind string, path string")
    assert catalogue.of_kind(rows, "mdd").count() == 1 and catalogue.with_path(rows, "a/b").count() == 1 and catalogue.with_path(rows, "%").count() == 0


def test_files_and_audits(spark, tmp_path):
    good, bad, one = container("mdx", G15, key_blocks=[2, 4]), container("mdx", G15, spoil_record=0), container("mdx", G15, 1, key_blocks=[3, 3])
    for name, data in (("a.mdx", good), ("sub/a.mdx", one), ("sub/bad.mdx", bad)):
        (tmp_path / "c" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / name).write_bytes(data)
    here = catalogue.identities(spark, str(tmp_path / "c"))
    assert {r.path: (r.length, r.sha) for r in here.collect()} == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in (("a.mdx", good), ("sub/a.mdx", one), ("sub/bad.mdx", bad))}
    wanted = spark.createDataFrame([("a.mdx", len(good), hashlib.sha256(good).hexdigest()), ("sub/a.mdx", 1, SHA), ("new.mdx", 5, SHA), ("huge.mdx", 900, SHA)], "path string, bytes long, sha256 string")
    assert {r.path: r.action for r in catalogue.sync_plan(wanted, here, 800, 10_000).collect()} == {"a.mdx": "reuse", "sub/a.mdx": "fetch", "new.mdx": "fetch", "huge.mdx": "refuse"}
    assert {r.action for r in catalogue.sync_plan(wanted, here, 800, 10).collect()} == {"refuse"}
    listed = spark.createDataFrame([(str(tmp_path / "c" / n), "mdx") for n in ("a.mdx", "sub/a.mdx", "sub/bad.mdx")], "path string, kind string")
    done = artifacts.audit(listed, tasks=2)
    assert {r.path[-7:]: (r.status, r.error_class) for r in done.collect()} == {"c/a.mdx": ("passed", None), "b/a.mdx": ("passed", None), "bad.mdx": ("failed", "ChecksumMismatch")}
    assert {r.error_class for r in artifacts.audit(listed.limit(1).repartition(1), seconds=-1.0).collect()} <= {"Timeout", None}
    with pytest.raises(ValueError, match="1 of 3"):
        catalogue.write_audit(done, str(tmp_path / "audit.tsv"))
    assert not (tmp_path / "audit.tsv").exists()
    catalogue.write_audit(done.where("status = 'passed'"), str(tmp_path / "audit.tsv"))
    audit = catalogue.read_audit(spark, str(tmp_path / "audit.tsv"))
    assert [(r.entries, len(r.key_sha256)) for r in audit.collect()] == [(6, 64)] * 2
    lock = audit.select("path", "kind", F.col("entries").alias("expectedEntries"), F.col("key_sha256").alias("keySha256"), F.col("payload_sha256").alias("payloadSha256"))
    assert catalogue.baseline_violations(lock, audit, done.where("status = 'passed'")).count() == 0
    wrong = catalogue.baseline_violations(lock.limit(1).withColumn("expectedEntries", F.lit(7)), audit, done)
    assert violations(wrong) == ["another number of entries", "audit failed", "not in the lock", "not in the lock"]
    (tmp_path / "twice.tsv").write_text((tmp_path / "audit.tsv").read_text() + (tmp_path / "audit.tsv").read_text().split("\n")[1] + "\n")
    with pytest.raises(ValueError, match="twice"):
        catalogue.read_audit(spark, str(tmp_path / "twice.tsv"))


def test_export(spark, tmp_path):
    rows = [("\\a\\b.bin", bytes(range(256)) * 40), ("\\c.css", b""), ("\\..\\..\\evil", b"!")]
    (tmp_path / "x.mdd").write_bytes(container("mdd", rows, record_blocks=[1000] * 10 + [241]))
    listed = spark.createDataFrame([(str(tmp_path / "x.mdd"),)], "path string")
    done = artifacts.export(listed, str(tmp_path / "out"), {"limit.materialized_record_bytes": "0"}).collect()  # nothing is materialized
    assert [(r.ordinal, r.bytes_written, r.error is None) for r in sorted(done, key=lambda r: r.ordinal)] == [(0, 10240, True), (1, 0, True), (2, None, False)]
    assert (tmp_path / "out/a/b.bin").read_bytes() == rows[0][1] and sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == ["b.bin", "c.css"]


def test_version_1_report(spark, tmp_path):
    data = {"a.mdx": container("mdx", G15, 1, key_blocks=[3, 3], codecs=("none", "zlib", "lzo")), "b.mdx": container("mdx", G15, 1) + b"tail", "c.mdx": container("mdx", G15, 1)[:-3], "d.mdx": container("mdx", G15, 1, count_off=1), "e.mdx": container("mdx", [], 1), "f.mdx": b"\0\0"}
    for name, body in data.items():
        (tmp_path / name).write_bytes(body)
    listed = spark.createDataFrame([(str(tmp_path / n), "mdx", len(b), hashlib.sha256(b).hexdigest(), n) for n, b in data.items()], "path string, kind string, bytes long, sha256 string, sourcePath string")
    geometry = artifacts.probe(listed)
    found = {r.path[-5:]: r for r in geometry.collect()}
    assert {n for n, r in found.items() if not r.problems} == {"a.mdx", "d.mdx", "e.mdx"} and (found["a.mdx"].tags, found["a.mdx"].entries, found["a.mdx"].decoded_bytes) == ("lzo,zlib", 6, 12)
    report = catalogue.audit_report(geometry, artifacts.audit(listed), listed)
    assert (report["artifacts"], report["conforming"], report["accepted"]) == (6, 3, 3) and report["agreement"] == {"both": 2, "first_only": 1, "second_only": 1, "neither": 2}
    assert report["compressionStrata"] == {"": 1, "lzo,zlib": 1, "none": 1} and sum(report["rejectedCategories"].values()) == 3


def test_inventory_document(spark):
    files = spark.createDataFrame([("b.mdx", "mdx", 2, "https://h/b.mdx", "https://h/"), ("a.mdx", "mdx", 1, "https://h/a.mdx", "https://h/")], catalogue.INVENTORY)
    text = catalogue.inventory_json(files, "https://h/", 1, "2026-01-01T00:00:00Z")
    found = json.loads(text)
    assert [f["path"] for f in found["files"]] == ["a.mdx", "b.mdx"] and found["advertisedBytes"] == 3 and found["fileCount"] == 2
    assert found["listingSha256"] == hashlib.sha256(b"1\thttps://h/a.mdx\n2\thttps://h/b.mdx\n").hexdigest() and text.endswith("}\n")
