"""The mdx and mdd data sources and the sinks."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from keyloom.operators import audit, locate
from keyloom.sources import sinks
from keyloom.sources.dictionary import keys_table, register
from tests.encode import container
from tests.test_wire import G15


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("dicts")
    register(spark)
    (d / "a.mdx").write_bytes(container("mdx", G15, 2, key_blocks=[2, 2, 2], record_blocks=[1, 5, 2, 4], codecs=("zlib", "zlib", "lzo")))
    (d / "b.mdx").write_bytes(container("mdx", [("Apple", "1"), ("apple", "2"), ("app-let", "3"), ("Application", "4"), ("banana", "5")], 1, key_blocks=[2, 2, 1], attributes={"StripKey": "Yes"}))
    (d / "c.mdd").write_bytes(container("mdd", [("\\assets\\theme.css", b"\x01\x02"), ("\\x.bin", b""), ("\\..\\..\\evil", b"!")]))
    (d / "bad.mdx").write_bytes(container("mdx", [("alpha", "A"), ("omega", "O")], key_blocks=[1, 1], record_blocks=[1, 1], spoil_record=1))
    return d


def test_scans(spark, files):
    rows = spark.read.format("mdx").load(f"{files}/a.mdx").orderBy("ordinal").collect()
    assert [(r.ordinal, r.key, r.text) for r in rows] == [(i, k, v) for i, (k, v) in enumerate(G15)]
    spans = spark.read.format("mdx").options(columns="spans", entriesPerPartition="2").load(f"{files}/a.mdx")
    assert spans.rdd.getNumPartitions() == 3
    assert [tuple(r)[2:] for r in spans.orderBy("ordinal").collect()][:2] == [("alpha", 0, 2, 2), ("duplicate", 2, 5, 3)]
    both = spark.read.format("mdx").option("columns", "keys").load(f"{files}/a.mdx,{files}/b.mdx")
    assert both.columns == ["dict_id", "ordinal", "key"] and both.count() == 11


def test_metadata_tables(spark, files):
    read = lambda table, kind="mdx", name="a.mdx": spark.read.format(kind).option("table", table).load(f"{files}/{name}")
    h = read("header").first()
    assert (h.entries, h.wire_version, h.strip_key, h.key_case_sensitive) == (6, 2, False, False)
    assert read("header", "mdd", "c.mdd").first().key_case_sensitive
    assert read("key_blocks").count() == 3 and read("record_blocks").agg(F.sum("decomp_size")).first()[0] == 12
    assert audit.section_violations(read("sections").withColumn("position", F.col("position"))).count() == 0
    assert "Encoding" in [r.name for r in read("attributes").collect()]


def test_pushdown(spark, files):
    df = spark.read.format("mdx").options(columns="keys", pushdown="true", entriesPerPartition="2").load(f"{files}/a.mdx")
    assert [r.key for r in df.where("ordinal = 4").collect()] == ["following"]
    assert sorted(r.ordinal for r in df.where("ordinal in (1, 5)").collect()) == [1, 5]
    assert sorted(r.ordinal for r in df.where("ordinal > 1 and ordinal <= 3").collect()) == [2, 3]
    assert df.where("ordinal = 99").count() == 0


def test_damage(spark, files):
    with pytest.raises(Exception, match="ChecksumMismatch"):
        spark.read.format("mdx").load(f"{files}/bad.mdx").collect()
    rows = spark.read.format("mdx").option("mode", "PERMISSIVE").load(f"{files}/bad.mdx").collect()
    assert [(r.ordinal, r._error is not None) for r in rows] == [(0, False), (None, True)]


def test_lookup_over_files(spark, files):
    keys = keys_table(spark, "mdx", f"{files}/b.mdx")
    assert [r.key for r in locate.prefix_keys(keys, "APP", 10, strip=True).collect()] == ["Apple", "apple", "app-let", "Application"]
    assert locate.prefix_keys(keys, "app", 0, strip=True).count() == 0
    queries = locate.batch(spark.createDataFrame([(1, "apple"), (2, "APPLE"), (3, "zebra"), (4, "apple")], "query_id long, query string"), strip=True)
    got = {r.query_id: (r.basis, r.match_count, r.first_ordinal) for r in locate.matches(queries, keys).collect()}
    assert got == {1: ("RawExact", 1, 1), 2: ("HeaderNormalized", 2, 0), 3: (None, 0, None), 4: ("RawExact", 1, 1)}
    res = keys_table(spark, "mdd", f"{files}/c.mdd")
    q = locate.batch(spark.createDataFrame([(1, "assets/theme.css"), (2, "\\assets\\theme.css")], "query_id long, query string"), case_sensitive=True, resource_path=True)
    assert {r.query_id: r.basis for r in locate.matches(q, res).collect()} == {1: "HeaderNormalized", 2: "RawExact"}


def test_sinks(spark, files, tmp_path):
    entries = spark.read.format("mdx").load(f"{files}/a.mdx")
    sinks.dump(entries, "text", str(tmp_path / "dump"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "dump")).collect()]
    assert sorted(lines) == sorted(hashlib.sha256(v.encode()).hexdigest() + "\t" + k for k, v in G15)
    done = sinks.copy_resources(spark.read.format("mdd").load(f"{files}/c.mdd"), str(tmp_path)).collect()
    assert sorted(r.bytes_written if r.file else -1 for r in done) == [-1, 0, 2]
    assert (tmp_path / "assets/theme.css").read_bytes() == b"\x01\x02"
    key, body = audit.ordered_digest(((r.ordinal, r.key, r.text) for r in entries.orderBy("ordinal").toLocalIterator()), True)
    want = hashlib.sha256(b"".join(i.to_bytes(8, "big") + len(k).to_bytes(8, "big") + k.encode() for i, (k, _) in enumerate(G15))).hexdigest()
    assert key == want and len(body) == 64
    assert sinks.stable_json({"b": 1, "a": "é"}) == '{\n  "a": "é",\n  "b": 1\n}\n'
    assert sinks.facts_lines([("k", "a\tb", 1, 2, "s")]).endswith("k\ta b\t1\t2\ts\n")


def test_artifact_audit(spark, files):
    from keyloom.plans import artifacts, catalogue

    rows = spark.createDataFrame([(f"{files}/{n}", n[-3:]) for n in ("a.mdx", "b.mdx", "c.mdd", "bad.mdx")], "path string, kind string")
    found = {r.path.rsplit("/", 1)[1]: r for r in artifacts.audit(rows).collect()}
    assert {k: r.status for k, r in found.items()} == {"a.mdx": "passed", "b.mdx": "passed", "c.mdd": "passed", "bad.mdx": "failed"}
    assert found["bad.mdx"].error_class == "ChecksumMismatch" and found["a.mdx"].tags == "lzo,zlib"
    entries = spark.read.format("mdx").load(f"{files}/a.mdx").orderBy("ordinal")
    key, body = audit.ordered_digest(((r.ordinal, r.key, r.text) for r in entries.toLocalIterator()), True)
    assert (found["a.mdx"].key_sha256, found["a.mdx"].payload_sha256, found["a.mdx"].payload_bytes) == (key, body, 12)
    s = catalogue.audit_summary(artifacts.audit(rows)).first()
    assert (s.passed, s.failed, s.entries, s.complete_success) == (3, 1, 14, False)
    lines_ = {r.path[-5:]: r.key_sha256 for r in artifacts.audit(rows, protocol="lines").collect()}
    assert lines_["a.mdx"] == audit.line_digest([(k, v) for k, v in G15], "mdx")[0]
    g = artifacts.group_facts(spark.read.format("mdx").option("columns", "keys").load(f"{files}/a.mdx")).first()
    assert (g.entries, g.distinct_keys, g.duplicate_groups) == (6, 5, 1)
    assert [r.text for r in artifacts.preview(entries, 2, 1).collect()] == ["A", "1"]
    low = catalogue.error_category(F.lit("Unsupported"), F.lit("required engine version"))
    assert spark.range(1).select(low.alias("x")).first().x == "unsupported-version"


def test_arriving_files(spark, files, tmp_path):
    from keyloom.streaming.ingest import arriving_keys

    query = arriving_keys(spark, str(files), "mdx").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(60)
    got = spark.table("arrived").groupBy("dict_id").count().collect()
    assert sorted(r["count"] for r in got) == [2, 5, 6]


def test_command_line(spark, files, tmp_path, capsys):
    from keyloom.__main__ import main

    assert main(["inspect", f"{files}/a.mdx", "--rows", "2"]) == 0 and "alpha" in capsys.readouterr().out
    assert main(["audit", str(tmp_path / "a.tsv"), f"{files}/a.mdx", f"{files}/c.mdd"]) == 0 and (tmp_path / "a.tsv").read_text().count("\n") == 3
    assert main(["audit", str(tmp_path / "b.tsv"), f"{files}/bad.mdx"]) == 1 and not (tmp_path / "b.tsv").exists()
    sha = hashlib.sha256((files / "a.mdx").read_bytes()).hexdigest()
    (tmp_path / "m.tsv").write_text(f"path\tkind\tbytes\tsha256\tentries\na.mdx\tmdx\t{(files / 'a.mdx').stat().st_size}\t{sha}\t6\n")
    assert main(["verify", str(tmp_path / "m.tsv"), str(files), "--columns", "5"]) == 0
    (tmp_path / "m.tsv").write_text((tmp_path / "m.tsv").read_text().replace(sha, "b" * 64))
    assert main(["verify", str(tmp_path / "m.tsv"), str(files), "--columns", "5"]) == 1
    row = '<tr class="file"><td><a href="x.mdx">x</a></td><td data-order="10"></td></tr>'
    spark.createDataFrame([("https://h/r/", row)], "url string, html string").write.parquet(str(tmp_path / "pages"))
    capsys.readouterr()
    assert main(["inventory", str(tmp_path / "pages"), "https://h/r/", "--snapshot", "2026-01-01T00:00:00Z"]) == 0
    assert '"fileCount": 1' in capsys.readouterr().out


def test_permissive_ranges(spark, files):
    """Of a damaged file every range of key blocks gives what it can; a file that doesn't open is one row."""
    rows = [(f"k{i}", f"v{i}") for i in range(12)]
    (files / "part.mdx").write_bytes(container("mdx", rows, key_blocks=[3] * 4, spoil_key=1))
    (files / "none.mdx").write_bytes(b"\0\0\0\4nope")
    read = lambda name: spark.read.format("mdx").options(mode="PERMISSIVE", columns="keys", entriesPerPartition="3").load(f"{files}/{name}").collect()
    found = read("part.mdx")
    assert sorted(r.ordinal for r in found if r._error is None) == [0, 1, 2, 9, 10, 11] and sum(r._error is not None for r in found) == 2
    assert [(r.ordinal, r._error is not None) for r in read("none.mdx")] == [(None, True)]
    (files / "part.mdx").unlink()
    (files / "none.mdx").unlink()


def test_blocks_of_listed_ordinals(spark, files):
    from keyloom.sources.dictionary import Options, PruningReader
    from pyspark.sql.datasource import In

    reader = PruningReader(Options("mdx", {"path": f"{files}/a.mdx", "columns": "keys", "entriesperpartition": "100"}))
    left = list(reader.pushFilters([In(("ordinal",), (0, 5, 99))]))
    assert len(left) == 1 and [(p.first, p.last) for p in reader.partitions()] == [(0, 1), (2, 3)]
