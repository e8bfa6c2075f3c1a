"""Table operators against plain Python, and the registered queries against their SQL."""

from __future__ import annotations

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from keyloom.functions import keys as K
from keyloom.functions.plain import normalize
from keyloom.operators import audit, prefix, spans
from keyloom.plans import catalogue
from keyloom.plans.queries import ORACLE_SQL, QUERIES

KEYS = [" A-b.c_D ", "İx", "ΑΣ", "/a/B\\c", "\\\\x/Y", "!!!", "", "é—É", "Foo bar", "ǅ", "a\tb", "ſS", "10%", "//", "日本 語", "\x00x\x7f", "z/"]


@pytest.mark.parametrize("case", [False, True])
@pytest.mark.parametrize("strip", [False, True])
@pytest.mark.parametrize("resource", [False, True])
def test_normal_form(spark, case, strip, resource):
    df = spark.createDataFrame([(k,) for k in KEYS], "key string").select("key", K.norm_key(F.col("key"), case, strip, resource).alias("n"))
    for r in df.collect():
        assert r.n == normalize(r.key, case, strip, resource), (r.key, r.n)


def test_running_start_and_neighbours(spark):
    random.seed(1)
    rows = [(d, i, random.randint(0, 9)) for d in "ab" for i in range(50)]
    df = spark.createDataFrame(rows, "d string, ordinal long, v long").repartition(5)
    got = {(r.d, r.ordinal): r.start for r in prefix.running_start(df, F.col("v"), by=("d",), rows=7).collect()}
    assert all(got[d, i] == sum(v for e, j, v in rows if e == d and j < i) for d, i, _ in rows)
    nxt = {(r.d, r.ordinal): r.n for r in prefix.neighbour(df, "v", "n", by=("d",), rows=7).collect()}
    assert all(nxt[d, i] == dict(((e, j), v) for e, j, v in rows).get((d, i + 1)) for d, i, _ in rows)
    at = {r.v: r.position for r in prefix.numbered(spark.range(100).select((F.col("id") * 7 % 100).alias("v")), [F.col("v")]).collect()}
    assert at == {i: i for i in range(100)}


def test_chunks_of_blocks(spark):
    random.seed(2)
    sizes = [random.choice([0, 1, 5, 3_000_000]) for _ in range(12)]
    ends = [sum(sizes[: i + 1]) for i in range(12)]
    blocks = [random.randint(1, 2_000_000) for _ in range(40)]
    starts = [sum(blocks[:i]) for i in range(40)]
    total = sum(blocks)
    spans_ = [(i, e - s, min(e, total)) for i, (s, e) in enumerate(zip(sizes, ends, strict=True)) if e - s < total]
    df = spark.createDataFrame(spans_, "ordinal long, record_start long, record_end long")
    b = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(zip(starts, blocks, strict=True))], "block long, decomp_offset long, decomp_size long")
    got = sorted(tuple(r) for r in spans.chunks_of(df, b).collect())
    want = sorted((o, i, max(x, s) - s, min(y, s + n) - s) for o, x, y in spans_ if x < y for i, (s, n) in enumerate(zip(starts, blocks, strict=True)) if x < s + n and y > s)
    assert got == want


def test_percentiles_and_functions(spark):
    df = spark.createDataFrame([(x,) for x in [5, 1, 9, 9, 3, None]], "v long")
    r = audit.percentiles(df, "v").first()
    assert (r.n, r.p50, r.p95, r.p99) == (5, 5, 9, 9)
    random.seed(3)
    many = [("ab"[i % 2], random.choice([None, random.randrange(50)])) for i in range(400)]
    for by in ((), ("k",)):
        got = {tuple(r[c] for c in by): (r.n, r.p50, r.p95, r.p99) for r in audit.percentiles(spark.createDataFrame(many, "k string, v long").repartition(7), "v", by).collect()}
        for key in got:
            own = sorted(v for k, v in many if v is not None and (not by or k == key[0]))
            assert got[key] == (len(own), *(own[(len(own) - 1) * p // 100] for p in (50, 95, 99)))
    lines = spark.createDataFrame([(f"l{i % 70}",) for i in range(300)], "x string").repartition(5)
    assert audit.set_digest(lines, F.col("x")).first().digest == hashlib.sha256("".join(f"{x}\n" for x in sorted(f"l{i % 70}" for i in range(300))).encode()).hexdigest()
    assert audit.set_digest(lines.limit(0), F.col("x")).first().digest == hashlib.sha256(b"").hexdigest()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    nodes = [sha("\n".join(str(i) for i in range(a, min(a + 3, 40)))) for a in range(0, 40, 3)]
    while True:
        nodes = [sha("".join(nodes[a : a + 3])) for a in range(0, len(nodes), 3)]
        if len(nodes) == 1:
            break
    assert audit.digest_tree(spark.range(40), [F.col("id")], F.col("id").cast("string"), 3).first().digest == nodes[0]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(K.escape(F.lit("a\\b\tc\nd"))) == "a\\\\b\\tc\\nd"
    assert one(K.sanitize(F.lit("a\nb\x01"))) == "a b�"
    assert [one(K.file_type(F.lit(p))) for p in ("a/b.MDX", "a/.x", "a/x.", "a/x", "d.e/f")] == ["mdx", "other", "other", "other", "other"]
    assert one(K.canonical_url(F.lit("HTTPS://A.b/C#d"))) == "https://a.b/C"
    assert one(K.decoded_path(F.lit("a%20b/c+d"))) == "a b/c+d" and one(K.decoded_path(F.lit("a/%2e%2e/b"))) is None
    assert one(K.relative_path_ok(F.lit("a/../b.mdx"), F.lit("mdx"))) is False and one(K.relative_path_ok(F.lit("a/b.mdx"), F.lit("mdx")))
    assert [one(K.public_https(F.lit(u))) for u in ("https://a.example/x", "http://a.example/", "https://10.0.0.1/", "https://u@a.example/", "https://localhost/")] == [True, False, False, False, False]
    assert one(K.versions_agree(F.lit("2.0"), F.lit("1.2"))) and not one(K.versions_agree(F.lit("1.2"), F.lit("2.0")))
    assert one(K.trim_nuls(F.lit("a\x00b\x00\x00"))) == "a\x00b"
    assert one(K.iso_timestamp(F.lit("2026-08-10T02:00:00+02:00"))) == "2026-08-10T00:00:00.000Z"


def test_catalogue(spark):
    row = '<tr class="file"><td><a href="{0}">x</a></td><td data-order="{1}"></td></tr>'
    pages = spark.createDataFrame([("https://h/r/", row.format("a/", -1) + row.format("x.mdx", 10) + row.format("y%20z.mdd", 3)), ("https://h/r/a/", row.format("q.MDX", 7) + row.format("../", -1)), ("https://h/r/b/", row.format("lost.mdx", 1))], "url string, html string")
    files, n = catalogue.crawl(pages, "https://h/r/")
    assert n == 2 and sorted((r.path, r.type, r.bytes) for r in files.collect()) == [("a/q.MDX", "mdx", 7), ("x.mdx", "mdx", 10), ("y z.mdd", "mdd", 3)]
    chosen = catalogue.select(files, "mdx")
    assert catalogue.selection_violations(chosen, files, "mdx").count() == 0
    assert catalogue.selection_violations(chosen.limit(1), files, "mdx").count() == 1
    assert catalogue.repeated(chosen.union(chosen), "id").count() == 2
    entries = spark.createDataFrame([("t", "MDX", "https://i/#a", True, ["https://d/x.zip", "https://d/y.mdx#1"]), ("t", "MDX", "https://i/#b", True, ["https://d/y.mdx", "https://d/x.zip"]), ("u", "MDX", "https://i/", False, [])], "title string, type string, url string, downloadable boolean, downloadUrls array<string>")
    candidates, urls = catalogue.import_candidates(entries)
    assert sorted(r.occurrences for r in candidates.collect()) == [1, 2]
    assert {r.url: (r.classification, len(r.references)) for r in urls.collect()} == {"https://i/": ("other", 2), "https://d/x.zip": ("archive", 1), "https://d/y.mdx": ("mdx", 1)}
    reviews = spark.sql("select 'e' as entry_id, named_struct('status','approved','testingAllowed',false,'redistributionAllowed',true,'license','MIT','licenseUrl',null,'reviewedBy','x','reviewedAt','nope','notes','') as review")
    assert sorted(r.violation for r in catalogue.review_violations(reviews).collect()) == ["approved without reviewer, time or notes", "approved without testing", "bad review time", "redistribution without license"]
    a = spark.createDataFrame([("p", 1), ("q", 2)], "path string, x long")
    b = spark.createDataFrame([("p", 1), ("q", 3), ("r", 1)], "path string, x long")
    assert {r.path: r.side for r in catalogue.pair_violations(a, b, ["x"]).collect()} == {"q": "differs", "r": "outcomes only"}
    assert [r.position for r in catalogue.zip_violations(a, b, ["path", "x"]).orderBy("position").collect()] == [1, 2]


def test_manifest(spark, tmp_path):
    (tmp_path / "f/x").mkdir(parents=True)
    (tmp_path / "f/y").mkdir()
    (tmp_path / "f/x/a.mdx").write_bytes(b"abc")
    (tmp_path / "f/y/b.mdx").write_bytes(b"abcd")  # not x/b.mdx
    sha = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    (tmp_path / "m.tsv").write_text(f"# note\npath\tkind\tbytes\tsha256\tentries\nx/a.mdx\tmdx\t3\t{sha}\t1\nx/b.mdx\tmdx\t4\t{sha}\t1\n")
    m = catalogue.read_manifest(spark, str(tmp_path / "m.tsv"), 5)
    assert m.count() == 2 and [r.path for r in catalogue.verify_files(spark, m, str(tmp_path / "f")).collect()] == ["x/b.mdx"]


def test_queries_against_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in os.listdir(sf):
        path = f"{sf}/{t}" + ("/*.parquet" if os.path.isdir(f"{sf}/{t}") else "")
        db.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{path}')")
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        cols = sorted(df.columns)
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
        found = db.execute(ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        want = sorted((tuple(r[names.index(c)] for c in cols) for r in found.fetchall()), key=repr)
        assert got == want, name


def held_against_sql(spark, d, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in os.listdir(d):
        db.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{d}/{t}/*.parquet')")
    df = QUERIES[name](spark, str(d))
    found = db.execute(ORACLE_SQL[name])
    want = [dict(zip((x[0] for x in found.description), r, strict=True)) for r in found.fetchall()]
    got = [r.asDict() for r in df.collect()]
    key = lambda r: repr([r[c] for c in sorted(df.columns)])
    assert sorted(map(key, got)) == sorted(map(key, want)) and got
    return df


def test_lookup_span_of_shared_keys(spark, tmp_path):
    """Pages with one URL, with none, without html, and of one id."""
    rows = [(0, "https://a/x", "ab"), (1, "http://a/x", "cde"), (2, None, "f"), (3, "https://a/x", None), (4, "https://b", "\u00e9"), (70_000, "https://b", "gh"), (70_000, "https://c", "i"), (70_001, "https://b", "jkl"), (None, "https://d", "mn")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    held_against_sql(spark, tmp_path, "lookup_span")


def most_rows(df):
    """The most rows that a node of the plan gave, of all that count them."""
    df.collect()
    most, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            most = max(most, metric.get().value())
        left.extend(node.children().apply(i) for i in range(node.children().size()))
    return most


def test_nth_match_of_large_groups(spark, tmp_path):
    """A thousand parts of one name: the queries don't meet all of its keys; against SQL, with repeated and missing ids too."""
    n = 1000
    rows = [(i, "same name", "t") for i in range(n)] + [(n + i, f"few {i // 2}", "t") for i in range(12)] + [(n + 50, "Few \u03a3", "t"), (n + 50, "few 1", "t"), (None, "few 2", "t"), (n + 51, None, "t")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    assert most_rows(held_against_sql(spark, tmp_path, "nth_match")) <= 3 * len(rows)
