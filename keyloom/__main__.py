"""``python -m keyloom``: containers and catalogues from the command line.

    inspect FILE...            header and first entries
    verify MANIFEST FOLDER     files that are missing or differ
    audit OUT FILE...          every row read and looked up; OUT is written if all pass
    inventory PAGES ROOT       the inventory of stored index pages (Parquet: url, html), as JSON
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession, functions as F

from keyloom.plans import artifacts, catalogue
from keyloom.sources.dictionary import expand, register


def _listed(spark: SparkSession, paths: list[str]):
    return spark.createDataFrame([(p, p[-3:].lower()) for x in paths for p in expand(x)], "path string, kind string")


def inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    register(spark)
    for r in _listed(spark, args.files).collect():
        rows = spark.read.format(r["kind"])
        rows.option("table", "header").load(r["path"]).drop("raw_xml").show(truncate=60, vertical=True)
        if r["kind"] == "mdx":
            artifacts.preview(spark.read.format("mdx").option("pushdown", "true").load(r["path"]).where(F.col("ordinal") < args.rows), args.rows).show(truncate=False)
    return 0


def verify(spark: SparkSession, args: argparse.Namespace) -> int:
    wrong = catalogue.verify_files(spark, catalogue.read_manifest(spark, args.manifest, args.columns), args.folder)
    n = wrong.count()
    wrong.show(50, truncate=False) if n else print("all files are as the manifest says")
    return int(n > 0)


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    done = artifacts.audit(_listed(spark, args.files), seconds=args.seconds, tasks=args.tasks).persist()
    done.select("path", "status", "entries", "duration_ms", "error").show(1000, truncate=120)
    try:
        catalogue.write_audit(done, args.out)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def inventory(spark: SparkSession, args: argparse.Namespace) -> int:
    files, pages = catalogue.crawl(spark.read.parquet(args.pages), args.root)
    print(catalogue.inventory_json(files, args.root, pages, args.snapshot), end="")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="keyloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(required=True)

    def command(run, *options: tuple, **more) -> None:
        own = commands.add_parser(run.__name__, **more)
        own.set_defaults(run=run)
        for name, given in options:
            own.add_argument(name, **given)

    command(inspect, ("files", {"nargs": "+"}), ("--rows", {"type": int, "default": 5}))
    command(verify, ("manifest", {}), ("folder", {}), ("--columns", {"type": int, "choices": (5, 7), "default": 7}))
    command(audit, ("out", {}), ("files", {"nargs": "+"}), ("--seconds", {"type": float, "default": artifacts.DEADLINE}), ("--tasks", {"type": int}))
    command(inventory, ("pages", {}), ("root", {}), ("--snapshot", {"required": True}))
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.python.filterPushdown.enabled", "true").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
