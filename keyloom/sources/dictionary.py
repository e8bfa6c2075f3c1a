"""Data sources ``mdx`` and ``mdd``: containers as tables.

    register(spark)
    spark.read.format("mdx").option("columns", "entries").load("/data/*.mdx")

Options: ``columns`` (keys, spans, entries: nothing beyond what they need is
read), ``table`` (rows, header, attributes, key_blocks, record_blocks,
sections, memory), ``passcode.regcode`` and ``passcode.userid``, ``limits`` (default,
large), ``limit.<name>``, ``mode`` (FAILFAST, or PERMISSIVE: each range of key
blocks gives its rows up to the damage and then one row with ``_error``; a file
that doesn't open is one such row), ``locator`` (with ``table=memory``: build
the lookup index first), ``entriesperpartition``, ``pushdown`` (ordinal filters prune key blocks;
needs spark.sql.python.filterPushdown.enabled).

A task reads a range of key blocks, one block to look back, and the record
blocks that its rows cover. Ranges are planned from the files' indexes, many
files at a time. Paths must be reachable from every executor.
"""

from __future__ import annotations

import glob
import os
from bisect import bisect_left
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from keyloom.sources.wire.crypto import Passcode
from keyloom.sources.wire.errors import ContainerError
from keyloom.sources.wire.layout import Container
from keyloom.sources.wire.limits import Limits

PAYLOAD = {"mdx": "text string", "mdd": "bytes binary"}
TABLES = {
    "header": "dict_id string, entries long, wire_version int, raw_xml string, tag_name string, generated_by_engine_version string, required_engine_version string, encoding_label string, format string, key_case_sensitive boolean, strip_key boolean, encrypted int, register_by string, reg_code string, description string, title string, creation_date string, metadata_bytes long",
    "attributes": "dict_id string, position int, name string, value string",
    "key_blocks": "dict_id string, block long, entry_start long, entry_count long, first_key string, last_key string, comp_offset long, comp_size long, decomp_size long",
    "record_blocks": "dict_id string, block long, comp_offset long, comp_size long, decomp_offset long, decomp_size long",
    "memory": "dict_id string, current_bytes long, peak_bytes long, metadata_bytes long, locator_bytes long, key_cache_bytes long, record_cache_bytes long",
    "sections": "dict_id string, position int, section string, start long, end long",
}
BATCH_ROWS, BATCH_BYTES = 8192, 8 << 20
OPENED = 32  #: files whose indexes are read at once when ranges are planned


@dataclass
class Blocks(InputPartition):
    path: str
    first: int
    last: int | None
    wanted: tuple[int, int] | None = None

    def __init__(self, path: str, first: int, last: int | None, wanted: tuple[int, int] | None = None) -> None:
        super().__init__(path)
        self.path, self.first, self.last, self.wanted = path, first, last, wanted


def expand(path: str) -> list[str]:
    """Files of a path, a folder, a pattern, or several parted by commas."""
    out: list[str] = []
    for p in path.split(","):
        p = p.strip().removeprefix("file://").removeprefix("file:")
        if "://" in p:
            from pyarrow import fs

            files, inner = fs.FileSystem.from_uri(p)
            scheme = p[: len(p) - len(inner)] if p.endswith(inner) else p.split("://")[0] + "://"
            folder = files.get_file_info(inner).type == fs.FileType.Directory
            out += sorted(scheme + x.path for x in files.get_file_info(fs.FileSelector(inner)) if x.path.endswith((".mdx", ".mdd"))) if folder else [p]
        elif os.path.isdir(p):
            out += sorted(os.path.join(p, x) for x in os.listdir(p) if x.endswith((".mdx", ".mdd")))
        else:
            out += sorted(glob.glob(p)) or [p]
    return out


class Options:
    """What a reader was told; ``repr`` keeps the passcode to itself."""

    def __init__(self, kind: str, options: dict[str, str]) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.kind, self.paths = kind, expand(low.get("path", ""))
        self.columns, self.table = low.get("columns", "entries").lower(), low.get("table", "rows").lower()
        self.permissive = low.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.limits = Limits.of(low)
        self.rows = int(low.get("entriesperpartition", 250_000))
        self.pushdown = low.get("pushdown", "false").lower() == "true"
        self.locator = low.get("locator", "false").lower() == "true"
        code = low.get("passcode.regcode")
        self.passcode = Passcode(code, low.get("passcode.userid", "")) if code else None
        if self.columns not in ("keys", "spans", "entries") or self.table not in ("rows", *TABLES):
            raise ValueError("columns must be keys, spans or entries; table must be rows or one of " + ", ".join(TABLES))

    def open(self, path: str) -> Container:
        return Container(path, self.kind, self.passcode, self.limits)

    def schema(self) -> str:
        if self.table != "rows":
            return TABLES[self.table]
        out = "dict_id string, ordinal long, key string"
        if self.columns != "keys":
            out += ", record_start long, record_end long, len long"
        if self.columns == "entries":
            out += f", {PAYLOAD[self.kind]}"
        return out + (", _error string" if self.permissive else "")


class Reader(DataSourceReader):
    def __init__(self, options: Options) -> None:
        self.options = options
        self.low, self.high = 0, None
        self.places: list[int] | None = None  # ascending ordinals, where a filter lists them

    def _ranges(self, path: str) -> list[Blocks]:
        """Ranges of a file's key blocks that hold wanted rows."""
        o, out = self.options, []
        try:
            c = o.open(path)
        except ContainerError:
            if not o.permissive:
                raise
            return [Blocks(path, 0, None)]
        blocks = c.layout.key_blocks
        c.close()
        wanted = (self.low, len(c) if self.high is None else min(self.high, len(c)))
        use = [i for i, b in enumerate(blocks) if b.first < wanted[1] and b.first + b.count > wanted[0]]
        if self.places is not None:
            use = [i for i in use if (k := bisect_left(self.places, blocks[i].first)) < len(self.places) and self.places[k] < blocks[i].first + blocks[i].count]
        first, held, last = None, 0, None
        for i in use:
            if first is not None and i != last + 1:
                out.append(Blocks(path, first, last + 1, wanted))
                first, held = None, 0
            first, last = i if first is None else first, i
            held += blocks[i].count
            if held >= o.rows:
                out.append(Blocks(path, first, i + 1, wanted))
                first, held = None, 0
        if first is not None:
            out.append(Blocks(path, first, last + 1, wanted))
        return out

    def partitions(self) -> list[Blocks]:
        o = self.options
        if o.table != "rows":
            return [Blocks(path, 0, None) for path in o.paths] or [Blocks("", 0, 0)]
        with ThreadPoolExecutor(OPENED) as pool:
            out = [x for part in pool.map(self._ranges, o.paths) for x in part]
        return out or [Blocks("", 0, 0)]

    def read(self, partition: Blocks) -> Iterator:
        if not partition.path:
            return iter(())
        return self._rows(partition) if self.options.table == "rows" else self._metadata(partition.path)

    def _metadata(self, path: str) -> Iterator[tuple]:
        c = self.options.open(path)
        layout, h = c.layout, c.layout.header
        if self.options.table == "header":
            yield (path, layout.entries, layout.grammar.version, h.raw_xml, h.tag_name, h.generated_by_engine_version, h.required_engine_version, h.encoding_label, h.format, h.key_case_sensitive, h.strip_key, h.encrypted, h.register_by, h.reg_code, h.description, h.title, h.creation_date, layout.metadata_bytes)
        elif self.options.table == "attributes":
            yield from ((path, i, n, v) for i, (n, v) in enumerate(h.attributes))
        elif self.options.table == "key_blocks":
            yield from ((path, i, *astuple(b)) for i, b in enumerate(layout.key_blocks))
        elif self.options.table == "record_blocks":
            yield from ((path, i, b.offset, b.size, b.start, b.content) for i, b in enumerate(layout.record_blocks))
        elif self.options.table == "memory":
            if self.options.locator:
                c.locator()
            yield (path, *astuple(c.memory_usage()))
        else:
            yield from ((path, i, *s) for i, s in enumerate(layout.sections))
        c.close()

    def _rows(self, p: Blocks) -> Iterator[pa.RecordBatch]:
        o = self.options
        names = [x.split()[0] for x in o.schema().split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in o.schema().split(", ")]
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

        try:
            c = o.open(p.path)
            for ordinal, key, start, end in c.rows(p.first, p.last, o.columns != "keys"):
                if p.wanted and not p.wanted[0] <= ordinal < p.wanted[1]:
                    continue
                row = [p.path, ordinal, key]
                if o.columns != "keys":
                    row += [start, end, end - start]
                if o.columns == "entries":
                    row.append(c.text(start, end) if o.kind == "mdx" else c.payload(start, end))
                    size += end - start
                held.append(row + [None] * o.permissive)
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch()
                    held, size = [], 0
            c.close()
        except ContainerError as e:
            if not o.permissive:
                raise
            held.append([p.path] + [None] * (len(names) - 2) + [str(e)])
        if held:
            yield batch()


class PruningReader(Reader):
    """Takes comparisons of ``ordinal`` with constants and leaves the rest to Spark."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) != ("ordinal",):
                yield f
            elif isinstance(f, EqualTo):
                self._narrow(f.value, f.value + 1)
            elif isinstance(f, GreaterThan):
                self._narrow(f.value + 1, None)
            elif isinstance(f, GreaterThanOrEqual):
                self._narrow(f.value, None)
            elif isinstance(f, LessThan):
                self._narrow(0, f.value)
            elif isinstance(f, LessThanOrEqual):
                self._narrow(0, f.value + 1)
            else:
                if isinstance(f, In):
                    values = sorted({v for v in f.value if v is not None})
                    self._narrow(min(values, default=0), max(values, default=-1) + 1)
                    self.places = values if self.places is None else sorted(set(values).intersection(self.places))
                yield f

    def _narrow(self, low: int, high: int | None) -> None:
        self.low = max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)


class _Source(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return Options(self.kind, dict(self.options)).schema()

    def reader(self, schema) -> DataSourceReader:
        options = Options(self.kind, dict(self.options))
        return (PruningReader if options.pushdown else Reader)(options)


class MdxSource(_Source):
    kind = "mdx"


class MddSource(_Source):
    kind = "mdd"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MdxSource)
    spark.dataSource.register(MddSource)


def keys_table(spark: SparkSession, kind: str, path: str, **options: str):
    """Keys with their normal form by the flags of the files' own headers."""
    from pyspark.sql import functions as F

    from keyloom.functions.keys import norm_key

    keys = spark.read.format(kind).options(columns="keys", **options).load(path)
    flags = spark.read.format(kind).options(table="header", **options).load(path).select("dict_id", "key_case_sensitive", "strip_key")
    out, resource = None, kind == "mdd"
    for case in (False, True):
        for strip in (False, True):
            form = norm_key(F.col("key"), case, strip, resource)
            cond = (F.col("key_case_sensitive") == case) & (F.col("strip_key") == strip)
            out = F.when(cond, form) if out is None else out.when(cond, form)
    return keys.join(flags, "dict_id").withColumn("norm_key", out).select("dict_id", "ordinal", "key", "norm_key")
