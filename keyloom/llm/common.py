"""Shared plumbing: the job's shared folder, written tables, bounded Arrow batches, unused column names."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from keyloom.operators.stored import fresh_path, release  # noqa: F401

#: Arrow batches handed to Python hold at most this many bytes and rows, so a
#: batch of very long texts stays small whatever the row count.
BATCH_BYTES = 2 << 20
BATCH_ROWS = 8192

_shipped: set[str] = set()

Batches = Iterator[pa.RecordBatch]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="keyloom-")) / "keyloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "keyloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes and rows, and ship the package.

    Registered queries and pipeline stages call it; the operators leave a
    caller's settings alone.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class _Table:
    """Files that tasks write, of which the driver keeps those of attempts that succeeded."""

    def __init__(self, path: str) -> None:
        self.path = path

    def open(self):
        """pyarrow's file system of the folder, and the folder's path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def written(self, batches: Batches) -> Batches:
        """Write a task's batches as one file under a name of its own; gives the name and the rows."""
        import pyarrow.parquet as pq

        files, base = self.open()
        name, writer, held, size, rows = f"part-{uuid.uuid4().hex}.parquet", None, [], 0, 0
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                if writer is None:
                    writer = pq.ParquetWriter(f"{base}/_attempts/{name}", b.schema, filesystem=files, compression="snappy", use_dictionary=False, write_statistics=False)
                held.append(b)
                size, rows = size + b.nbytes, rows + b.num_rows
                if size >= GROUP_BYTES:
                    writer.write_table(pa.Table.from_batches(held), row_group_size=1 << 30)
                    held, size = [], 0
            if held:
                writer.write_table(pa.Table.from_batches(held), row_group_size=1 << 30)
        finally:
            if writer is not None:
                writer.close()
            give_back()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows])], ["name", "rows"])

    def keep(self, names: list[str]) -> None:
        files, base = self.open()
        for name in names:
            files.move(f"{base}/_attempts/{name}", f"{base}/{name}")
        files.delete_dir(f"{base}/_attempts")


GROUP_BYTES = 8 << 20  #: of a row group


def _stored(df: DataFrame, tag: str, fn: Callable[[Batches], Batches] | None, schema: StructType) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    table = _Table(path)
    try:
        files, base = table.open()
        files.create_dir(f"{base}/_attempts", recursive=True)
    except (pa.ArrowException, OSError):  # only Spark's own writers reach the folder
        (df if fn is None else df.mapInArrow(slim(fn), schema)).write.parquet(path)
    else:
        ship(spark)
        kinds = to_arrow_schema(schema)

        def run(batches: Batches) -> Batches:
            made = batches if fn is None else fn(batches)
            yield from table.written(b if b.schema.equals(kinds) else b.rename_columns(kinds.names).cast(kinds) for b in made)

        safe = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # mapInArrow takes no names with dots or backticks
        table.keep([r["name"] for r in safe.mapInArrow(run, "name string, rows long").collect()])
    found = spark.read.schema(schema).parquet(path)
    found._written_to = path
    return found


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and leaves joins on the
    result free to insert exchanges that adaptive execution can split. Tasks
    write their files themselves, as most tables come out of Python anyway, and
    the driver keeps the files of the attempts that succeeded.
    """
    return _stored(df, tag, None, df.schema)


def mapped(df: DataFrame, fn: Callable[[Batches], Batches], schema: str | StructType, tag: str) -> DataFrame:
    """``materialize(df.mapInArrow(fn, schema), tag)``, where the rows don't leave Python between the two."""
    kind = schema if isinstance(schema, StructType) else _parse_datatype_string(schema)
    return _stored(df, tag, fn, kind)


def map_named(df: DataFrame, fn: Callable[[Batches], Batches], schema: StructType) -> DataFrame:
    """``df.mapInArrow(fn, schema)`` for columns of any name, which ``mapInArrow`` itself can't take: ``fn`` sees and gives columns by place."""
    safe = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])

    def run(batches: Batches) -> Batches:
        for b in fn(batches):
            yield b.rename_columns(safe.names)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(slim(run), safe).toDF(*schema.names)


def free(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as none of ``columns`` clashes with (Spark's names have no case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: Iterable[str]) -> list[str]:
    """Names as Spark takes them whatever they hold, dots and backticks too."""
    return ["`" + c.replace("`", "``") + "`" for c in columns]


def slim(fn: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``fn`` as the body of ``mapInArrow``; when its task ends, the worker, which Spark keeps, gives free memory back."""

    def run(batches: Batches) -> Batches:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def binary_rows(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column without nulls, of ``width`` numbers in each row, as a matrix that shares its memory."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(kind).reshape(len(column), width)


def binary_column(rows: np.ndarray) -> pa.Array:
    """A matrix as a binary column, a row in each; see :func:`binary_rows`."""
    data = np.ascontiguousarray(rows)
    width = data.dtype.itemsize * data.shape[1]
    offsets = (np.arange(len(data) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def without(docs: DataFrame, gone: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` but those of a document in ``gone`` (doc: a doc_id, th: :func:`text_hash`).

    With ``met`` (doc and th of every row) one row of each doc_id and text
    stays. Only rows that are repeated are shuffled for that, and none is
    for ``gone`` where it turns out small.
    """
    key, th, gone_key, gone_th = free(docs.columns, "_key", "_th", "_gone_key", "_gone_th")
    same = (F.col(key) == F.col(gone_key)) & (F.col(th) == F.col(gone_th))

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.xxhash64("doc").alias(gone_key), F.col("th").alias(gone_th))

    kept = docs.withColumns({key: F.xxhash64("doc_id"), th: text_hash()}).join(named(gone).distinct(), same, "left_anti")
    if met is not None:
        twice = materialize(named(met).groupBy(gone_key, gone_th).count().where("count > 1").select(gone_key, gone_th), "twice")
        if twice.isEmpty():
            release(twice)
        else:
            kept = kept.join(twice, same, "left_anti").union(kept.join(twice, same, "left_semi").dropDuplicates([key, th]))
    return kept.select(*quoted(docs.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
