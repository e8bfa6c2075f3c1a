"""Arriving containers as a stream of keys: an extension, the format itself has no streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from keyloom.sources.wire.errors import ContainerError
from keyloom.sources.wire.layout import Container

FILES = "path string, modificationTime timestamp, length long, content binary"
KEYS = "dict_id string, ordinal long, key string, _error string"


def arriving_keys(spark: SparkSession, folder: str, kind: str, files_per_trigger: int = 64) -> DataFrame:
    """Keys of every container that appears in ``folder``; a damaged one ends in a row with ``_error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["dict_id", "ordinal", "key", "_error"])

        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[tuple] = []
                try:
                    for ordinal, key, _, _ in Container(path, kind).rows(spans=False):
                        rows.append((path, ordinal, key, None))
                        if len(rows) == 8192:
                            yield made(rows)
                            rows = []
                except ContainerError as e:
                    rows.append((path, None, None, str(e)))
                if rows:
                    yield made(rows)

    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", f"*.{kind}").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path")).mapInArrow(run, KEYS)
