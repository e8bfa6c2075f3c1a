"""Sinks: digests of every entry, resources as files, facts and outcomes."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from keyloom.functions.keys import escape
from keyloom.operators.prefix import div
from keyloom.sources.wire.writer import Style, Writer

FACTS = ("kind", "path", "metric", "value", "unit")


def entry_lines(entries: DataFrame, payload: str) -> DataFrame:
    """``ordinal, value``: SHA-256 of the payload, tab, escaped key."""
    return entries.select("ordinal", F.concat_ws("\t", F.sha2(F.col(payload).cast("binary"), 256), escape(F.col("key"))).alias("value"))


def dump(entries: DataFrame, payload: str, path: str) -> None:
    """The lines of :func:`entry_lines` as text files, in ordinal order across files."""
    entry_lines(entries, payload).repartitionByRange("ordinal").sortWithinPartitions("ordinal").select("value").write.text(path)


def copy_resources(resources: DataFrame, folder: str, name: str = "key") -> DataFrame:
    """Write every resource (ordinal, key, bytes) below ``folder``, which all executors share; (ordinal, file, bytes_written).

    A name that leaves the folder is an error row without file. Files are
    written beside their place and renamed, so a repeated task is harmless.
    """

    def write(rows: Iterator[Row]) -> Iterator[tuple]:
        base = Path(folder).resolve()
        for row in rows:
            target = (base / row[name].replace("\\", "/").lstrip("/")).resolve()
            if base not in target.parents:
                yield row["ordinal"], None, None
                continue
            target.parent.mkdir(parents=True, exist_ok=True)
            yield row["ordinal"], str(target), write_atomic(target, bytes(row["bytes"]))

    def batches(parts):
        import pyarrow as pa

        for b in parts:
            done = list(write(Row(**x) for x in b.to_pylist()))
            if done:
                cols = list(zip(*done, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["ordinal", "file", "bytes_written"])

    return resources.select("ordinal", F.col(name), "bytes").mapInArrow(batches, "ordinal long, file string, bytes_written long")


def write_containers(entries: DataFrame, folder: str, kind: str, rows: int = 250_000, style: Style | None = None) -> DataFrame:
    """Write entries (ordinal from 0 without gaps, key, payload) as containers of ``rows`` entries each below ``folder``.

    Gives (path, first, entries). A task streams the rows of a file; files are
    written beside their place and moved, so a repeated task is harmless. Lazy:
    write the result down before it is used twice.
    """
    style = style or Style()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(base, recursive=True)
        shard, writer, done = None, None, []

        def close() -> None:
            name, temporary = f"{base}/part-{shard:06d}.{kind}", f"{base}/.{uuid.uuid4().hex}"
            with files.open_output_stream(temporary, compression=None) as sink:
                n = writer.close(sink)
            files.move(temporary, name)
            done.append((name, shard * rows, n))

        for b in batches:
            for at, key, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if at // rows != shard:
                    if writer:
                        close()
                    shard, writer = at // rows, Writer(kind, style)
                writer.add(key, body)
        if writer:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "first", "entries"])

    dealt = entries.select("ordinal", "key", "payload").withColumn("_file", div("ordinal", rows)).repartition("_file").sortWithinPartitions("_file", "ordinal")
    return dealt.select("ordinal", "key", "payload").mapInArrow(run, "path string, first long, entries long")


def for_each_chunk(chunks: DataFrame, sink: Callable[[Iterator[Row]], None]) -> None:
    """Hand chunks (ordinal, chunk, data) to a writer, a record's chunks in order in one task."""
    chunks.repartition("ordinal").sortWithinPartitions("ordinal", "chunk").foreachPartition(sink)


def write_atomic(path: str | Path, data: bytes | str) -> int:
    """Write beside the place, flush to disk, rename; returns the bytes written."""
    body = data.encode() if isinstance(data, str) else data
    fd, temporary = tempfile.mkstemp(dir=Path(path).parent, prefix=".tmp-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(body)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        Path(temporary).unlink(missing_ok=True)
        raise
    return len(body)


def facts_lines(facts: list[tuple]) -> str:
    """Benchmark facts by tabs; line breaks and tabs in a field become spaces."""
    clean = lambda x: " ".join(str(x).split())
    return "".join("\t".join(map(clean, row)) + "\n" for row in [FACTS, *facts])


def outcome_json(outcome: DataFrame) -> DataFrame:
    return outcome.select(F.to_json(F.struct(*outcome.columns)).alias("value"))


def stable_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False) + "\n"
