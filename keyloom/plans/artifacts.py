"""Audits of whole containers, one task each: every row read, looked up by place and by key, digested.

An audit has a deadline and works on the bytes that it began with: a file that
changes meanwhile, takes too long or is damaged is a row with its error, not a
failed task.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keyloom.sources import probe as geometry
from keyloom.sources.wire.errors import ContainerError, ensure
from keyloom.sources.wire.layout import Container
from keyloom.sources.wire.limits import Limits

OUTCOME = "path string, kind string, status string, entries long, payload_bytes long, key_sha256 string, payload_sha256 string, tags string, peak_bytes long, sha256 string, duration_ms long, error_class string, error string"
MESSAGE = 4096  #: characters of an error that are kept
DEADLINE = 3600.0  #: seconds for a container
EVERY = 256  #: rows between looks at the clock
NAMES = {0: "none", 1: "lzo", 2: "zlib"}


class Deadline:
    def __init__(self, seconds: float) -> None:
        self.end, self.left = time.monotonic() + seconds, EVERY

    def __call__(self) -> None:
        """Raises once the time is over; looks at the clock now and then."""
        self.left -= 1
        if not self.left:
            self.left = EVERY
            if time.monotonic() > self.end:
                raise TimeoutError("the audit took longer than its deadline")


def identity(path: str) -> str:
    """SHA-256 of a file, streamed."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _digested(kind: str, protocol: str, keys, payloads, ordinal: int, key: str, body: bytes) -> None:
    data = key.encode()
    if protocol == "ordered":
        part = ordinal.to_bytes(8, "big") + len(data).to_bytes(8, "big") + data
        keys.update(part)
        payloads.update(part + len(body).to_bytes(8, "big") + body)
    else:
        keys.update(data + b"\n")
        payloads.update(body + b"\n" if kind == "mdx" else hashlib.sha256(body).digest())


def _look_up(c: Container, ordinal: int, key: str, seen: set[int]) -> None:
    """The key's lookup must be by its raw form and give its group: ascending ordinals from this one on, each with this very key.

    The group is looked at once, by its first member; ``seen`` has the members
    still to come.
    """
    if ordinal in seen:  # with its group
        seen.remove(ordinal)
        return
    basis, found = c.locate(key) or ("", [])
    ensure(basis == "RawExact", "lookup of a key isn't by its raw form", ordinal=ordinal)
    ensure(found[0] == ordinal, "lookup of a key omits its ordinal", ordinal=ordinal)
    ensure(all(a < b for a, b in zip(found, found[1:], strict=False)), "ordinals of a key don't ascend", ordinal=ordinal)
    for other in found[1:]:
        row = c.row(other, spans=False)
        ensure(row is not None and row[1] == key, "lookup of a key gives another key", ordinal=ordinal)
    seen.update(found[1:])


def audit_container(path: str, kind: str, limits: Limits | None = None, protocol: str = "ordered", seconds: float = DEADLINE, lookups: bool = True) -> dict:
    """Facts of one container: entries, payload bytes, digests.

    Every row is read in order and again by its ordinal; with ``lookups`` each
    key is looked up too. ``ordered`` digests ordinals and lengths with the
    data; ``lines`` ends keys and texts by a line break and digests resources by
    their own digests.
    """
    late, before = Deadline(seconds), identity(path)
    c, again, finder = (Container(path, kind, limits=limits) for _ in range(3))
    keys, payloads, size, at, seen = hashlib.sha256(), hashlib.sha256(), 0, 0, set()
    try:
        for ordinal, key, start, end in c.rows():
            late()
            ensure(ordinal == at, "ordinals aren't contiguous", expected=at, actual=ordinal)
            ensure(again.row(ordinal) == (ordinal, key, start, end), "a row by its ordinal differs from the scan's", ordinal=ordinal)
            if lookups:
                _look_up(finder, ordinal, key, seen)
            body = c.text(start, end).encode() if kind == "mdx" else c.payload(start, end)
            _digested(kind, protocol, keys, payloads, ordinal, key, body)
            size, at = size + len(body), at + 1
        ensure(not seen, "lookups gave ordinals that the scan doesn't have", left=len(seen))
        ensure(at == len(c), "entries differ from the header", expected=len(c), actual=at)
        tags = {c.read(b.offset, 1, "block")[0] for b in (*c.layout.key_blocks, *c.layout.record_blocks)}
        peak = max(x.memory_usage().peak_bytes for x in (c, finder))
    finally:
        for x in (c, again, finder):
            x.close()
    ensure(identity(path) == before, "the file changed during its audit", "Io")
    return {"entries": at, "payload_bytes": size, "key_sha256": keys.hexdigest(), "payload_sha256": payloads.hexdigest(), "tags": ",".join(sorted(NAMES[t] for t in tags)), "peak_bytes": peak, "sha256": before}


def _each(artifacts: DataFrame, columns: tuple[str, ...], schema: str, facts: Callable[..., dict], tasks: int | None) -> DataFrame:
    """A row of ``facts`` for every artifact; ``tasks``: how many work at once, at most (all, if not given)."""
    names = [x.split(" ", 1)[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.split(" ", 1)[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = dict.fromkeys(names) | dict(zip(columns, own, strict=True)) | facts(*own)
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(names, types, strict=True)], names)

    dealt = artifacts.select(*columns)
    return (dealt.repartition(tasks) if tasks else dealt.repartition("path")).mapInArrow(run, schema)


def audit(artifacts: DataFrame, options: dict[str, str] | None = None, protocol: str = "ordered", seconds: float = DEADLINE, lookups: bool = True, tasks: int | None = None) -> DataFrame:
    """Outcomes of ``artifacts`` (path, kind); a damaged one is a row with its error. See OUTCOME."""
    limits = Limits.of(options or {})

    def facts(path: str, kind: str) -> dict:
        began, row = time.monotonic(), {"status": "passed"}
        try:
            row |= audit_container(path, kind, limits, protocol, seconds, lookups)
        except ContainerError as e:
            row |= {"status": "failed", "error_class": e.kind, "error": str(e)[:MESSAGE]}
        except (TimeoutError, OSError) as e:
            row |= {"status": "failed", "error_class": "Timeout" if isinstance(e, TimeoutError) else "Io", "error": str(e)[:MESSAGE]}
        return row | {"duration_ms": int(1000 * (time.monotonic() - began))}

    return _each(artifacts, ("path", "kind"), OUTCOME, facts, tasks)


def streamed(artifacts: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """``path, resources, bytes, agree``: every resource of ``artifacts`` (path) copied by chunks, against its materialized bytes."""
    limits = Limits.of(options or {})

    def facts(path: str) -> dict:
        one, two, n, size, agree = Container(path, "mdd", limits=limits), Container(path, "mdd", limits=limits), 0, 0, True
        for _, _, start, end in one.rows():
            sha = _Sha()
            size += two.copy_to(start, end, sha)
            agree = agree and sha.digest() == hashlib.sha256(one.payload(start, end)).digest()
            n += 1
        one.close()
        two.close()
        return {"resources": n, "bytes": size, "agree": agree}

    return _each(artifacts, ("path",), "path string, resources long, bytes long, agree boolean", facts, None)


EXPORTED = "path string, ordinal long, file string, bytes_written long, error string"


def export(artifacts: DataFrame, folder: str, options: dict[str, str] | None = None) -> DataFrame:
    """Every resource of ``artifacts`` (path) as a file below ``folder``, which all executors share; see EXPORTED.

    Resources are copied by chunks, so one may be larger than memory. A name
    that leaves the folder is an error and no file. Files are written beside
    their place and moved there, so a repeated task is harmless.
    """
    limits = Limits.of(options or {})
    names = [x.split()[0] for x in EXPORTED.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = Path(folder).resolve()
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, c = [], Container(path, "mdd", limits=limits)
                for ordinal, key, start, end in c.rows():
                    target = (base / key.replace("\\", "/").lstrip("/")).resolve()
                    if base not in target.parents:
                        rows.append((path, ordinal, None, None, "the name leaves the folder"))
                    else:
                        target.parent.mkdir(parents=True, exist_ok=True)
                        temporary = target.with_name(f".{uuid.uuid4().hex}")
                        with temporary.open("wb") as sink:
                            n = c.copy_to(start, end, sink)
                        temporary.replace(target)
                        rows.append((path, ordinal, str(target), n, None))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows = []
                c.close()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return artifacts.select("path").repartition("path").mapInArrow(run, EXPORTED)


class _Sha:
    """A sink that keeps a digest of what is written."""

    def __init__(self) -> None:
        self.sha = hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.sha.update(data)

    def digest(self) -> bytes:
        return self.sha.digest()


def probe(artifacts: DataFrame) -> DataFrame:
    """Geometry of version 1 ``artifacts`` (path, kind), by the second implementation and against the reader: ``problems`` is empty where they agree."""

    def facts(path: str, kind: str) -> dict:
        g = geometry.probe(path)
        try:
            layout = (c := Container(path, kind)).layout
            c.close()
            own = (layout.entries, len(layout.key_blocks), len(layout.record_blocks), layout.total)
            if not g.problems and own != (g.entries, g.key_blocks, g.record_blocks, g.decoded_bytes):
                g.problems.append(f"the reader finds {own}")
        except ContainerError as e:
            g.problems.append(str(e)[:MESSAGE])
        return {"entries": g.entries, "key_blocks": g.key_blocks, "record_blocks": g.record_blocks, "decoded_bytes": g.decoded_bytes, "tags": ",".join(sorted(g.tags)), "problems": g.problems}

    return _each(artifacts, ("path", "kind"), "path string, kind string, entries long, key_blocks long, record_blocks long, decoded_bytes long, tags string, problems array<string>", facts, None)


def group_facts(keys: DataFrame) -> DataFrame:
    """``dict_id, entries, distinct_keys, duplicate_groups`` of a keys table of several containers."""
    groups = keys.groupBy("dict_id", "key").count()
    return groups.groupBy("dict_id").agg(F.sum("count").alias("entries"), F.count("*").alias("distinct_keys"), F.count_if(F.col("count") > 1).alias("duplicate_groups"))


def preview(entries: DataFrame, rows: int = 5, characters: int = 80) -> DataFrame:
    """The first rows with the beginning of their texts."""
    return entries.orderBy("ordinal").limit(rows).select("ordinal", "key", F.left("text", F.lit(characters)).alias("text"))
