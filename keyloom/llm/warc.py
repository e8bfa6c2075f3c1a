"""Zstandard web archives: one frame per record behind a dictionary frame.

An archive opens with a skippable frame (0x184D2A5D) that holds the dictionary
its records need; every record is a zstd frame of its own. Writers put one
archive per task in the shared folder under a name made of its content, so a
repeated task cannot mix with another attempt. Records whose payload another
record holds are revisits without payload.

Damage is an ``ArchiveError``; readers raise it, or with ``mode="PERMISSIVE"``
give the records before it and one row that carries the error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from keyloom.llm.common import Batches, fresh_path, materialize, slim

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"  #: of every record, unless a writer is told another
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
ARCHIVE_BYTES = 256 << 20  #: an archive is closed at this size
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
RECORD_BYTES = 1 << 31  #: longest record that a reader decodes
TYPES = frozenset("warcinfo response resource request metadata revisit conversion continuation".split())
_NAMED = {n.lower(): n for n in (*REQUIRED, "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Refers-To", "WARC-Profile", "Content-Type")}  #: names have no case
_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?Z")
_ID = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]*:[^<>\s]*>")
_HEADER = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*([^\r\n]*)")


class ArchiveError(ValueError):
    """What is wrong with an archive, and at which byte."""

    def __init__(self, what: str, at: int) -> None:
        super().__init__(f"{what} at byte {at}")
        self.what, self.at = what, at


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """The record's bytes; a line break in a value would end the header, so it becomes a space."""
    lines = [VERSION] + [f"{k}: {re.sub('[\r\n]+', ' ', v)}".encode() for k, v in headers] + [b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(content: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(content)) + content


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records like the samples; empty where there is too little to learn from."""
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dated(value: str) -> bool:
    """Whether it is a time in UTC."""
    try:
        return bool(_DATE.fullmatch(value) and datetime.fromisoformat(value[:19]))
    except ValueError:
        return False


def parse(data: bytes, at: int = 0) -> Record:
    """One record, validated: version, headers (type, id, date), length, and the closing blank lines."""
    head, cut, rest = data.partition(b"\r\n\r\n")
    if not cut:
        raise ArchiveError("record header doesn't end", at)
    lines = head.split(b"\r\n")
    if lines[0] != VERSION and lines[0] != b"WARC/1.0":
        raise ArchiveError("not a WARC record", at)
    headers: dict[str, str] = {}
    for line in lines[1:]:
        m = _HEADER.fullmatch(line)
        if not m:
            raise ArchiveError("malformed header line", at)
        name = _NAMED.get(m[1].decode().lower(), m[1].decode())
        if name in headers:
            raise ArchiveError(f"repeated header {name}", at)
        headers[name] = m[2].decode("utf-8", "replace").strip()
    for name in REQUIRED:
        if not headers.get(name):
            raise ArchiveError(f"no header {name}", at)
    if headers["WARC-Type"] not in TYPES:
        raise ArchiveError(f"unknown WARC-Type {headers['WARC-Type'][:40]!r}", at)
    if not _dated(headers["WARC-Date"]):
        raise ArchiveError("bad WARC-Date", at)
    if not all(_ID.fullmatch(headers[n]) for n in ("WARC-Record-ID", "WARC-Refers-To") if n in headers):
        raise ArchiveError("bad record id", at)
    if not re.fullmatch("[0-9]+", headers["Content-Length"]):
        raise ArchiveError("bad Content-Length", at)
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError(f"Content-Length {size} doesn't fit the record", at)
    return Record(headers, rest[:size])


def payload(found: Record, at: int = 0) -> tuple[int, str, bytes | None]:
    """Length and digest of the full payload, and the payload unless a revisit leaves it out; validated."""
    head, cut, body = found.block.partition(b"\r\n\r\n")
    m = re.search(rb"\r\nContent-Length:[ \t]*([0-9]+)[ \t]*(?=\r\n|$)", head)
    if not cut or not head.startswith(b"HTTP/") or not m:
        raise ArchiveError("no HTTP header with a length in the block", at)
    said = found.headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if found.headers["WARC-Type"] == "revisit":
        if body or not said or not found.headers.get("WARC-Refers-To"):
            raise ArchiveError("malformed revisit", at)
        return int(m[1]), said, None
    if len(body) != int(m[1]):
        raise ArchiveError("HTTP length doesn't fit the payload", at)
    if said != digest(body):
        raise ArchiveError("payload digest differs", at)
    return len(body), said, body


def read_archive(source, chunk: int = 1 << 16) -> Iterator[tuple[int, Record]]:
    """(byte, record) of every frame of a binary stream, one record in memory at a time."""
    at, held, ended = 0, bytearray(), False

    def need(n: int) -> bool:
        nonlocal ended
        while len(held) < n and not ended:
            data = source.read(max(chunk, n - len(held)))
            held.extend(data)
            ended = not data
        return len(held) >= n

    if not need(1):
        return
    content = b""
    if need(8) and struct.unpack_from("<I", held)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", held, 4)[0]
        if not need(8 + size):
            raise ArchiveError("dictionary frame is cut", 0)
        content = bytes(held[8 : 8 + size])
        del held[: 8 + size]
        at = 8 + size
        if content.startswith(FRAME):
            try:
                content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
            except zstandard.ZstdError as e:
                raise ArchiveError(f"dictionary doesn't decode ({e})", 8) from None
        if not content.startswith(DICTIONARY):
            raise ArchiveError("no dictionary in the leading frame", 8)
    context = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}))
    while need(1):
        if need(4) and bytes(held[:4]) != FRAME:
            raise ArchiveError("not a zstd frame", at)
        frame, parts, size, used = context.decompressobj(), [], 0, 0
        while not frame.eof:
            if not held and not need(1):
                raise ArchiveError("frame is cut", at)
            data = bytes(held)
            held.clear()
            try:
                parts.append(frame.decompress(data))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"frame doesn't decode ({e})", at) from None
            size += len(parts[-1])
            used += len(data)
            if size > RECORD_BYTES:
                raise ArchiveError("record is too long", at)
        held[:0] = frame.unused_data
        yield at, parse(b"".join(parts), at)
        at += used - len(frame.unused_data)


class ArchiveWriter:
    """Records into one archive file; the dictionary is trained on the first ones."""

    def __init__(self, sink, level: int = 6) -> None:
        self.sink, self.level, self.waiting, self.waits = sink, level, [], 0
        self.context, self.bytes, self.records, self.sha = None, 0, 0, hashlib.sha256()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.sha.update(data)
        self.bytes += len(data)

    def _start(self) -> None:
        content = train(self.waiting)
        if content:
            self._put(dictionary_frame(content))
            self.context = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
        else:
            self.context = zstandard.ZstdCompressor(level=self.level, write_checksum=True)
        for data in self.waiting:
            self._put(self.context.compress(data))
        self.waiting = []

    def write(self, data: bytes) -> None:
        self.records += 1
        if self.context is None:
            self.waiting.append(data)
            self.waits += len(data)
            if self.waits >= SAMPLE_BYTES:
                self._start()
        else:
            self._put(self.context.compress(data))

    def close(self) -> None:
        if self.context is None:
            self._start()


def _files(uri: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else fs.FileSystem.from_uri("file://" + uri.removeprefix("file:"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, payload, digest: SHA-1 in hexadecimal, refers_to) as archives in ``folder``.

    Returns (archive, records, bytes), a row per archive. Lazy: whoever reads
    the result twice writes twice, so write it down first. An empty table gives
    no archive; null payloads are empty ones.
    """

    def run(batches: Batches) -> Batches:
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        writer = sink = temporary = None

        def close() -> None:
            writer.close()
            sink.close()
            name = f"{base}/{writer.sha.hexdigest()[:32]}.warc.zst"
            files.move(temporary, name)
            done.append((f"{folder}/{name.rsplit('/', 1)[1]}", writer.records, writer.bytes))

        try:
            for b in batches:
                for page_id, url, text, sha, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if writer is None:
                        temporary = f"{base}/.{uuid.uuid4().hex}"
                        sink = files.open_output_stream(temporary, compression=None)
                        writer = ArchiveWriter(sink)
                    body = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
                    revisit = refers is not None
                    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _record_id(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url or "urn:x-none:"), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(sha)).decode()}"), ("Content-Type", "application/http;msgtype=response")]
                    if revisit:
                        headers += [("WARC-Refers-To", _record_id(refers)), ("WARC-Profile", PROFILE)]
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
                    writer.write(record(headers, block + (b"" if revisit else body)))
                    if writer.bytes >= ARCHIVE_BYTES:
                        close()
                        writer = None
            if writer is not None:
                close()
        except BaseException:  # a failed attempt leaves nothing that is not done
            if sink is not None and not sink.closed:
                sink.close()
                files.delete_file(temporary)
            raise
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["archive", "records", "bytes"])

    return pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(slim(run), "archive string, records long, bytes long")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, byte long, payload binary, error string"


def read_archives(archives: DataFrame, mode: str = "FAILFAST", with_payload: bool = True) -> DataFrame:
    """Every record of the archives named in column ``archive``; see RECORDS.

    With ``mode="PERMISSIVE"`` a damaged archive gives its records up to the
    damage and then one row with ``error``. A task reads the archives of a
    partition one after another; repartition them for more tasks. A record of
    more than RECORD_BYTES is an error: no column holds more.
    """

    def number(value: str | None) -> int | None:
        m = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", value or "")
        return int(m[1]) if m else None

    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Batches) -> Batches:
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for uri in b.column(0).to_pylist():
                files, path = _files(uri)
                try:
                    with files.open_input_stream(path, compression=None) as source:
                        for at, x in read_archive(source):
                            n, sha, body = payload(x, at)
                            h = x.headers
                            rows.append((number(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), n, sha, h["WARC-Type"], number(h.get("WARC-Refers-To")), uri, at, body if with_payload else None, None))
                            held += len(body or b"") if with_payload else 64
                            if held > 8 << 20:
                                yield batch()
                                rows, held = [], 0
                except ArchiveError as e:
                    if mode != "PERMISSIVE":
                        raise
                    rows.append((None, None, None, None, None, None, uri, e.at, None, e.what))
        if rows:
            yield batch()

    return archives.select("archive").mapInArrow(slim(run), RECORDS)


def assign(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as records to write: page_id, url, payload, digest, refers_to.

    Of records with equal payloads of at least ``least`` bytes, the smallest
    page_id is the response and the others refer to it. Null html is an empty
    payload. Rows that repeat the smallest page_id, and rows without page_id,
    are responses.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload")).withColumn(
        "sha", F.sha1(F.encode("payload", "UTF-8"))
    )
    firsts = materialize(
        rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
        .groupBy(F.col("sha").alias("first_sha"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n"),
        "firsts",
    )
    found = rows.join(firsts, rows["sha"] == firsts["first_sha"], "left")
    refers = F.when((F.octet_length("payload") >= least) & (F.col("page_id") > F.col("first")), F.col("first"))
    return found.select("page_id", "url", "payload", F.col("sha").alias("digest"), refers.alias("refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    from keyloom.llm.common import bound_batches, table

    bound_batches(spark)
    pages = assign(table(spark, sf_dir, "pages"))
    written = materialize(write_archives(pages, fresh_path(spark, "warc")), "archives")
    # the table of names is small: read by its files, few tasks would get all archives
    found = read_archives(written.repartition(max(1, written.count())), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
