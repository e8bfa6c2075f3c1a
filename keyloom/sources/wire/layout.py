"""Where everything is in a container, read once and checked; and access to its blocks.

Both versions are one grammar with other widths: version 2 has 64-bit integers,
an enveloped (possibly ciphered) keyword index and a checksum on the keyword
header; version 1 has 32-bit integers and a plain index. Metadata is read when
a container opens; key and record blocks only when a row of theirs is asked for.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from threading import Lock

from keyloom.functions.plain import normalize
from keyloom.sources.wire.charset import Charset
from keyloom.sources.wire.codec import decode_block
from keyloom.sources.wire.crypto import Passcode, index_bytes, salsa20_8
from keyloom.sources.wire.errors import ContainerError, ensure, truncated
from keyloom.sources.wire.header import Header, read_header
from keyloom.sources.wire.limits import Budget, Limits, MemoryUsage

BLOCK_BYTES = 64  #: accounted for a block's metadata, besides its summaries
ROW_BYTES = 64  #: accounted for a decoded key, besides its text


@dataclass(frozen=True)
class Grammar:
    """Widths of one wire version; ``ends``: summaries are closed by a NUL unit."""

    version: int
    word: str
    summary: str
    enveloped: bool
    ends: bool

    @property
    def width(self) -> int:
        return struct.calcsize(f">{self.word}")

    def least_row(self, unit: int) -> int:
        """Bytes of the shortest row of the keyword index."""
        return 3 * self.width + 2 * struct.calcsize(f">{self.summary}") + (2 * unit if self.ends else 0)


V1 = Grammar(1, "I", "B", False, False)
V2 = Grammar(2, "Q", "H", True, True)
V2_LEGACY = Grammar(2, "Q", "H", True, False)


@dataclass(frozen=True)
class KeyBlock:
    first: int
    count: int
    first_key: str
    last_key: str
    offset: int
    size: int
    content: int


@dataclass(frozen=True)
class RecordBlock:
    offset: int
    size: int
    start: int
    content: int


@dataclass(frozen=True)
class Layout:
    kind: str
    header: Header
    grammar: Grammar
    keys: Charset
    records: Charset | None
    entries: int
    total: int
    key_blocks: tuple[KeyBlock, ...]
    record_blocks: tuple[RecordBlock, ...]
    sections: tuple[tuple[str, int, int], ...] = field(default=())

    @cached_property
    def key_firsts(self) -> list[int]:
        return [b.first for b in self.key_blocks]

    @cached_property
    def record_starts(self) -> list[int]:
        return [b.start for b in self.record_blocks]

    def block_of(self, ordinal: int) -> int:
        return bisect_right(self.key_firsts, ordinal) - 1

    @property
    def metadata_bytes(self) -> int:
        summaries = sum(len(b.first_key.encode()) + len(b.last_key.encode()) for b in self.key_blocks)
        return summaries + BLOCK_BYTES * (len(self.key_blocks) + len(self.record_blocks)) + 8 * len(self.header.raw_xml.encode("utf-16-le"))

    @property
    def flags(self) -> dict[str, bool]:
        return {"case_sensitive": self.header.key_case_sensitive, "strip": self.header.strip_key, "resource_path": self.kind == "mdd"}


class File:
    """Exact reads of a local file or of bytes; threads may share it."""

    def __init__(self, source: str | bytes) -> None:
        import io
        import os

        self.lock = Lock()
        try:
            if isinstance(source, bytes):
                self.file, self.size = io.BytesIO(source), len(source)
            elif "://" in source:
                from pyarrow import fs

                files, path = fs.FileSystem.from_uri(source)
                self.file = files.open_input_file(path)
                self.size = self.file.size()
            else:
                self.file, self.size = open(source, "rb"), os.path.getsize(source)  # noqa: SIM115
        except OSError as e:
            raise ContainerError("Io", str(e)) from None
        ensure(self.size > 0, "empty file", "InvalidFormat")

    def has(self, offset: int, length: int, context: str) -> None:
        if offset + length > self.size:
            raise truncated(context, length, max(0, self.size - offset))

    def __call__(self, offset: int, length: int, context: str) -> bytes:
        self.has(offset, length, context)
        with self.lock:
            self.file.seek(offset)
            data = self.file.read(length)
        if len(data) != length:
            raise truncated(context, length, len(data))
        return data

    def close(self) -> None:
        self.file.close()


class Cursor:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int, context: str) -> bytes:
        if self.at + n > len(self.data):
            raise truncated(context, n, len(self.data) - self.at)
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str, context: str) -> int:
        value = struct.unpack(f">{code}", self.take(struct.calcsize(f">{code}"), context))[0]
        ensure(value < 1 << 63, f"{context} doesn't fit a long")
        return value


def _major(version: str, name: str) -> int:
    if not re.fullmatch(r"[0-9]+(\.[0-9]+)*", version) or int(version.split(".")[0]) >= 1 << 32:
        raise ContainerError("InvalidFormat", f"malformed {name}")
    return int(version.split(".")[0])


def wire_version(header: Header) -> int:
    """The generator's major version decides, and is judged first."""
    generated = _major(header.generated_by_engine_version, "GeneratedByEngineVersion")
    if generated not in (1, 2):
        raise ContainerError("Unsupported", "generated engine version", major=generated)
    required = _major(header.required_engine_version, "RequiredEngineVersion")
    if required == 0:
        raise ContainerError("InvalidFormat", "required engine version 0")
    if required > 2:
        raise ContainerError("Unsupported", "required engine version", major=required)
    if generated == 1 and required != 1:
        raise ContainerError("InvalidFormat", "engine versions conflict")
    return generated


def _keyword_header(read: File, at: int, header: Header, passcode: Passcode | None) -> tuple[Grammar, tuple[int, ...], int]:
    """Grammar, (blocks, entries, index content, index size, blocks size), and the header's length."""
    raw = read(at, 44, "keyword section header")
    plain, checksum = raw[:40], raw[40:]
    if header.encrypted & 1:
        if passcode is None:
            raise ContainerError("MissingPasscode", "keyword section header is encrypted")
        plain = salsa20_8(plain, passcode.header_key())
    actual = zlib.adler32(plain)
    if actual == int.from_bytes(checksum, "big"):
        grammar = V2
    elif actual == int.from_bytes(checksum, "little"):
        grammar = V2_LEGACY
    else:
        raise ContainerError("ChecksumMismatch", "keyword section header", expected=int.from_bytes(checksum, "big"), actual=actual)
    cursor = Cursor(plain)
    return grammar, tuple(cursor.number("Q", "keyword section header") for _ in range(5)), 44


def _keywords(read: File, header: Header, version: int, charset: Charset, passcode: Passcode | None, limits: Limits, budget: Budget):
    at = header.end
    if version == 2:
        grammar, (blocks, entries, content, size, stored), length = _keyword_header(read, at, header, passcode)
        limits.check("key_index_bytes", content, "key_index_decompressed_bytes")
        limits.check("key_index_bytes", size, "key_index_compressed_bytes")
        ensure(size >= 8, "keyword index block is too short", size=size)
    else:
        if header.encrypted:
            raise ContainerError("Unsupported", "encrypted version 1 keyword section")
        grammar, length = V1, 16
        cursor = Cursor(read(at, length, "keyword section header"))
        blocks, entries, size, stored = (cursor.number("I", "keyword section header") for _ in range(4))
        content = size
        limits.check("key_index_bytes", size)
    ensure(blocks <= entries, "more keyword blocks than entries", blocks=blocks, entries=entries)
    ensure(blocks * grammar.least_row(charset.unit) <= content, "keyword index can't hold its blocks", blocks=blocks, bytes=content)
    limits.check("block_metadata_bytes", blocks * BLOCK_BYTES, "keyword_block_metadata_bytes")
    index_at = at + length
    blocks_at = index_at + size
    end = blocks_at + stored
    ensure(end < 1 << 63, "keyword section overflows", "InvalidFormat")
    read.has(index_at, size, "keyword index")
    read.has(blocks_at, stored, "keyword block section")
    with budget.held(size + content + blocks * BLOCK_BYTES, "keyword index"):
        index = read(index_at, size, "keyword index")
        if grammar.enveloped:
            if header.encrypted & 2:
                index = index[:8] + index_bytes(index[8:], index[4:8])
            index = decode_block("keyword index block", index, content, limits)
        found = _key_blocks(index, blocks, grammar, charset, blocks_at, limits)
    ensure(sum(b.count for b in found) == entries, "keyword entry counts differ", header=entries)
    ensure(sum(b.size for b in found) == stored, "keyword block lengths differ", header=stored)
    sections = (("keyword_header", at, index_at), ("keyword_index", index_at, blocks_at), ("keyword_blocks", blocks_at, end))
    return grammar, entries, found, end, sections


def _key_blocks(index: bytes, n: int, grammar: Grammar, charset: Charset, offset: int, limits: Limits) -> tuple[KeyBlock, ...]:
    cursor, out, first = Cursor(index), [], 0
    least_entry = grammar.width + charset.unit

    def summary() -> str:
        units = cursor.number(grammar.summary, "keyword summary size")
        text = charset.decode(cursor.take(units * charset.unit, "keyword summary"), "keyword summary")
        if grammar.ends and any(cursor.take(charset.unit, "keyword summary terminator")):
            raise ContainerError("InvalidFormat", "keyword summary isn't terminated")
        return text

    for _ in range(n):
        count = cursor.number(grammar.word, "keyword block entries")
        first_key, last_key = summary(), summary()
        size, content = (cursor.number(grammar.word, "keyword block size") for _ in range(2))
        ensure(count > 0, "keyword block without entries")
        limits.check("key_block_entries", count, "keyword_block_entries")
        limits.check("compressed_block_bytes", size, "keyword_block_compressed_bytes")
        limits.check("decompressed_block_bytes", content, "keyword_block_decompressed_bytes")
        ensure(size >= 8, "keyword block is too short", size=size)
        ensure(count * least_entry <= content, "keyword block can't hold its entries", entries=count, bytes=content)
        out.append(KeyBlock(first, count, first_key, last_key, offset, size, content))
        first, offset = first + count, offset + size
    ensure(cursor.at == len(index), "keyword index has trailing bytes", bytes=len(index) - cursor.at)
    return tuple(out)


def _records(read: File, at: int, grammar: Grammar, limits: Limits, budget: Budget):
    w = grammar.width
    cursor = Cursor(read(at, 4 * w, "record section header"))
    blocks, entries, size, stored = (cursor.number(grammar.word, "record section header") for _ in range(4))
    ensure(size == 2 * w * blocks, "record index length differs", header=size, expected=2 * w * blocks)
    limits.check("record_index_bytes", size)
    limits.check("block_metadata_bytes", blocks * BLOCK_BYTES, "record_block_metadata_bytes")
    index_at = at + 4 * w
    offset = index_at + size
    read.has(index_at, size, "record block index")
    read.has(offset, stored, "record block section")
    with budget.held(size + blocks * BLOCK_BYTES, "record block index"):
        numbers = Cursor(read(index_at, size, "record block index"))
    sections = (("record_header", at, index_at), ("record_index", index_at, offset), ("record_blocks", offset, offset + stored))
    out, start = [], 0
    for _ in range(blocks):
        length, content = (numbers.number(grammar.word, "record block size") for _ in range(2))
        limits.check("compressed_block_bytes", length, "record_block_compressed_bytes")
        limits.check("decompressed_block_bytes", content, "record_block_decompressed_bytes")
        ensure(length >= 8, "record block is too short", size=length)
        read.has(offset, length, "record block")
        out.append(RecordBlock(offset, length, start, content))
        offset, start = offset + length, start + content
    ensure(sum(b.size for b in out) == stored, "record block lengths differ", header=stored)
    return entries, start, tuple(out), sections


def open_layout(read: File, kind: str, passcode: Passcode | None, limits: Limits, budget: Budget) -> Layout:
    header = read_header(read, kind, limits, budget)
    version = wire_version(header)
    keys = Charset("utf-16-le") if kind == "mdd" else Charset.of(header.encoding_label)
    records = None if kind == "mdd" else keys
    grammar, entries, key_blocks, end, sections = _keywords(read, header, version, keys, passcode, limits, budget)
    n, total, record_blocks, more = _records(read, end, grammar, limits, budget)
    ensure(n == entries, "entry counts of keys and records differ", keys=entries, records=n)
    sections = (("header", 0, header.end), *sections, *more)
    ensure(all(a[2] == b[1] for a, b in zip(sections, sections[1:], strict=False)), "sections aren't contiguous", "InvalidFormat")
    return Layout(kind, header, grammar, keys, records, entries, total, key_blocks, record_blocks, sections)


class Locator:
    """Normal forms of all keys in order, for lookups in one container: (normal form, ordinal) ascending."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.digests = array("I")  # of raw keys: what differs here is not equal
        self.order: list[int] = []
        self.bytes = 4  # of a compact form: text, and a bound, a place and a digest for each key

    def add(self, text: str, key: str) -> int:
        """Takes a key; the bytes it adds."""
        self.texts.append(text)
        self.digests.append(zlib.crc32(key.encode()))
        n = len(text.encode()) + 12
        self.bytes += n
        return n

    def close(self) -> None:
        self.order = sorted(range(len(self.texts)), key=self.texts.__getitem__)  # stable, so ordinals ascend

    def first(self, text: str) -> int:
        return bisect_left(self.order, text, key=self.texts.__getitem__)

    def equal(self, text: str) -> list[int]:
        """Ascending ordinals of a normal form."""
        return self.order[self.first(text) : bisect_right(self.order, text, key=self.texts.__getitem__)]


class Container:
    """An open container. Rows: (ordinal, key, start, end) with places in the decoded record stream.

    A decoded key block and a decoded record block are kept; all that is held
    is charged to the container's budget.
    """

    def __init__(self, source: str | bytes, kind: str, passcode: Passcode | None = None, limits: Limits | None = None, layout: Layout | None = None) -> None:
        self.limits, self.read = limits or Limits(), File(source)
        self.budget = Budget(self.limits.working_memory_bytes)
        self.layout = layout or open_layout(self.read, kind, passcode, self.limits, self.budget)
        self.budget.take(self.layout.metadata_bytes, "metadata")
        self._key: tuple[int, list[tuple[str, int]]] | None = None
        self._record: tuple[int, bytes] | None = None
        self._key_bytes = self._record_bytes = 0
        self._locator: Locator | None = None
        self._lock = Lock()

    def __len__(self) -> int:
        return self.layout.entries

    def close(self) -> None:
        self.read.close()

    def memory_usage(self) -> MemoryUsage:
        locator = self._locator.bytes if self._locator else 0
        return MemoryUsage(self.budget.now, self.budget.peak, self.layout.metadata_bytes, locator, self._key_bytes, self._record_bytes)

    def _decoded(self, i: int) -> list[tuple[str, int]]:
        layout, b = self.layout, self.layout.key_blocks[i]
        with self.budget.held(b.size + b.content, "keyword block"):
            data = decode_block("keyword block", self.read(b.offset, b.size, "keyword block"), b.content, self.limits)
            rows, cursor, before = [], Cursor(data), 0
            while cursor.at < len(data):
                ensure(len(rows) < b.count, "keyword block has data after its entries", entries=b.count)
                start = cursor.number(layout.grammar.word, "record offset")
                ensure(start <= layout.total, "record start is beyond the records", start=start, total=layout.total)
                ensure(start >= before, "record starts decrease", before=before, start=start)
                before = start
                at = cursor.at
                end, cursor.at = layout.keys.terminated(data, at, "key")
                rows.append((layout.keys.decode(data[at:end], "key"), start))
        ensure(len(rows) == b.count, "keyword block entry counts differ", expected=b.count, actual=len(rows))
        for key, summary in ((rows[0][0], b.first_key), (rows[-1][0], b.last_key)):
            ensure(normalize(key, **layout.flags) == normalize(summary, **layout.flags), "keyword summary doesn't match its block", "InvalidFormat")
        return rows

    def key_block(self, i: int) -> list[tuple[str, int]]:
        """(key, start) of a block, checked against the one before."""
        if self._key and self._key[0] == i:
            return self._key[1]
        if i:
            last = (self._key[1] if self._key and self._key[0] == i - 1 else self._decoded(i - 1))[-1][1]
        rows = self._decoded(i)
        if i:
            ensure(last <= rows[0][1], "record starts decrease across key blocks", before=last, start=rows[0][1])
        b = self.layout.key_blocks[i]
        size = self.layout.keys.most_decoded(b.content) + ROW_BYTES * b.count
        self.budget.give(self._key_bytes)
        self._key, self._key_bytes = None, 0
        self.budget.take(size, "decoded keys")
        self._key, self._key_bytes = (i, rows), size
        return rows

    def _record_block(self, i: int) -> bytes:
        if not self._record or self._record[0] != i:
            b = self.layout.record_blocks[i]
            self.budget.give(self._record_bytes)
            self._record, self._record_bytes = None, 0
            with self.budget.held(b.size, "record block"):
                self.budget.take(b.content, "decoded records")
                self._record_bytes = b.content
                self._record = (i, decode_block("record block", self.read(b.offset, b.size, "record block"), b.content, self.limits))
        return self._record[1]

    def rows(self, first_block: int = 0, last_block: int | None = None, spans: bool = True) -> Iterator[tuple[int, str, int, int | None]]:
        """Rows of blocks [first, last); without ``spans`` nothing beyond them is read, and ends are None."""
        blocks = self.layout.key_blocks
        last_block = len(blocks) if last_block is None else last_block
        for i in range(first_block, last_block):
            rows, first = self.key_block(i), blocks[i].first
            for k, (key, start) in enumerate(rows):
                end = None
                if spans and k + 1 < len(rows):
                    end = rows[k + 1][1]
                elif spans:
                    end = self.key_block(i + 1)[0][1] if i + 1 < len(blocks) else self.layout.total
                yield first + k, key, start, end

    def row(self, ordinal: int, spans: bool = True) -> tuple[int, str, int, int | None] | None:
        if not 0 <= ordinal < self.layout.entries:
            return None
        i = self.layout.block_of(ordinal)
        rows = self.key_block(i)
        k = ordinal - self.layout.key_blocks[i].first
        key, start = rows[k]
        if not spans:
            return ordinal, key, start, None
        if k + 1 < len(rows):
            return ordinal, key, start, rows[k + 1][1]
        return ordinal, key, start, self.key_block(i + 1)[0][1] if i + 1 < len(self.layout.key_blocks) else self.layout.total

    def chunks(self, start: int, end: int) -> Iterator[bytes]:
        """A record's bytes, a chunk for every block that it crosses."""
        ensure(0 <= start <= end <= self.layout.total, "record span is out of range", start=start, end=end, total=self.layout.total)
        blocks = self.layout.record_blocks
        i = bisect_right(self.layout.record_starts, start) - 1 if start < end else len(blocks)
        while i < len(blocks) and blocks[i].start < end:
            b = blocks[i]
            if b.content and b.start + b.content > start:
                yield self._record_block(i)[max(0, start - b.start) : end - b.start]
            i += 1

    def payload(self, start: int, end: int) -> bytes:
        self.limits.check("materialized_record_bytes", end - start)
        with self.budget.held(max(0, end - start), "record"):
            return b"".join(self.chunks(start, end))

    def text(self, start: int, end: int) -> str:
        """A text record, without its closing NULs."""
        ensure(self.layout.records is not None, "resources aren't text", "InvalidFormat")
        with self.budget.held(self.layout.records.most_decoded(max(0, end - start)), "text"):
            return self.layout.records.decode(self.payload(start, end), "record").rstrip("\0")

    def copy_to(self, start: int, end: int, sink) -> int:
        """Write a record chunk by chunk; the materialization ceiling doesn't hold here."""
        n = 0
        for chunk in self.chunks(start, end):
            sink.write(chunk)
            n += len(chunk)
        return n

    def locator(self) -> Locator:
        """The index of all keys, built at the first lookup; threads that come meanwhile wait for it."""
        with self._lock:
            if self._locator is None:
                self.limits.check("locator_entries", self.layout.entries)
                fixed, flags, made = 12 * self.layout.entries + 4, self.layout.flags, Locator()
                self.limits.check("locator_bytes", fixed)
                self.budget.take(fixed, "locator")
                try:
                    held = fixed
                    for _, key, _, _ in self.rows(spans=False):
                        text = normalize(key, **flags)
                        n = made.add(text, key) - 12
                        self.limits.check("locator_bytes", held + n)
                        self.budget.take(n, "locator")
                        held += n
                except BaseException:
                    self.budget.give(held)
                    raise
                made.close()
                self._locator = made
        return self._locator

    def locate(self, query: str) -> tuple[str, list[int]] | None:
        """Basis and ascending ordinals of a query; tables use the join in operators.locate."""
        found, want = self.locator(), normalize(query, **self.layout.flags)
        same = found.equal(want)
        digest = zlib.crc32(query.encode())
        with self._lock:
            exact = [i for i in same if found.digests[i] == digest and self.row(i, spans=False)[1] == query]
        if exact:
            return "RawExact", exact
        return ("HeaderNormalized", same) if same else None

    def prefix_keys(self, prefix: str, most: int) -> list[int]:
        """Ordinals of the first ``most`` keys whose normal form starts with the prefix's, by (normal form, ordinal)."""
        found, want, out = self.locator(), normalize(prefix, **self.layout.flags), []
        for i in range(found.first(want), len(found.order)):
            if len(out) == most or not found.texts[found.order[i]].startswith(want):
                break
            out.append(found.order[i])
        return out
