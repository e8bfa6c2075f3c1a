"""Containers written from rows: one pass, bounded memory.

Blocks go to spool files as they fill, since a container begins with what is
only known at its end. It is for tables to be handed on as containers, and for
queries to run over real ones; it knows the stored and zlib codecs.
"""

from __future__ import annotations

import shutil
import struct
import tempfile
import zlib
from dataclasses import dataclass, field
from xml.sax.saxutils import quoteattr

from keyloom.sources.wire.charset import Charset
from keyloom.sources.wire.crypto import Passcode, nibble_cipher, salsa20_8
from keyloom.sources.wire.errors import ContainerError, ensure
from keyloom.sources.wire.header import TAGS
from keyloom.sources.wire.layout import V1, V2

SPOOL_BYTES = 4 << 20


@dataclass(frozen=True)
class Style:
    """How a container is written. ``encrypted``: bits 1 (keyword header) and 2 (keyword index), of version 2 only."""

    version: int = 2
    encoding: str = "UTF-8"
    codec: str = "zlib"
    keys: int = 1000  #: of a key block
    record_bytes: int = 65_536  #: of a record block; records cross blocks
    encrypted: int = 0
    passcode: Passcode | None = None
    attributes: dict[str, str] = field(default_factory=dict)


class Writer:
    """Rows of one container, in order."""

    def __init__(self, kind: str, style: Style | None = None) -> None:
        self.kind, self.style = kind, style or Style()
        ensure(self.style.version == 2 or not self.style.encrypted, "version 1 has no encryption", "Unsupported")
        self.grammar = V2 if self.style.version == 2 else V1
        self.charset = Charset("utf-16-le") if kind == "mdd" else Charset.of(self.style.encoding)
        self.entries, self.offset = 0, 0
        self.block: list[tuple[str, bytes, int]] = []
        self.record = bytearray()
        self.index, self.sizes, self.key_blocks, self.record_blocks = bytearray(), bytearray(), 0, 0
        self.keys, self.records = (tempfile.SpooledTemporaryFile(max_size=SPOOL_BYTES) for _ in range(2))

    def _envelope(self, data: bytes, codec: str | None = None) -> bytes:
        tag = {"none": 0, "zlib": 2}[codec or self.style.codec]
        return bytes([tag, 0, 0, 0]) + struct.pack(">I", zlib.adler32(data)) + (zlib.compress(data) if tag else data)

    def _encoded(self, text: str, what: str) -> bytes:
        try:
            return text.encode(self.charset.name)
        except UnicodeEncodeError:
            raise ContainerError("Decode", what, encoding=self.charset.name) from None

    def add(self, key: str, payload: str | bytes) -> None:
        raw = self._encoded(key, "key")
        ensure(not any(raw[i : i + self.charset.unit] == bytes(self.charset.unit) for i in range(0, len(raw), self.charset.unit)), "key holds a terminator")
        body = payload if isinstance(payload, bytes) else self._encoded(payload, "record")
        self.block.append((key, raw, self.offset))
        self.entries += 1
        self.offset += len(body)
        self.record += body
        if len(self.block) == self.style.keys:
            self._close_keys()
        while len(self.record) >= self.style.record_bytes:
            self._close_record(self.style.record_bytes)

    def _close_keys(self) -> None:
        g = self.grammar
        content = b"".join(struct.pack(f">{g.word}", at) + raw + bytes(self.charset.unit) for _, raw, at in self.block)
        data = self._envelope(content)
        self.index += struct.pack(f">{g.word}", len(self.block))
        for _, raw, _ in (self.block[0], self.block[-1]):
            units = len(raw) // self.charset.unit
            ensure(units < 1 << 8 * struct.calcsize(g.summary), "key is too long for a summary", "Unsupported")
            self.index += struct.pack(f">{g.summary}", units) + raw + (bytes(self.charset.unit) if g.ends else b"")
        self.index += struct.pack(f">2{g.word}", len(data), len(content))
        self.keys.write(data)
        self.key_blocks += 1
        self.block = []

    def _close_record(self, size: int) -> None:
        data = self._envelope(bytes(self.record[:size]))
        self.sizes += struct.pack(f">2{self.grammar.word}", len(data), size)
        self.records.write(data)
        self.record_blocks += 1
        del self.record[:size]

    def _header(self) -> bytes:
        engine = "2.0" if self.style.version == 2 else "1.2"
        fields = {"GeneratedByEngineVersion": engine, "RequiredEngineVersion": engine, "Format": "Html" if self.kind == "mdx" else "", "Encoding": self.style.encoding if self.kind == "mdx" else ""}
        fields |= ({"Encrypted": str(self.style.encrypted)} if self.style.encrypted else {}) | self.style.attributes
        xml = f"<{TAGS[self.kind]} " + " ".join(f"{k}={quoteattr(v, {chr(39): '&apos;', chr(34): '&quot;'})}" for k, v in fields.items()) + "/>\r\n\0"
        body = xml.encode("utf-16-le")
        return struct.pack(">I", len(body)) + body + struct.pack("<I", zlib.adler32(body))

    def close(self, sink) -> int:
        """Write the container to a binary stream; the number of its entries."""
        if self.block:
            self._close_keys()
        if self.record:
            self._close_record(len(self.record))
        index, g, s = bytes(self.index), self.grammar, self.style
        key_bytes, record_bytes = self.keys.tell(), self.records.tell()
        sink.write(self._header())
        if s.version == 2:
            packed = self._envelope(index)
            if s.encrypted & 2:
                packed = packed[:8] + nibble_cipher(packed[8:], packed[4:8])
            head = struct.pack(">5Q", self.key_blocks, self.entries, len(index), len(packed), key_bytes)
            check = struct.pack(">I", zlib.adler32(head))
            sink.write((salsa20_8(head, s.passcode.header_key()) if s.encrypted & 1 else head) + check + packed)
        else:
            sink.write(struct.pack(">4I", self.key_blocks, self.entries, len(index), key_bytes) + index)
        for spool, head in ((self.keys, b""), (self.records, struct.pack(f">4{g.word}", self.record_blocks, self.entries, len(self.sizes), record_bytes) + bytes(self.sizes))):
            sink.write(head)
            spool.seek(0)
            shutil.copyfileobj(spool, sink, 1 << 20)
            spool.close()
        return self.entries
