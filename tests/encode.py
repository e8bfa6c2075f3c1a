"""Encoders of containers for tests; they share no code with the readers (the keyed layers have their own)."""

from __future__ import annotations

import struct
import zlib


def envelope(data: bytes, codec: str) -> bytes:
    tag = {"none": 0, "lzo": 1, "zlib": 2}[codec]
    body = {"none": lambda: data, "zlib": lambda: zlib.compress(data), "lzo": lambda: lzo_literal(data)}[codec]()
    return bytes([tag, 0, 0, 0]) + struct.pack(">I", zlib.adler32(data)) + body


def lzo_literal(data: bytes) -> bytes:
    """An LZO1X stream of literals only."""
    n = len(data)
    if not n:
        return b"\x11\0\0"
    if n <= 238:
        return bytes([17 + n]) + data + b"\x11\0\0"
    rest = n - 18
    return b"\0" + b"\0" * ((rest - 1) // 255) + bytes([(rest - 1) % 255 + 1]) + data + b"\x11\0\0"


def header(kind: str, **attributes: str) -> bytes:
    tag = {"mdx": "Dictionary", "mdd": "Library_Data"}[kind]
    body = (f"<{tag} " + " ".join(f'{k}="{v}"' for k, v in attributes.items()) + "/>\r\n\0").encode("utf-16-le")
    return struct.pack(">I", len(body)) + body + struct.pack("<I", zlib.adler32(body))


def container(
    kind: str, entries: list[tuple[str, bytes | str]], version: int = 2, charset: str = "utf-8", label: str | None = None, key_blocks: list[int] | None = None,
    record_blocks: list[int] | None = None, codecs: tuple[str, str, str] = ("none", "none", "none"), legacy: bool = False, starts: list[int] | None = None,
    summaries: list[tuple[str, str]] | None = None, attributes: dict[str, str] | None = None, encrypted: int = 0, passcode: tuple[str, str] | None = None,
    spoil_record: int | None = None, spoil_key: int | None = None, count_off: int = 0,
) -> bytes:
    word, size = ("Q", 8) if version == 2 else ("I", 4)
    key_charset = "utf-16-le" if kind == "mdd" else charset
    unit = 2 if key_charset == "utf-16-le" else 1
    records = [r.encode(charset) if isinstance(r, str) else r for _, r in entries]
    at, own = 0, []
    for r in records:
        own.append(at)
        at += len(r)
    own = starts or own
    stream = b"".join(records)
    key_blocks = key_blocks or ([len(entries)] if entries else [])
    record_blocks = record_blocks or ([len(stream)] if entries else [])
    rows, index, blocks = 0, b"", b""
    for i, n in enumerate(key_blocks):
        part = entries[rows : rows + n]
        content = b"".join(struct.pack(f">{word}", s) + k.encode(key_charset) + b"\0" * unit for (k, _), s in zip(part, own[rows : rows + n], strict=True))
        data = bytearray(envelope(content, codecs[1]))
        if spoil_key == i:
            data[5] ^= 1
        blocks += data
        first, last = summaries[i] if summaries else (part[0][0], part[-1][0])
        index += struct.pack(f">{word}", n + count_off)
        for text in (first, last):
            raw = text.encode(key_charset)
            index += struct.pack(">H" if version == 2 else ">B", len(raw) // unit) + raw + (b"\0" * unit if version == 2 and not legacy else b"")
        index += struct.pack(f">2{word}", len(data), len(content))
        rows += n
    count = len(entries) + count_off * len(key_blocks)
    if version == 2:
        packed = envelope(index, codecs[0])
        if encrypted & 2:
            packed = packed[:8] + cipher_index(packed[8:], packed[4:8])
        head = struct.pack(">5Q", len(key_blocks), count, len(index), len(packed), len(blocks))
        check = struct.pack("<I" if legacy else ">I", zlib.adler32(head))
        if encrypted & 1:
            head = cipher_header(head, *passcode)
        head += check
    else:
        packed = index
        head = struct.pack(">4I", len(key_blocks), count, len(packed), len(blocks))
    at, sizes, bodies = 0, b"", b""
    for i, n in enumerate(record_blocks):
        data = bytearray(envelope(stream[at : at + n], codecs[2]))
        if spoil_record == i:
            data[5] ^= 1
        bodies += data
        sizes += struct.pack(f">2{word}", len(data), n)
        at += n
    tail = struct.pack(f">4{word}", len(record_blocks), count, len(sizes), len(bodies)) + sizes + bodies
    label = label if label is not None else {"utf-16-le": "UTF-16"}.get(charset, charset)
    engine = f"{version}.0" if version == 2 else "1.2"
    fields = {"GeneratedByEngineVersion": engine, "RequiredEngineVersion": engine, "Encoding": label} | ({"Encrypted": str(encrypted)} if encrypted else {}) | (attributes or {})
    assert size == struct.calcsize(word)
    return header(kind, **fields) + head + packed + blocks + tail


def cipher_index(data: bytes, checksum: bytes) -> bytes:
    from keyloom.sources.wire.crypto import ripemd128

    key, before, out = ripemd128(checksum + b"\x95\x36\0\0"), 0x36, bytearray()
    for i, plain in enumerate(data):
        x = plain ^ (i & 0xFF) ^ key[i % 16] ^ before
        before = ((x << 4) | (x >> 4)) & 0xFF
        out.append(before)
    return bytes(out)


def cipher_header(data: bytes, code: str, user: str) -> bytes:
    from keyloom.sources.wire.crypto import Passcode, salsa20_8

    return salsa20_8(data, Passcode(code, user).header_key())
