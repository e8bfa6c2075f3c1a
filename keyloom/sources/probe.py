"""A second reading of version 1's geometry, to hold the reader against.

It shares no code with the reader: sizes are walked with ``struct`` over an open
file, no block is decoded, and the sections must end where the file ends.
"""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass, field
from typing import BinaryIO

MOST_INDEX = 1 << 28
TAG_NAMES = {b"\0\0\0\0": "none", b"\1\0\0\0": "lzo", b"\2\0\0\0": "zlib"}


@dataclass
class Geometry:
    """What the walk found; ``problems`` is empty where all sums agree."""

    entries: int = 0
    key_blocks: int = 0
    record_blocks: int = 0
    decoded_bytes: int = 0
    tags: set[str] = field(default_factory=set)
    problems: list[str] = field(default_factory=list)


class _Short(Exception):
    pass


def _take(f: BinaryIO, at: int, n: int, what: str) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) < n:
        raise _Short(f"{what}: {n - len(data)} of {n} bytes at {at} are missing")
    return data


def _u32s(f: BinaryIO, at: int, n: int, what: str) -> tuple[int, ...]:
    return struct.unpack(f">{n}I", _take(f, at, 4 * n, what))


def _summaries(index: bytes, blocks: int, unit: int) -> tuple[list[int], int, list[str]]:
    """Sizes of the key blocks, how many entries they say to have, and what is wrong."""
    sizes, total, at = [], 0, 0
    try:
        for _ in range(blocks):
            total += struct.unpack_from(">I", index, at)[0]
            at += 4
            for _ in range(2):
                at += 1 + unit * index[at]
            sizes.append(struct.unpack_from(">I", index, at)[0])
            at += 8
    except (struct.error, IndexError):
        return sizes, total, [f"key index ends in row {len(sizes)}"]
    return sizes, total, [] if at == len(index) else [f"{len(index) - at} bytes follow the key index"]


def probe(path: str) -> Geometry:
    """The geometry of a version 1 container. What can't be walked any further is a problem too."""
    out, size = Geometry(), os.path.getsize(path)
    try:
        with open(path, "rb") as f:
            _walk(f, size, out)
    except _Short as e:
        out.problems.append(str(e))
    return out


def _walk(f: BinaryIO, size: int, out: Geometry) -> None:
    def expect(ok: bool, what: str) -> None:
        if not ok:
            out.problems.append(what)

    (length,) = _u32s(f, 0, 1, "header length")
    xml = _take(f, 4, min(length, size), "header").decode("utf-16-le", "replace")
    wide = re.search(r'\bEncoding="utf-?16', xml, re.I) or xml.startswith("<Library_Data")
    at = 8 + length
    out.key_blocks, out.entries, index_bytes, key_bytes = _u32s(f, at, 4, "keyword header")
    if index_bytes > MOST_INDEX:
        raise _Short(f"key index of {index_bytes} bytes")
    at += 16
    sizes, said, wrong = _summaries(_take(f, at, index_bytes, "key index"), out.key_blocks, 2 if wide else 1)
    out.problems += wrong
    expect(said == out.entries, f"key blocks have {said} entries, the header says {out.entries}")
    expect(sum(sizes) == key_bytes, f"key blocks have {sum(sizes)} bytes, the header says {key_bytes}")
    starts, at = [], at + index_bytes
    for n in sizes:
        starts.append(at)
        at += n
    out.record_blocks, records, index_bytes, record_bytes = _u32s(f, at, 4, "record header")
    expect(records == out.entries, f"{records} records for {out.entries} keys")
    expect(index_bytes == 8 * out.record_blocks, f"record index of {index_bytes} bytes for {out.record_blocks} blocks")
    pairs = _u32s(f, at + 16, 2 * out.record_blocks, "record index")
    at += 16 + index_bytes
    for n in pairs[::2]:
        starts.append(at)
        at += n
    out.decoded_bytes = sum(pairs[1::2])
    expect(sum(pairs[::2]) == record_bytes, f"record blocks have {sum(pairs[::2])} bytes, the header says {record_bytes}")
    expect(min([*sizes, *pairs[::2]], default=8) >= 8, "a block is shorter than its envelope")
    expect(at == size, f"sections end at {at}, the file at {size}")
    for start in starts:
        tag = _take(f, start, 4, "block tag")
        out.tags.add(TAG_NAMES.get(tag, tag.hex()))
