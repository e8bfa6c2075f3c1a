"""Block envelopes and their codecs: stored, LZO1X, zlib."""

from __future__ import annotations

import zlib

from keyloom.sources.wire.errors import ContainerError, ensure, truncated
from keyloom.sources.wire.limits import Limits

TAGS = {0: "none", 1: "lzo", 2: "zlib"}


def decode_block(context: str, data: bytes, size: int, limits: Limits) -> bytes:
    """The content of an enveloped block: tag, big-endian ADLER32, payload; exactly ``size`` bytes."""
    limits.check("compressed_block_bytes", len(data))
    limits.check("decompressed_block_bytes", size)
    if len(data) < 8:
        raise truncated(context, 8, len(data))
    tag = data[0]
    if tag not in TAGS or any(data[1:4]):
        raise ContainerError("Unsupported", f"{context}: compression tag {data[:4].hex()}")
    out = (_stored, lzo1x, _inflate)[tag](data[8:], size)
    ensure(len(out) == size, f"{context}: decoded length", expected=size, actual=len(out))
    expected, actual = int.from_bytes(data[4:8], "big"), zlib.adler32(out)
    if expected != actual:
        raise ContainerError("ChecksumMismatch", context, expected=expected, actual=actual)
    return out


def _stored(data: bytes, size: int) -> bytes:
    return data


def _inflate(data: bytes, size: int) -> bytes:
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, size + 1)
    except zlib.error as e:
        raise ContainerError("InvalidData", f"zlib stream: {e}") from None
    ensure(len(out) <= size, "zlib stream is longer than declared")
    ensure(stream.eof and not stream.unused_data and not stream.unconsumed_tail, "zlib stream doesn't end with its block")
    return out


def lzo1x(data: bytes, size: int) -> bytes:
    """An LZO1X stream, which must end with its marker and use all of ``data``."""
    out, at, end = bytearray(), 0, len(data)

    def byte() -> int:
        nonlocal at
        if at >= end:
            raise ContainerError("InvalidData", "lzo stream is cut")
        at += 1
        return data[at - 1]

    def long(base: int) -> int:
        n = base
        while (b := byte()) == 0:
            n += 255
            ensure(n <= size + 255, "lzo run is too long")
        return n + b

    def literals(n: int) -> None:
        nonlocal at
        ensure(at + n <= end and len(out) + n <= size, "lzo literals overrun")
        out.extend(data[at : at + n])
        at += n

    def copy(distance: int, n: int) -> None:
        start = len(out) - distance
        ensure(start >= 0 and len(out) + n <= size, "lzo match overruns")
        if distance >= n:
            out.extend(out[start : start + n])
        else:
            part = bytes(out[start:])
            out.extend((part * (n // distance + 1))[:n])

    state = 0  # literals that came before: 0 none, 1 to 3, 4 for a run
    first = byte()
    if first > 17:
        literals(first - 17)
        state = min(4, first - 17)
    else:
        at -= 1
    while True:
        op = byte()
        if op >= 64:
            distance = (op >> 2 & 7) + (byte() << 3) + 1
            copy(distance, (op >> 5) + 1)
            state = op & 3
        elif op >= 32:
            n = (op & 31) + 2 if op & 31 else long(31) + 2
            low = byte()
            copy((byte() << 6) + (low >> 2) + 1, n)
            state = low & 3
        elif op >= 16:
            n = (op & 7) + 2 if op & 7 else long(7) + 2
            low = byte()
            distance = ((op & 8) << 11) + (byte() << 6) + (low >> 2)
            if not distance:
                ensure(n == 3 and at == end, "lzo stream doesn't end with its block")
                return bytes(out)
            copy(distance + 0x4000, n)
            state = low & 3
        elif state == 0:
            literals((op if op else long(15)) + 3)
            state = 4
            continue
        else:
            distance = (op >> 2) + (byte() << 2) + 1
            if state == 4:
                copy(distance + 0x800, 3)
            else:
                copy(distance, 2)
            state = op & 3
        literals(state)
