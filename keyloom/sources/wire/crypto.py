"""RIPEMD-128, Salsa20/8 and the two keyed layers of the keyword section."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from keyloom.sources.wire.errors import ContainerError

_M = 0xFFFFFFFF
# fixed values: message order, rotations and constants of RIPEMD-128
_LEFT = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15), (7, 4, 13, 1, 10, 6, 15, 3, 12, 0, 9, 5, 2, 14, 11, 8),
    (3, 10, 14, 4, 9, 15, 8, 1, 2, 7, 0, 6, 13, 11, 5, 12), (1, 9, 11, 10, 0, 8, 12, 4, 13, 3, 7, 15, 14, 5, 6, 2),
)
_RIGHT = (
    (5, 14, 7, 0, 9, 2, 11, 4, 13, 6, 15, 8, 1, 10, 3, 12), (6, 11, 3, 7, 0, 13, 5, 10, 14, 15, 8, 12, 4, 9, 1, 2),
    (15, 5, 1, 3, 7, 14, 6, 9, 11, 8, 12, 2, 10, 0, 4, 13), (8, 6, 4, 1, 3, 11, 15, 0, 5, 12, 2, 13, 9, 7, 10, 14),
)
_LEFT_TURN = (
    (11, 14, 15, 12, 5, 8, 7, 9, 11, 13, 14, 15, 6, 7, 9, 8), (7, 6, 8, 13, 11, 9, 7, 15, 7, 12, 15, 9, 11, 7, 13, 12),
    (11, 13, 6, 7, 14, 9, 13, 15, 14, 8, 13, 6, 5, 12, 7, 5), (11, 12, 14, 15, 14, 15, 9, 8, 9, 14, 5, 6, 8, 6, 5, 12),
)
_RIGHT_TURN = (
    (8, 9, 9, 11, 13, 15, 15, 5, 7, 7, 8, 11, 14, 14, 12, 6), (9, 13, 15, 7, 12, 8, 9, 11, 7, 7, 12, 7, 6, 15, 13, 11),
    (9, 7, 15, 11, 8, 6, 6, 14, 12, 13, 5, 14, 13, 13, 7, 5), (15, 5, 8, 11, 14, 14, 6, 14, 6, 9, 12, 9, 12, 5, 15, 8),
)
_LEFT_K = (0, 0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC)
_RIGHT_K = (0x50A28BE6, 0x5C4DD124, 0x6D703EF3, 0)
_MIX = (
    lambda x, y, z: x ^ y ^ z,
    lambda x, y, z: (x & y) | (~x & z),
    lambda x, y, z: (x | ~y) ^ z,
    lambda x, y, z: (x & z) | (y & ~z),
)


def _turn(x: int, n: int) -> int:
    x &= _M
    return ((x << n) | (x >> (32 - n))) & _M


def ripemd128(data: bytes) -> bytes:
    state = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]
    padded = data + b"\x80" + bytes((55 - len(data)) % 64) + struct.pack("<Q", 8 * len(data))
    for at in range(0, len(padded), 64):
        words = struct.unpack_from("<16I", padded, at)
        lines = []
        for order, turns, consts, mixes in ((_LEFT, _LEFT_TURN, _LEFT_K, _MIX), (_RIGHT, _RIGHT_TURN, _RIGHT_K, _MIX[::-1])):
            a, b, c, d = state
            for r in range(4):
                for k, n in zip(order[r], turns[r], strict=True):
                    a, b, c, d = d, _turn(a + mixes[r](b, c, d) + words[k] + consts[r], n), b, c
            lines.append((a, b, c, d))
        (a, b, c, d), (e, f, g, h) = lines
        state = [(state[1] + c + h) & _M, (state[2] + d + e) & _M, (state[3] + a + f) & _M, (state[0] + b + g) & _M]
    return struct.pack("<4I", *state)


def salsa20_8(data: bytes, key: bytes) -> bytes:
    """XOR with the Salsa20/8 stream of a 16-byte key and a zero nonce."""
    k, c = struct.unpack("<4I", key), struct.unpack("<4I", b"expand 16-byte k")
    out = bytearray(data)
    for block in range(-(-len(data) // 64)):
        start = [c[0], *k, c[1], 0, 0, block & _M, block >> 32, c[2], *k, c[3]]
        x = list(start)
        for _ in range(4):
            for columns in (True, False):
                for i in range(4):
                    p = [(5 * i + 4 * j) % 16 if columns else 4 * i + (i + j) % 4 for j in range(4)]
                    x[p[1]] ^= _turn(x[p[0]] + x[p[3]], 7)
                    x[p[2]] ^= _turn(x[p[1]] + x[p[0]], 9)
                    x[p[3]] ^= _turn(x[p[2]] + x[p[1]], 13)
                    x[p[0]] ^= _turn(x[p[3]] + x[p[2]], 18)
        stream = struct.pack("<16I", *((a + b) & _M for a, b in zip(x, start, strict=True)))
        for i, s in enumerate(stream[: len(data) - 64 * block]):
            out[64 * block + i] ^= s
    return bytes(out)


@dataclass(frozen=True)
class Passcode:
    """Registration code (32 hexadecimal digits) and user id; neither shows in a repr."""

    reg_code: str
    user_id: str

    def __post_init__(self) -> None:
        if not re.fullmatch("[0-9A-Fa-f]{32}", self.reg_code):
            raise ContainerError("InvalidPasscode", "registration code must be 32 hexadecimal digits")
        if len(self.user_id.encode()) > 4096:
            raise ContainerError("InvalidPasscode", "user id is too long")

    def __repr__(self) -> str:
        return "Passcode(***)"

    def header_key(self) -> bytes:
        return salsa20_8(bytes.fromhex(self.reg_code), ripemd128(self.user_id.encode()))


def index_bytes(data: bytes, checksum: bytes) -> bytes:
    """A keyword index without its nibble cipher; the key comes from the block's own checksum."""
    key, before = ripemd128(checksum + b"\x95\x36\x00\x00"), 0x36
    out = bytearray(len(data))
    for i, c in enumerate(data):
        out[i] = ((c >> 4) | (c << 4) & 0xF0) ^ (i & 0xFF) ^ key[i % 16] ^ before
        before = c
    return bytes(out)


def nibble_cipher(data: bytes, checksum: bytes) -> bytes:
    """The inverse of :func:`index_bytes`."""
    key, before, out = ripemd128(checksum + b"\x95\x36\x00\x00"), 0x36, bytearray(len(data))
    for i, plain in enumerate(data):
        c = plain ^ (i & 0xFF) ^ key[i % 16] ^ before
        before = out[i] = (c >> 4) | (c << 4) & 0xF0
    return bytes(out)
