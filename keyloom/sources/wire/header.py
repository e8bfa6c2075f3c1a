"""The header: one XML tag in UTF-16LE."""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass

from keyloom.sources.wire.errors import ContainerError, ensure
from keyloom.sources.wire.limits import Budget, Limits

TAGS = {"mdx": "Dictionary", "mdd": "Library_Data"}
_WS = r"[ \t\n\r\x0c]*"
_OPEN = re.compile(r"<([^ \t\n\r\x0c/>]+)")
_SPACE = re.compile(_WS)
_NAME = re.compile(rf"([^ \t\n\r\x0c=>]+){_WS}=?")
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


@dataclass(frozen=True)
class Header:
    raw_xml: str
    tag_name: str
    attributes: tuple[tuple[str, str], ...]
    generated_by_engine_version: str
    required_engine_version: str
    encoding_label: str | None
    format: str | None
    key_case_sensitive: bool
    strip_key: bool
    encrypted: int
    register_by: str | None
    reg_code: str | None
    description: str | None
    title: str | None
    creation_date: str | None
    end: int  #: where the keyword section begins

    def attribute(self, name: str) -> str | None:
        """The attribute of exactly this name."""
        return dict(self.attributes).get(name)


def _bad(message: str) -> ContainerError:
    return ContainerError("InvalidFormat", message)


def unescape(value: str) -> str:
    out, at = [], 0
    while (amp := value.find("&", at)) >= 0:
        semi = value.find(";", amp)
        if semi < 0:
            raise _bad("unterminated XML entity")
        name = value[amp + 1 : semi]
        if name in _ENTITIES:
            char = _ENTITIES[name]
        elif m := re.fullmatch(r"#(?:[xX]([0-9a-fA-F]+)|([0-9]+))", name):
            code = int(m[1], 16) if m[1] else int(m[2])
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                raise _bad("invalid XML code point")
            char = chr(code)
        else:
            raise _bad("unsupported XML entity")
        out += [value[at:amp], char]
        at = semi + 1
    return "".join([*out, value[at:]])


def parse_tag(xml: str, limits: Limits) -> tuple[str, tuple[tuple[str, str], ...]]:
    """Name and attributes of the one element, which has no content."""
    m = _OPEN.match(xml)
    if not m:
        raise _bad("header must start with a tag")
    tag, at, found = m[1], m.end(), []
    while True:
        at = _SPACE.match(xml, at).end()
        if at >= len(xml):
            raise _bad("unterminated header tag")
        if xml[at] == "/":
            if xml[at + 1 : at + 2] != ">":
                raise _bad("invalid self-closing header tag")
            if xml[at + 2 :].strip(" \t\n\r\x0c"):
                raise _bad("trailing content after the header tag")
            return tag, tuple(found)
        if xml[at] == ">":
            break
        limits.check("header_attributes", len(found) + 1)
        m = _NAME.match(xml, at)
        if not m:
            raise _bad("empty header attribute name")
        if not m[0].endswith("="):
            raise _bad("expected = in header attribute")
        ensure(all(n != m[1] for n, _ in found), "repeated header attribute")
        at = _SPACE.match(xml, m.end()).end()
        quote = xml[at : at + 1]
        if quote not in ('"', "'") or not quote:
            raise _bad("header attribute isn't quoted")
        close = xml.find(quote, at + 1)
        if close < 0:
            raise _bad("unterminated header attribute value")
        found.append((m[1], unescape(xml[at + 1 : close])))
        at = close + 1
    if not re.fullmatch(rf"{_WS}(?:</{re.escape(tag)}{_WS}>{_WS})?", xml[at + 1 :]):
        raise _bad("content in or after the header element")
    return tag, tuple(found)


def _known(attributes: tuple[tuple[str, str], ...], name: str, read=lambda value: value):
    """The value under any spelling of the name; spellings must agree."""
    low = name.lower()
    values = [read(v) for n, v in attributes if n.isascii() and n.lower() == low]
    ensure(all(v == values[0] for v in values), f"conflicting values of header attribute {name}")
    return values[-1] if values else None


def _yes(name: str):
    def read(value: str) -> bool:
        ensure(value.lower() in ("yes", "no"), f"header attribute {name} must be Yes or No")
        return value.lower() == "yes"

    return read


def _bits(value: str) -> int:
    bits = {"yes": 1, "no": 0}.get(value.lower())
    if bits is None:
        ensure(bool(re.fullmatch(r"\+?[0-9]{1,3}", value)) and int(value) < 256, "malformed Encrypted")
        bits = int(value)
    ensure(bits < 4, "unknown bits in Encrypted", bits=bits)
    return bits


def interpret(kind: str, xml: str, size: int, limits: Limits) -> Header:
    tag, attributes = parse_tag(xml, limits)
    if tag != TAGS[kind]:
        raise _bad("unexpected header tag")
    generated = _known(attributes, "GeneratedByEngineVersion")
    if generated is None:
        raise _bad("missing GeneratedByEngineVersion")
    required = _known(attributes, "RequiredEngineVersion")
    encrypted = _known(attributes, "Encrypted", _bits) or 0
    case = _known(attributes, "KeyCaseSensitive", _yes("KeyCaseSensitive"))
    text = {n: _known(attributes, n) or None for n in ("Encoding", "Format", "RegisterBy", "RegCode", "Description", "Title", "CreationDate")}
    return Header(
        xml, tag, attributes, generated, generated if required is None else required, text["Encoding"], text["Format"],
        kind == "mdd" if case is None else case, bool(_known(attributes, "StripKey", _yes("StripKey"))), encrypted,
        text["RegisterBy"], text["RegCode"], text["Description"], text["Title"], text["CreationDate"], size + 8,
    )


def read_header(read, kind: str, limits: Limits, budget: Budget | None = None) -> Header:
    """``read(offset, length, context)`` gives exactly those bytes or raises Truncated."""
    (size,) = struct.unpack(">I", read(0, 4, "header length"))
    limits.check("header_xml_bytes", size)
    if size % 2:
        raise _bad("odd header length")
    with (budget or Budget(1 << 62)).held(4 * size, "header"):  # the bytes, and their text in attributes
        return _decoded(read, kind, size, limits)


def _decoded(read, kind: str, size: int, limits: Limits) -> Header:
    body = read(4, size, "header")
    expected, actual = int.from_bytes(read(4 + size, 4, "header checksum"), "little"), zlib.adler32(body)
    if expected != actual:
        raise ContainerError("ChecksumMismatch", "header", expected=expected, actual=actual)
    try:
        xml = body.decode("utf-16-le")
    except UnicodeDecodeError:
        raise ContainerError("Decode", "header", encoding="utf-16-le") from None
    return interpret(kind, xml.rstrip("\0"), size, limits)
