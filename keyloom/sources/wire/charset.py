"""Text encodings of containers, decoded strictly."""

from __future__ import annotations

from dataclasses import dataclass

from keyloom.sources.wire.errors import ContainerError, ensure

#: Header labels in lower case and what they stand for.
LABELS = {
    "": "utf-8", "utf-8": "utf-8", "utf8": "utf-8", "utf-16": "utf-16-le", "utf16": "utf-16-le", "utf-16le": "utf-16-le", "utf16le": "utf-16-le",
    "gbk": "gbk", "gb2312": "gbk", "gb18030": "gb18030", "big5": "big5", "big-5": "big5",
}


@dataclass(frozen=True)
class Charset:
    name: str

    @staticmethod
    def of(label: str | None) -> Charset:
        found = LABELS.get((label or "").strip().lower())
        if not found:
            raise ContainerError("Unsupported", f"encoding {label!r}")
        return Charset(found)

    @property
    def unit(self) -> int:
        return 2 if self.name == "utf-16-le" else 1

    def most_decoded(self, size: int) -> int:
        """Bytes of UTF-8 that ``size`` encoded bytes give at most: three for a unit of 16 bits, and for a byte of the others."""
        if self.name == "utf-8":
            return size
        return (size + 1) // 2 * 3 if self.unit == 2 else 3 * size

    def decode(self, data: bytes, context: str) -> str:
        if self.name == "utf-16-le" and len(data) % 2:
            raise ContainerError("Decode", context, encoding=self.name)
        try:
            if self.name == "gbk":
                return _gbk(data)
            return data.decode("big5hkscs" if self.name == "big5" else self.name)
        except UnicodeDecodeError:
            raise ContainerError("Decode", context, encoding=self.name) from None

    def terminated(self, data: bytes, at: int, context: str) -> tuple[int, int]:
        """End of the text that begins at ``at``, and what follows its terminator."""
        if self.unit == 1:
            end = data.find(b"\0", at)
            ensure(end >= 0, f"{context}: no terminator")
            return end, end + 1
        end = at
        while (end := data.find(b"\0\0", end)) >= 0:
            if (end - at) % 2 == 0:
                return end, end + 2
            end += 1
        raise ContainerError("InvalidData", f"{context}: no terminator")


def _gbk(data: bytes) -> str:
    """GBK by the web's rules: that of GB18030, and a lone 0x80 is the euro sign."""
    if b"\x80" not in data:
        return data.decode("gb18030")
    out, at = [], 0
    while at < len(data):
        c = data[at]
        if c == 0x80:
            out.append("€")
            at += 1
            continue
        n = 1 if c < 0x80 else 4 if at + 1 < len(data) and 0x30 <= data[at + 1] <= 0x39 else 2
        out.append(data[at : at + n].decode("gb18030"))
        at += n
    return "".join(out)
