"""Key functions of single strings, without Spark."""

from __future__ import annotations


def normalize(raw: str, case_sensitive: bool = False, strip: bool = False, resource_path: bool = False) -> str:
    """The normal form of one key; see ``keys.norm_key``."""
    if resource_path:
        raw = raw.lstrip("/\\")
    if strip:
        raw = "".join(c for c in raw if not c.isascii() or c.isalnum())
    if resource_path:
        raw = raw.replace("/", "\\")
    if case_sensitive:
        return raw
    # only a final sigma is lowered by what stands around it
    return raw.lower() if "Σ" not in raw else "".join(c.lower() for c in raw)
