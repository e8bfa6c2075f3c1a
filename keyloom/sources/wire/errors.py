"""Typed errors of container parsing, with their fields."""

from __future__ import annotations


class ContainerError(Exception):
    """``kind`` is one of the classes below; ``fields`` says what about."""

    KINDS = (
        "Io", "InvalidFormat", "InvalidData", "Truncated", "LimitExceeded", "AllocationFailed",
        "ChecksumMismatch", "Decode", "MissingPasscode", "InvalidPasscode", "Unsupported",
    )

    def __init__(self, kind: str, message: str, **fields: object) -> None:
        assert kind in self.KINDS
        super().__init__(kind, message, fields)
        self.kind, self.message, self.fields = kind, message, fields

    def __str__(self) -> str:
        more = ", ".join(f"{k}={v}" for k, v in self.fields.items())
        return f"{self.kind}: {self.message}" + (f" ({more})" if more else "")

    def __reduce__(self):
        return _again, (self.kind, self.message, self.fields)


def _again(kind: str, message: str, fields: dict) -> ContainerError:
    return ContainerError(kind, message, **fields)


def truncated(context: str, needed: int, remaining: int) -> ContainerError:
    return ContainerError("Truncated", context, needed=needed, remaining=remaining)


def ensure(ok: bool, message: str, kind: str = "InvalidData", **fields: object) -> None:
    if not ok:
        raise ContainerError(kind, message, **fields)
