"""Ceilings of one open container; 0 forbids what it limits."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, fields, replace

from keyloom.sources.wire.errors import ContainerError

MIB = 1 << 20
ENTRIES = (1 << 32) - 1


@dataclass(frozen=True)
class Limits:
    # fixed values: the default ceilings
    header_xml_bytes: int = 16 * MIB
    header_attributes: int = 4096
    key_index_bytes: int = 64 * MIB
    record_index_bytes: int = 64 * MIB
    compressed_block_bytes: int = 256 * MIB
    decompressed_block_bytes: int = 512 * MIB
    block_metadata_bytes: int = 64 * MIB
    key_block_entries: int = 2_000_000
    materialized_record_bytes: int = 64 * MIB
    locator_entries: int = 10_000_000
    locator_bytes: int = 512 * MIB
    working_memory_bytes: int = 1024 * MIB

    @staticmethod
    def large() -> Limits:
        # fixed values: the ceilings for very large containers
        return Limits(
            header_xml_bytes=64 * MIB, header_attributes=16384, key_index_bytes=512 * MIB, record_index_bytes=512 * MIB,
            compressed_block_bytes=1024 * MIB, decompressed_block_bytes=2048 * MIB, block_metadata_bytes=512 * MIB,
            key_block_entries=16_000_000, materialized_record_bytes=512 * MIB, locator_entries=ENTRIES, locator_bytes=1024 * MIB,
            working_memory_bytes=2048 * MIB,
        )

    @staticmethod
    def of(options: dict[str, str]) -> Limits:
        """From reader options: ``limits`` (default or large) and ``limit.<name>``; -1 lifts locator_entries."""
        options = {k.lower(): v for k, v in options.items()}
        base = Limits.large() if options.get("limits", "default").lower() == "large" else Limits()
        own = {f.name: int(options[f"limit.{f.name}"]) for f in fields(Limits) if f"limit.{f.name}" in options}
        if own.get("locator_entries") == -1:
            own["locator_entries"] = ENTRIES
        return replace(base, **own)

    def check(self, limit: str, value: int, name: str | None = None) -> None:
        most = getattr(self, limit)
        if value > most:
            raise ContainerError("LimitExceeded", name or limit, value=value, max=most)


class Budget:
    """Bytes that a reader holds at once, against ``working_memory_bytes``; remembers the peak.

    What is read or decoded is charged before it is, by a bound of its size.
    """

    def __init__(self, most: int) -> None:
        self.most, self.now, self.peak = most, 0, 0

    def take(self, n: int, what: str) -> None:
        if self.now + n > self.most:
            raise ContainerError("LimitExceeded", "working_memory_bytes", value=self.now + n, max=self.most, context=what)
        self.now += n
        self.peak = max(self.peak, self.now)

    def give(self, n: int) -> None:
        self.now -= n

    @contextmanager
    def held(self, n: int, what: str) -> Iterator[None]:
        """The bytes taken for as long as the block runs."""
        self.take(n, what)
        try:
            yield
        finally:
            self.give(n)


@dataclass(frozen=True)
class MemoryUsage:
    """What an open container is charged with, in bytes."""

    current_bytes: int
    peak_bytes: int
    metadata_bytes: int
    locator_bytes: int
    key_cache_bytes: int
    record_cache_bytes: int
