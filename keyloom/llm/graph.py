"""Distributed union-find: connected components of an edge table.

Edges are contracted inside each task first; the rest converges by alternating
small-star and large-star steps on DataFrames. Every join reads two written
tables, so a node with very many edges is split by adaptive execution. Each
step is written to the shared folder, so a lost executor costs one step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keyloom.llm.common import materialize, release, slim

EDGES = "a long, b long"


class Forest:
    """Union-find over the integers met; the root is the smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        if x < y:
            x, y = y, x
        self.up[x] = y
        return True

    def batches(self, size: int = 65536) -> Iterator[pa.RecordBatch]:
        """Its links, member above root, in Arrow batches."""
        members = list(self.up)
        for i in range(0, len(members), size):
            part = members[i : i + size]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int64()), pa.array([self.find(x) for x in part], pa.int64())], ["a", "b"]
            )


def contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's edges as the links of its own forest."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.union(a, b)
    yield from forest.batches()


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """``(node, root)`` of every node that has an edge to another; root: the smallest node reachable.

    ``edges``: columns a and b, long, in any direction; loops, repeats and an
    empty table are fine. Rows with a null end are not edges.
    """
    edges = edges.where("a is not null and b is not null and a != b")
    e = materialize(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .mapInArrow(slim(contract), EDGES)
        .distinct(),
        f"{tag}-edges",
    )
    while True:
        low = materialize(e.groupBy("a").agg(F.min("b").alias("low")), f"{tag}-low")
        n, heads = e.count(), low.count()
        if n == heads and not e.join(low.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            release(low)
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if n != heads:  # small star: smaller neighbours meet at the smallest
            small = materialize(
                e.join(low, "a")
                .select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
                .distinct(),
                f"{tag}-small",
            )
            release(e, low)
            e = small
            low = materialize(e.groupBy("a").agg(F.min("b").alias("low")), f"{tag}-low")
        # large star: a neighbour that isn't a root hands its members on
        large = materialize(
            e.join(low.select(F.col("a").alias("b"), "low"), "b", "left")
            .select("a", F.coalesce("low", "b").alias("b"))
            .distinct(),
            f"{tag}-large",
        )
        release(e, low)
        e = large
