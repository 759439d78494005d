"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, unplaced

#: Edges that one union-find holds at a time; more edges are contracted in more pieces.
PIECE = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace edges by stars of the same components, piece by piece."""
    parent: dict[int, int] = {}
    held = 0

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        found = [(x, r) for x in parent if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
            held += 1
            if held >= PIECE:
                yield stars()
                parent, held = {}, 0
    if parent:
        yield stars()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node with an edge to another node.

    edges: two long columns a and b. Nulls and loops are ignored. Each partition first contracts its own
    edges to stars, and so do then as many partitions as hold PIECE edges each; if that is one, it is done. Large-star
    and small-star steps, each a minimum by node that is joined back, then run until no edge changes, which
    takes a number of rounds that grows with the logarithm of the nodes. A node with a third of all edges is one row after the
    minimum, and its join is split by Spark's skew handling.
    """
    plain = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    now = cut(plain.mapInArrow(_contract, "a long, b long"))
    pieces = max(-(-now.count() // PIECE), 1)
    now = now.coalesce(pieces).mapInArrow(_contract, "a long, b long")
    if pieces == 1:
        return cut(now).select(F.col("a").alias("node"), F.col("b").alias("component"))
    now = cut(now.distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        # The minima are joined by a key that is not known to be grouped, so that hot nodes are split.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        least = least.withColumn("u", unplaced(F.col("u")))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        lowest = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(lowest.withColumn("u", unplaced(F.col("u"))), F.col("a") == F.col("u"))
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("u", "m"))
        now = cut(small.distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
