"""Connected components of an edge list.

Edges are first contracted within partitions of a bounded size: union-find
leaves one edge from each node to the least node it reaches there. An edge list
of one such partition is done then. Larger ones go on with alternating
large-star and small-star steps, contracting after each round. Every step is an
aggregation and a join over the edges, so neither the graph nor a component
ever sits in one task; the rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_hot

#: Edges contracted in one task; union-find takes some 200 bytes for each.
LOCAL_EDGES = 500_000


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node of its component.

    Self-loops, repeated edges, either direction and nulls (skipped) are fine.
    No edges give no rows.
    """
    pairs = checkpointed(edges.toDF("a", "b").filter("a <> b"))
    count, state = pairs.count(), None
    while True:
        parts = -(-count // local_edges)
        pairs = checkpointed(_contracted(pairs, max(1, parts)))
        if parts <= 1:
            break
        pairs = checkpointed(_small_star(_large_star(pairs)))
        count, total = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, total) == state:
            break
        state = (count, total)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())


def _contracted(pairs: DataFrame, parts: int) -> DataFrame:
    """Edges of the same components: within each of ``parts`` partitions every node hangs under the least one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        hung = [(n, root) for n in nodes if (root := find(n)) != n]
        for at in range(0, len(hung), 100_000):
            a, b = zip(*hung[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return pairs.coalesce(parts).mapInArrow(run, "a bigint, b bigint")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is hung under the least node of its neighbourhood."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    # A hub has very many neighbours.
    hung = join_hot(both.filter("v > u"), least, "u")
    return hung.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung under the least of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    hung = join_hot(pairs, least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()
