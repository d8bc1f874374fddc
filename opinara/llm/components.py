"""Connected components of a large graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.workspace import stored


def _least_neighbour(edges: DataFrame, node: str, other: str) -> DataFrame:
    # Written out, so that a node with very many neighbours can be split in the join that follows.
    return stored(edges.groupBy(node).agg(F.min(other).alias("least")), "least-neighbours")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the smallest node of its component.

    Each round first ties larger neighbours of a node to the smallest one, then the smaller ones, until no edge
    changes; the number of rounds grows with the logarithm of the graph's diameter. Every round
    starts from a written table. Repeated edges, loops and edges in either direction are fine; edges with a null end
    are left out.
    """
    a, b = F.col("a"), F.col("b")
    oriented = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    state = None
    while True:
        edges = stored(oriented, "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state or not now[0]:
            return edges.select(a.alias("node"), b.alias("root")).union(edges.select(b.alias("node"), b.alias("root"))).distinct()
        state = now
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = _least_neighbour(both, "a", "b").select(a, F.least("least", "a").alias("least"))
        large = stored(both.join(least, "a").where(b > a).select(b.alias("a"), F.col("least").alias("b")).distinct(), "edges")
        least = _least_neighbour(large, "a", "b")
        small = large.join(least, "a").where(b != F.col("least")).select(b.alias("a"), F.col("least").alias("b"))
        oriented = small.union(least.select(a, F.col("least").alias("b"))).distinct()
