"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from likewise.sources.staging import stage


#: Edges that one task writes.
EDGES_PER_TASK = 1 << 18


def _written(edges: DataFrame, at_most: int | None) -> tuple[DataFrame, tuple]:
    """The edges, written in as few parts as they need, with their number and checksum."""
    if at_most is not None:
        edges = edges.coalesce(max(1, at_most // EDGES_PER_TASK + 1))
    edges = stage(edges, "edges")
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return edges, tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from every node that has an edge.

    ``edges`` has two long columns ``a`` and ``b`` in any order, repeats and loops allowed.
    Large-star and small-star steps alternate until only stars are left: they replace edges by edges to smaller nodes and never make more of them. Edges are written to the shared
    folder after each step; the driver sees one count and one checksum.
    """
    a, b = F.least("a", "b"), F.greatest("a", "b")
    given = edges.select(a.alias("b"), b.alias("a")).where("a != b").distinct()
    now, state = _written(given, None)
    while state[0]:
        # Every node's larger neighbours are tied to its smallest neighbour.
        both = now.unionByName(now.select(F.col("a").alias("b"), F.col("b").alias("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least.select("a", F.least("a", "m").alias("m")), "a")
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        large, after = _written(large, state[0])
        if after == state and large.groupBy("a").count().where("count > 1").isEmpty():
            break  # all edges lead to roots, one from each node
        # Every node's smaller neighbours, and the node, are tied to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b")
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        now, state = _written(small, after[0])
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.unionByName(roots)
