"""Connected components by alternating large-star and small-star steps, each a join and a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise, path_of, steps


def _large_star(edges: DataFrame) -> DataFrame | None:
    """Every node's greater neighbours link to the least of its neighbours and itself; None if the edges are stars around least nodes already.

    The least is a map-side combined minimum, and no neighbour list is ever gathered, so hubs are harmless. There is a row for each edge at most.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lesser, greater = F.count(F.when(F.col("b") < F.col("a"), 1)), F.count(F.when(F.col("b") > F.col("a"), 1))
    # Written first, so that the join shuffles both sides by itself (or broadcasts this one), and can split a hub's edges.
    least = materialise(both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"), ((lesser > 1) | (lesser > 0) & (greater > 0)).alias("open")), "least")
    if least.filter("open").isEmpty():
        return None
    return both.join(least, both["a"] == least["u"]).filter("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node (a) and its lesser neighbours (b) link to the least of these."""
    least = materialise(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
    joined = edges.join(least, edges["a"] == least["u"])
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of the undirected edges (a long, b long); the root is the component's least node.

    Nodes that only link to themselves do not appear. Each round is written to the shared folder, so a lost
    executor repeats one round at most; edges that are stars need none. Raises if ``rounds`` do not suffice, which no graph needs
    (the steps take a number of rounds logarithmic in the nodes).
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        old, before = path_of(now), steps()
        moved = _large_star(now)
        if moved is None:
            forget(edges.sparkSession, steps() - before)
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select("b", "b").toDF("node", "root").distinct())
        # Written, as the small star reads it twice. All its links point down.
        now = materialise(_small_star(materialise(moved, "moved")), "edges")
        forget(edges.sparkSession, {old, *steps() - before} - {path_of(now)})
    raise RuntimeError("components did not settle")
