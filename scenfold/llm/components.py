"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to the least of it and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(
        both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"), F.count("*").alias("n"))
    )
    return (
        spread_join(both, least, "u").filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stored(down.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")))
    moved = (
        spread_join(down, least, "u").filter(F.col("v") != F.col("least"))
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
    )
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of an edge; a component is named by its least node.

    ``edges`` has two long columns (u, v). Large-star and small-star steps alternate until nothing
    changes (about log^2 of the nodes rounds at most). A step's minimum is combined map-side; that of
    a hot node is broadcast to its links (``spread_join``), so no task gets them all. Every round is written to the shared folder.
    """
    current = stored(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct())
    state = None
    while True:
        after = current.agg(
            F.count("*"), F.sum((F.xxhash64("u", "v") % (1 << 40)).cast("decimal(38,0)"))
        ).first()
        if after == state or not after[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        state = after
        current = stored(_small_star(_large_star(current)))
