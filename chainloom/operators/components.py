"""Connected components as alternating large-star / small-star rounds of joins.

Each round is two (aggregate, join) pairs on the node key.  The aggregate combines map-side, so a
hub costs one row per map task.  The aggregate's rows are dealt anew before the join back, which makes both
sides of that join plain shuffles: only such a join can AQE split where a hub's edges fill a partition
(or broadcast, where the aggregate is small).  Rounds grow with the logarithm of the diameter, not with the diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.storage import settle


def _dealt_anew(low: DataFrame) -> DataFrame:
    """The same rows without the partitioning by ``a`` that their aggregation left, which a join would reuse."""
    return low.repartition("a", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than the node is hung on the smallest node of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _dealt_anew(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger to the smaller end; all smaller ends meet in the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(_dealt_anew(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that an edge touches; component is its smallest node.

    Self-edges give single nodes.  Rows with a null end are ignored.  Any orderable key type works.
    Convergence is decided by one counter per round (edges that the round changed), nothing else is
    brought to the driver.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    pairs = settle(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")  # ``edges`` may be a costly plan: it runs once
    state = pairs.where("a <> b")
    for _ in range(max_rounds):
        after = settle(_small_star(_large_star(state)).distinct(), "stars")
        # a forest of stars is stable: no node has two parents and no parent has one
        roots = after.select(F.col("b").alias("a")).distinct()
        loose = after.groupBy("a").count().where("count > 1").select("a").unionByName(after.join(_dealt_anew(roots.withColumn("m", F.lit(0))), "a", "left_semi").select("a"))
        state = after
        if loose.isEmpty():
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(state.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
