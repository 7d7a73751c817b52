"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

ROUNDS = 40


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Each step's minimum is added up map-side, so a hub costs one row a task; its rows are then
    joined to that minimum, where Spark may split a hub's rows over tasks."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    rows = both.join(low, "a")
    if large:
        return rows.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    return rows.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b): root is the smallest node that the node reaches.

    Rounds grow with the logarithm of a component's size. Each round is written to the shared folder; only two
    numbers of it come to the driver.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    last = None
    for _ in range(ROUNDS):
        e = keep(_star(_star(e, True), False), "cc")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
    raise RuntimeError(f"components didn't settle in {ROUNDS} rounds")
