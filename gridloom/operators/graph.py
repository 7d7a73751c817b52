"""Connected components of an edge table by star contraction, and tables that end a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share; a folder of our own only where the session names none and runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, own, True)
        named = "file://" + own
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/gridloom-{what}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read again: the lineage ends there."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with the place of each row in the order of key, from 0, without a window over all rows: rows are dealt by ranges
    of key, counted by range (a number a range comes to the driver) and numbered within their range."""
    ranged = saved(df.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranged")
    start, total = [], 0
    for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        start.append((r["__range"], total))
        total += r["n"]
    starts = df.sparkSession.createDataFrame(start, "__range int, __start long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, (F.col("__start") + place).cast("long")).drop("__range", "__start")


def _star(e: DataFrame, large: bool) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    rows = both.join(low, "a")
    if large:
        out = rows.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = rows.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches."""
    e = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        e = saved(_star(_star(e, True), False), "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
