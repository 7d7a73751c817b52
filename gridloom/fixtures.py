"""Images derived from the relational test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import Grid, empty_grid

VOL_SHAPE, IMG_SHAPE = (16, 12, 7), (32, 24, 1)

VOL_SQL = """a AS (SELECT CAST(l_suppkey % 4 AS BIGINT) AS img, CAST(l_partkey % 16 AS INT) AS x, CAST(l_orderkey % 12 AS INT) AS y, CAST(l_linenumber - 1 AS INT) AS z, SUM(CAST(l_quantity AS BIGINT)) AS s FROM lineitem GROUP BY 1, 2, 3, 4),
g AS (SELECT i.i AS img, CAST(n.n % 16 AS INT) AS x, CAST((n.n // 16) % 12 AS INT) AS y, CAST(n.n // 192 AS INT) AS z, CAST(n.n AS BIGINT) AS idx FROM range(4) i(i), range(1344) n(n)),
vol AS (SELECT g.img, g.x, g.y, g.z, g.idx, CAST(COALESCE(a.s, 0) AS BIGINT) AS v FROM g LEFT JOIN a ON a.img = g.img AND a.x = g.x AND a.y = g.y AND a.z = g.z)"""

IMG_SQL = """b AS (SELECT CAST(o_custkey % 32 AS INT) AS x, CAST(o_orderkey % 24 AS INT) AS y, COUNT(*) AS s FROM orders GROUP BY 1, 2),
pic AS (SELECT CAST(0 AS BIGINT) AS img, CAST(n.n % 32 AS INT) AS x, CAST(n.n // 32 AS INT) AS y, 0 AS z, CAST(n.n AS BIGINT) AS idx, CAST(COALESCE(b.s, 0) AS BIGINT) AS v FROM range(768) n(n) LEFT JOIN b ON b.x = n.n % 32 AND b.y = n.n // 32)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Small rows with much work each, dealt by a key to as many tasks as a shuffle has: a compact file, which few tasks read,
    would leave the work to those. The number is given, so that small partitions aren't put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def vol(spark: SparkSession, sf_dir: str) -> Grid:
    """Four volumes of 16 x 12 x 7: quantities of line items."""
    t = table(spark, sf_dir, "lineitem")
    keys = [(F.col("l_suppkey") % 4).cast("long").alias("img"), (F.col("l_partkey") % 16).cast("int").alias("x"), (F.col("l_orderkey") % 12).cast("int").alias("y"), (F.col("l_linenumber") - 1).cast("int").alias("z")]
    sums = t.groupBy(*keys).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    at = empty_grid(spark, [0, 1, 2, 3], VOL_SHAPE)
    return Grid(at.join(sums, ["img", "x", "y", "z"], "left").select("img", "x", "y", "z", "idx", F.coalesce("v", F.lit(0)).cast("long").alias("v")), VOL_SHAPE)


def pic(spark: SparkSession, sf_dir: str) -> Grid:
    """One image of 32 x 24: counts of orders."""
    t = table(spark, sf_dir, "orders")
    sums = t.groupBy((F.col("o_custkey") % 32).cast("int").alias("x"), (F.col("o_orderkey") % 24).cast("int").alias("y")).agg(F.count("*").alias("v"))
    at = empty_grid(spark, [0], IMG_SHAPE)
    return Grid(at.join(sums, ["x", "y"], "left").select("img", "x", "y", "z", "idx", F.coalesce("v", F.lit(0)).cast("long").alias("v")), IMG_SHAPE)


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, a, b): volumes 0 and 1 side by side."""
    df = vol(spark, sf_dir).df
    return df.where("img = 0").select("idx", F.col("v").alias("a")).join(df.where("img = 1").select("idx", F.col("v").alias("b")), "idx")


PAIR_SQL = VOL_SQL + ", pair AS (SELECT p.idx, p.v AS a, q.v AS b FROM vol p JOIN vol q ON p.idx = q.idx AND p.img = 0 AND q.img = 1)"
