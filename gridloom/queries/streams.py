"""Streams whose state is stopped and taken up again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table
from ..operators.graph import shared_path
from ..streaming import samples
from .registry import Registry

REG = Registry()

_CHANGES = """
WITH c AS (
    SELECT user_id, 1 AS n, value AS v, value * value AS s FROM events
    UNION ALL SELECT user_id, -1, -value, -value * value FROM events WHERE event_type = 'error'
    UNION ALL SELECT user_id, 0, 2 * value - value, 4 * value * value - value * value FROM events WHERE event_type = 'purchase'
), t AS (SELECT user_id, sum(n) AS n, sum(v) AS v, sum(s) AS s FROM c GROUP BY user_id)
SELECT user_id, CAST(n AS BIGINT) AS n, CASE WHEN n > 0 THEN round(v / n, 6) END AS mean, CASE WHEN n > 0 THEN round(s / n - (v / n) * (v / n), 4) END AS variance FROM t
"""


@REG("stream_running_samples", _CHANGES)
def running_samples(spark, sf_dir):
    """Every event's value comes to its user; errors are taken back and purchases doubled by a second run, from the first one's checkpoint."""
    log, target, state = (shared_path(spark, f"samples-{x}") for x in ("log", "rows", "state"))
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("value").cast("double").alias("value"))
    none = F.lit(None).cast("double")
    come = events.select("user_id", F.lit("push").alias("kind"), "value", none.alias("old"))
    gone = events.where("event_type = 'error'").select("user_id", F.lit("pop").alias("kind"), "value", none.alias("old"))
    doubled = events.where("event_type = 'purchase'").select("user_id", F.lit("replace").alias("kind"), (2 * F.col("value")).alias("value"), F.col("value").alias("old"))
    for part in (come, gone.unionByName(doubled)):
        part.write.mode("append").parquet(log)
        samples.follow(spark.readStream.schema(part.schema).parquet(log), target, state, "user_id")
    return samples.latest(spark, target).select(F.col("key").alias("user_id"), "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))
