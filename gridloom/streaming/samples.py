"""Running samples from a stream of changes: values come, go and are replaced; state survives a restart.

A change has a key, a kind ('push', 'pop' or 'replace'), a value and, for a replacement, the old value. Changes add up, so they are
first summed by key within each Arrow batch, where they are read: a hot key sends a row a batch to its task, not a row a change, and the
order in which changes come doesn't matter. A key's state is three numbers.

Defined results: a change without value (or a replacement without old value) counts for nothing; so does one without key; another kind
is an error. Mean and variance are null where no value is left. Other columns are ignored, also if they are named as a result column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = ("push", "pop", "replace")
SUMS = "n long, total double, squares double"


def deltas(changes: DataFrame, key: str, kind: str = "kind", value: str = "value", old: str = "old") -> DataFrame:
    """(key, n, total, squares): what changes add to their keys' sums, summed within each Arrow batch."""
    v, o = F.col(value).cast("double"), F.col(old).cast("double")
    sign = F.when(F.col(kind) == "push", 1).when(F.col(kind) == "pop", -1).when(F.col(kind) == "replace", 0)
    sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("kind of a change is one of push, pop and replace, not "), F.coalesce(F.col(kind), F.lit("null")))).cast("int"))
    back = F.when(F.col(kind) == "replace", o).otherwise(F.lit(0.0))
    signed = F.when(F.col(kind) == "pop", -1.0).otherwise(1.0)
    rows = changes.select(F.col(key).alias("key"), sign.cast("long").alias("n"), (signed * v - back).alias("total"), (signed * v * v - back * back).alias("squares"))

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.groupby("key", as_index=False, sort=False)[["n", "total", "squares"]].sum()

    whole = rows.where("key IS NOT NULL AND total IS NOT NULL")
    return whole.mapInPandas(add_up, whole.schema)


class Sums(StatefulProcessor):
    """Keeps (n, total, squares) of a key and gives its count, mean and population variance after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", SUMS)

    def handleInputRows(self, key: Any, rows: Iterable[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, total, squares = self.sums.get() if self.sums.exists() else (0, 0.0, 0.0)
        for b in rows:
            n, total, squares = n + int(b["n"].sum()), total + float(b["total"].sum()), squares + float(b["squares"].sum())
        self.sums.update((n, total, squares))
        mean = total / n if n > 0 else None
        yield pd.DataFrame({"key": [key[0]], "n": [n], "mean": pd.array([mean], "Float64"), "variance": pd.array([None if mean is None else squares / n - mean * mean], "Float64")})

    def close(self) -> None:
        pass


def running_samples(changes: DataFrame, key: str, kind: str = "kind", value: str = "value", old: str = "old") -> DataFrame:
    """(key, n, mean, variance) of each key that a batch touches, in update mode. The session must keep state in RocksDB (`rocks`)."""
    summed = deltas(changes, key, kind, value, old)
    out = f"key {summed.schema['key'].dataType.simpleString()}, n long, mean double, variance double"
    return summed.groupBy("key").transformWithStateInPandas(Sums(), out, "Update", "None")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State is kept in RocksDB for streams that start inside; the session's own choice comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def follow(changes: DataFrame, target: str, checkpoint: str, key: str, **columns: str) -> None:
    """Takes up every change that is there now, from where `checkpoint` stopped, and writes the touched keys' rows to `target`.

    A batch writes a folder of its own and replaces it when it runs again, so a batch repeated after a failure counts once.
    """
    spark = changes.sparkSession

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={batch}")

    with rocks(spark):
        q = running_samples(changes, key, **columns).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
        q.awaitTermination()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """(key, n, mean, variance): each key as its last batch left it."""
    rows = spark.read.parquet(target)
    return rows.groupBy("key").agg(F.max_by(F.struct("n", "mean", "variance"), "batch").alias("s")).select("key", "s.*")
