"""Running statistics over streams, and windowed counts with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sample:
    """Incremental mean and population variance with removal and replacement."""

    def __init__(self, n: int = 0, total: float = 0.0, squares: float = 0.0):
        self.n, self.total, self.squares = n, total, squares

    def push(self, v: float) -> None:
        self.n, self.total, self.squares = self.n + 1, self.total + v, self.squares + v * v

    def pop(self, v: float) -> None:
        self.n, self.total, self.squares = self.n - 1, self.total - v, self.squares - v * v

    def replace(self, old: float, new: float) -> None:
        self.total, self.squares = self.total + new - old, self.squares + new * new - old * old

    def mean_variance(self) -> tuple[float, float]:
        if not self.n:
            return 0.0, 0.0
        m = self.total / self.n
        return m, self.squares / self.n - m * m


def running_statistics(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, variance): a plain streaming aggregate; state is three numbers a key."""
    v = F.col(value).cast("double")
    m = F.avg(v)
    return rows.groupBy(key).agg(F.count(v).alias("n"), m.alias("mean"), (F.avg(v * v) - m * m).alias("variance"))


def windowed_counts(rows: DataFrame, time: str, width: str, late: str = "10 minutes", *by: str, slide: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding windows, state dropped behind the watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return rows.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(rows: DataFrame, time: str, gap: str, key: str, late: str = "10 minutes") -> DataFrame:
    w = F.session_window(time, gap)
    return rows.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def incremental_samples(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, variance) after each batch, from state that survives it."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = Sample(*state.get) if state.exists else Sample()
        for b in batches:
            for v in b[value]:
                s.push(float(v))
        state.update((s.n, s.total, s.squares))
        m, var = s.mean_variance()
        yield pd.DataFrame({key: [k[0]], "n": [s.n], "mean": [m], "variance": [var]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, mean double, variance double", "n long, total double, squares double", "update", "NoTimeout")
