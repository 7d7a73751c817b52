"""Whitening of vectors of whole numbers, from exact sums.

Products of whole numbers are summed by digit-slice matrix products: numbers are split into limbs of LIMB bits, so that
float64 products of a batch's limbs stay exact (rows of a batch times 2^(2 LIMB) is at most 2^53); the products of each
pair of limbs are put together as big integers, per task. Tasks hand these over in digits of 32 bits, which Spark adds up
as longs, and the driver, which gets one row for each pair of dimensions and digit, makes big integers of them again.
With n distinct vectors, sums S and products G, the centred covariance is (n G - S S') / n^2, exact up to its rounding to
doubles at the very end, however small deviations are beside means. Its eigenvectors come from numpy's solver.

What goes to the driver grows with the square of the number of dimensions (2,145 sums for 64), never with rows.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped. Shorter vectors count as
ending in zeros. Repeated vectors count once in the fit, and each row has its results. A component without variance
(e at most the rounding error of the largest) has whitened null and doesn't count in identity_error; explained is null
where nothing varies. A deviation beyond a long is null. With fewer dimensions than components there are as many
components as dimensions; an empty table gives an empty table. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, work
from .vectors import largest, matrix, whole_vectors

#: Bits of a limb, and rows of one product: ROWS * 2^(2 LIMB) = 2^53.
LIMB, ROWS = 20, 8192
DIGIT = 32


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as float64 limbs of LIMB bits, lowest first; the last carries the sign."""
    out = []
    while largest(x) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*out, x.astype(np.float64)]


def products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers, exact for any int64 x."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for i in range(0, len(x), ROWS):
        parts = limbs(x[i : i + ROWS])
        for a, left in enumerate(parts):
            for b in range(a, len(parts)):
                one = (left.T @ parts[b]).astype(np.int64).astype(object) << (LIMB * (a + b))
                total = total + one + (one.T if b > a else 0)
    return total


def digits(v: int) -> list[int]:
    """v in digits of DIGIT bits, lowest first; the last one carries the sign."""
    out = []
    while not -(1 << DIGIT) < v < 1 << DIGIT:
        out.append(v & ((1 << DIGIT) - 1))
        v >>= DIGIT
    return [*out, v]


def _sums(batches):
    """(i, j, digit, v) of a task: its number of rows at (-1, -1), the sum of dimension j at (-1, j), products at (i, j), i <= j."""
    n, s, g = 0, np.zeros(0, object), np.zeros((0, 0), object)
    for b in batches:
        x = matrix(b.column(0), len(s))
        if x.shape[1] > len(s):
            old, s, g = (s, g), np.zeros(x.shape[1], object), np.zeros((x.shape[1],) * 2, object)
            s[: len(old[0])], g[: len(old[0]), : len(old[0])] = old
        one = np.hstack([x, np.ones((len(x), 1), np.int64)])  # sums are products with ones
        p = products(one)
        n, s, g = n + len(x), s + p[:-1, -1], g + p[:-1, :-1]
    rows = [(-1, -1, n), *((-1, j, v) for j, v in enumerate(s)), *((i, j, g[i, j]) for i in range(len(s)) for j in range(i, len(s)))]
    out = [(i, j, d, v) for i, j, total in rows for d, v in enumerate(digits(int(total)))]
    i, j, d, v = zip(*out, strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(d, pa.int32()), pa.array(v, pa.int64())], ["i", "j", "digit", "v"])


@dataclass
class Whitening:
    """n fitted vectors, their sums, eigenvalues by falling size, unit eigenvectors as columns, and the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def varies(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        least = self.values.max(initial=0.0) * self.width * np.finfo(float).eps
        return self.values > least

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: int64, or Python integers where these don't fit."""
        s = np.array(self.sums, object)
        fits = self.n * largest(x) + max((abs(v) for v in self.sums), default=0) < 1 << 62
        return x * np.int64(self.n) - s.astype(np.int64) if fits else x.astype(object) * self.n - s

    def squared(self, d: np.ndarray) -> list[int | None]:
        """Sums of squares of deviations, None where beyond a long."""
        if d.dtype != object and largest(d) ** 2 * max(1, self.width) < 1 << 63:
            return (d * d).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in (sum(int(c) ** 2 for c in row) for row in d)]

    def project(self, d: np.ndarray, components: int) -> np.ndarray:
        """Whitened components of deviations; NaN where there is no variance."""
        keep_ = self.varies()[:components]
        scale = np.where(keep_, 1 / np.sqrt(np.where(keep_, self.values[:components], 1.0)), np.nan)
        centred = (d / self.n).astype(np.float64) if d.dtype == object else d / float(self.n)
        return centred @ self.vectors[:, :components] * scale


def fit_whitening(distinct: DataFrame) -> Whitening | None:
    """The whitening of a table (x array<long>) of distinct vectors; None if it has no rows."""
    by = ["i", "j", "digit"]
    rows = distinct.mapInArrow(_sums, "i int, j int, digit int, v long").groupBy(*by).agg(F.sum("v").alias("v")).collect()
    total: dict[tuple[int, int], int] = {}
    for r in rows:
        total[r["i"], r["j"]] = total.get((r["i"], r["j"]), 0) + (r["v"] << (DIGIT * r["digit"]))
    n = total.get((-1, -1), 0)
    if not n:
        return None
    width = 1 + max((j for i, j in total), default=-1)
    s = [total[-1, j] for j in range(width)]
    v = np.array([[(n * total[min(i, j), max(i, j)] - s[i] * s[j]) / (n * n) for j in range(width)] for i in range(width)], float).reshape(width, width)
    values, vectors = np.linalg.eigh(v) if width else (np.zeros(0), np.zeros((0, 0)))
    trace = sum(n * total[j, j] - s[j] * s[j] for j in range(width)) / (n * n)
    return Whitening(n, s, values[::-1].copy(), vectors[:, ::-1].copy(), trace)


def _identity_error(distinct: DataFrame, fit: Whitening, components: int) -> float | None:
    """The largest entry of the fitted vectors' whitened covariance minus the identity, over components with variance.

    Each task centres at its own mean; tasks are put together by their means, also centred first.
    """
    used = np.flatnonzero(fit.varies()[:components])
    if not len(used):
        return None

    def parts(batches):
        for b in batches:
            w = fit.project(fit.deviations(matrix(b.column(0), fit.width)), components)[:, used]
            if len(w):
                mean = w.mean(0)
                yield pa.RecordBatch.from_pylist([{"m": float(len(w)), "mean": mean.tolist(), "c": ((w - mean).T @ (w - mean)).ravel().tolist()}])

    each = keep(distinct.mapInArrow(parts, "m double, mean array<double>, c array<double>"), "whitening-parts")
    k = range(len(used))
    mean = each.agg(*[F.sum(F.col("m") * F.get("mean", i)) / F.sum("m") for i in k]).first()
    apart = lambda i: F.get("mean", i) - F.lit(mean[i])
    cov = each.agg(*[F.sum(F.get("c", i * len(used) + j) + F.col("m") * apart(i) * apart(j)) / F.sum("m") for i in k for j in k]).first()
    return float(np.abs(np.array(list(cov)).reshape(len(used), -1) - np.eye(len(used))).max())


def whiten(rows: DataFrame, components: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of a table (vec_id, x array<long>)."""
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    with work(rows.sparkSession) as put:
        distinct = put(rows.select("x").distinct(), "whitening-fit")
        fit = fit_whitening(distinct)
        if fit is None:
            return rows.sparkSession.createDataFrame([], schema)
        error = _identity_error(distinct, fit, components)
    count = min(components, fit.width)
    explained = [float(v / fit.trace) if fit.trace else None for v in np.maximum(fit.values[:count], 0.0)]

    def run(batches):
        for b in batches:
            d = fit.deviations(matrix(b.column(1), fit.width))
            m, w = b.num_rows, fit.project(d, count)
            squares = pa.array(fit.squared(d), pa.int64()).take(pa.array(np.repeat(np.arange(m), count)))
            at = np.tile(np.arange(count), m)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), count))),
                    pa.array((at + 1).astype(np.int32)),
                    pa.array(np.full(m * count, fit.n, np.int64)),
                    squares,
                    pa.array(w.ravel(), pa.float64(), from_pandas=True),  # NaN: no variance
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * count), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 256))
