"""Registration: costs are aggregates over the resampled pair; the optimiser on the driver sees a number an evaluation.

A plain affine search resamples by lookup joins; affine_search.py has the one in voxel sizes by stages and levels, and
displacement.py that for a displacement field.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transform import affine
from ..layout import AXES, Grid
from .resample import resample_affine
from .stats import pair_statistics


def joint_histogram(pair: DataFrame, bins: int = 256) -> DataFrame:
    """(p, q, n): bins of (a, b) over their own ranges."""
    ends = pair.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    bin_ = lambda v, lo, hi: F.coalesce(F.least(F.floor(F.try_divide((F.col(v) - F.col(lo)).cast("double") * bins, (F.col(hi) - F.col(lo)).cast("double"))), F.lit(bins - 1)), F.lit(0)).cast("int")
    return pair.crossJoin(F.broadcast(ends)).groupBy(bin_("a", "a0", "a1").alias("p"), bin_("b", "b0", "b1").alias("q")).agg(F.count("*").alias("n"))


def mutual_information(pair: DataFrame, bins: int = 256) -> DataFrame:
    """(mi): sum over the joint histogram of P log(P / (Pa Pb)); at most bins^2 rows are left after the first aggregate."""

    h = joint_histogram(pair, bins)
    total = h.agg(F.sum("n").alias("t"))
    pa = h.groupBy("p").agg(F.sum("n").alias("np"))
    qa = h.groupBy("q").agg(F.sum("n").alias("nq"))
    rows = h.join(pa, "p").join(qa, "q").crossJoin(F.broadcast(total))
    return rows.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n").cast("double") * F.col("t") / (F.col("np").cast("double") * F.col("nq")))).alias("mi"))


def pair_of(a: Grid, b: Grid) -> DataFrame:
    return a.df.select("img", "idx", F.col("v").alias("a")).join(b.df.select("img", "idx", F.col("v").alias("b")), ["img", "idx"])


def correlation_cost(fixed: Grid, moving: Grid, m: list[float]) -> float:
    """1 - r^2 after resampling the moving image."""
    r = pair_statistics(pair_of(fixed, resample_affine(moving, fixed.shape, m))).first()["correlation"]
    return 1.0 - r * r


def mutual_information_cost(fixed: Grid, moving: Grid, m: list[float]) -> float:
    return -(mutual_information(pair_of(fixed, resample_affine(moving, fixed.shape, m))).first()["mi"] or 0.0)


def correlation_costs(fixed: Grid, moving: Grid, matrices: list[list[float]]) -> list[float]:
    """1 - r^2 for each 3x4 matrix, in one job; what lies outside the moving image counts as 0.

    Every fixed voxel meets every matrix and its 2^dim source voxels; the sums a matrix needs come back, a row each.
    """
    dim = fixed.dim
    many = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(v)) for v in m]).alias("m")) for i, m in enumerate(matrices)])
    rows = fixed.df.select("img", "idx", *AXES, F.col("v").cast("double").alias("a"), F.explode(many).alias("c")).select("img", "idx", "a", F.col("c.i").alias("i"), *[(F.get("c.m", 4 * k) * F.col("x") + F.get("c.m", 4 * k + 1) * F.col("y") + F.get("c.m", 4 * k + 2) * F.col("z") + F.get("c.m", 4 * k + 3)).alias(f"p{a}") for k, a in enumerate(AXES)])
    for k, (a, n) in enumerate(zip(AXES, moving.shape, strict=True)):
        low = F.floor(f"p{a}").cast("int")
        if k < dim:
            near = F.array(*[F.struct((low + b).alias("at"), (F.col(f"p{a}") - low if b else 1.0 - (F.col(f"p{a}") - low)).alias("w")) for b in (0, 1)])
            rows = rows.where((low >= 0) & (low + 1 < n)).withColumn(f"t{a}", F.explode(near))
        else:
            rows = rows.withColumn(f"t{a}", F.struct(F.lit(0).alias("at"), F.lit(1.0).alias("w")))
    taps = rows.select("img", "idx", "a", "i", *[F.col(f"t{a}.at").alias(a) for a in AXES], (F.col("tx.w") * F.col("ty.w") * F.col("tz.w")).alias("w")).where("w <> 0")
    hit = taps.join(moving.df.select("img", *AXES, F.col("v").cast("double").alias("b")), ["img", *AXES])
    hit = hit.groupBy("i", "img", "idx").agg(F.first("a").alias("a"), F.sum(F.col("w") * F.col("b")).alias("b"))
    sums = {r["i"]: r for r in hit.groupBy("i").agg(F.sum("b").alias("b"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.sum(F.col("a") * F.col("b")).alias("ab")).collect()}
    n, sa, saa = fixed.df.agg(F.count("*"), F.sum(F.col("v").cast("double")), F.sum(F.col("v").cast("double") * F.col("v"))).first()
    out = []
    for i in range(len(matrices)):
        r = sums.get(i)
        cov, va, vb = (0.0, 0.0, 0.0) if r is None else (n * r["ab"] - sa * r["b"], n * saa - sa * sa, n * r["bb"] - r["b"] ** 2)
        out.append(1.0 - cov * cov / (va * vb) if va > 0 and vb > 0 else 1.0)
    return out


def gradient_of(cost: Callable[[np.ndarray], float], x: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Forward differences."""
    f = cost(x)
    return np.array([(cost(x + np.eye(len(x))[i] * step[i]) - f) / step[i] for i in range(len(x))])


def line_search(cost: Callable[[np.ndarray], float], x: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 3, points: int = 4) -> tuple[np.ndarray, float]:
    """Box-bounded coordinate search with a range that halves; deterministic."""
    best, value = x.copy(), cost(x)
    span = (high - low) / 2
    for _ in range(rounds):
        for i in range(len(x)):
            for t in np.linspace(-1, 1, points + 1):
                y = best.copy()
                y[i] = np.clip(best[i] + t * span[i], low[i], high[i])
                c = cost(y)
                if c < value:
                    best, value = y, c
        span = span / 2
    return best, value


def gradient_descent(cost, x: np.ndarray, low: np.ndarray, high: np.ndarray, step: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Box-bounded descent with Armijo back-tracking."""
    value = cost(x)
    for _ in range(rounds):
        g = gradient_of(cost, x, step)
        if not np.any(g):
            break
        d = -g / np.abs(g / (high - low + 1e-12)).max()
        t = 0.5
        while t > 1e-3:
            y = np.clip(x + t * d, low, high)
            c = cost(y)
            if c < value + 1e-4 * (g @ (y - x)):
                break
            t /= 2
        else:
            break
        x, value = y, c
    return x, value


def linear(fixed: Grid, moving: Grid, low, high, cost: str = "corr", rounds: int = 2) -> tuple[list[float], float]:
    """Search of the twelve affine parameters (shift, angles, scaling, shear) within bounds: (3x4 matrix, cost)."""
    fun = correlation_cost if cost == "corr" else mutual_information_cost
    build = lambda p: affine(p[:3], p[3:6], p[6:9], p[9:12]).ravel().tolist()
    start = np.array([0, 0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0], float)
    free = np.flatnonzero(np.asarray(high) > np.asarray(low))

    def value(p):
        full = start.copy()
        full[free] = p
        return fun(fixed, moving, build(full))

    p, v = line_search(value, start[free], np.asarray(low, float)[free], np.asarray(high, float)[free], rounds)
    full = start.copy()
    full[free] = p
    return build(full), v
