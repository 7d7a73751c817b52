"""Aggregations over images and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..layout import Grid


def summary(df: DataFrame, *by: str) -> DataFrame:
    """sum, mean, square_sum, mean_square, rms, variance (population), sd, norm2, min, max, max_abs of v, in one pass."""
    v = F.col("v")
    sq = F.sum(v.cast("double") * v)
    var = F.avg(v.cast("double") * v) - F.avg(v) * F.avg(v)
    return df.groupBy(*by).agg(
        F.sum(v).alias("sum"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), sq.alias("square_sum"), F.avg(v.cast("double") * v).alias("mean_square"), F.sqrt(F.avg(v.cast("double") * v)).alias("rms"),
        var.alias("variance"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), F.sqrt(sq).alias("norm2"), F.min(v).alias("min"), F.max(v).alias("max"), F.max(F.abs(v)).alias("max_abs"),
    )


def median(df: DataFrame, *by: str) -> DataFrame:
    """(by, median): exact upper median from counts of the distinct values, so a group's rows never meet in one list."""
    counts = df.groupBy(*by, "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy("v")
    whole = Window.partitionBy(*by)
    at = counts.withColumns({"to": F.sum("n").over(w), "total": F.sum("n").over(whole)})
    return at.where(F.col("to") > F.floor(F.col("total") / 2)).groupBy(*by).agg(F.min("v").alias("median"))


def median_absolute_deviation(df: DataFrame, *by: str) -> DataFrame:
    """(by, median, mad)."""
    m = median(df, *by)
    off = df.join(m, list(by)).withColumn("v", F.abs(F.col("v") - F.col("median")))
    return m.join(median(off, *by).withColumnRenamed("median", "mad"), list(by))


def outlier_range(df: DataFrame, *by: str) -> DataFrame:
    """(by, low, high): median -+ 3 * 1.4826 * MAD."""
    m = median_absolute_deviation(df, *by)
    return m.select(*by, (F.col("median") - 3 * 1.4826 * F.col("mad")).alias("low"), (F.col("median") + 3 * 1.4826 * F.col("mad")).alias("high"))


def sum_partial(df: DataFrame, n: int) -> DataFrame:
    """(img, j, v): sums of the voxels whose idx leaves j modulo n."""
    return df.groupBy("img", (F.col("idx") % n).alias("j")).agg(F.sum("v").alias("v"))


def pair_statistics(pair: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """inner_product, rmse, covariance, correlation (0 without variance), slope, intercept, r2 of b on a, in one pass."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    s = pair.agg(F.count("*").alias("n"), F.sum(x * y).alias("xy"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * y).alias("mxy"), F.avg(x * x).alias("mxx"), F.avg(y * y).alias("myy"), F.avg((x - y) * (x - y)).alias("mse"))
    cov, vx, vy = F.col("mxy") - F.col("mx") * F.col("my"), F.col("mxx") - F.col("mx") * F.col("mx"), F.col("myy") - F.col("my") * F.col("my")
    slope = F.when(vx > 0, F.try_divide(cov, vx)).otherwise(F.lit(0.0))
    corr = F.when((vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))).otherwise(F.lit(0.0))
    return s.select(F.col("xy").alias("inner_product"), F.sqrt("mse").alias("rmse"), F.coalesce(cov, F.lit(0.0)).alias("covariance"), corr.alias("correlation"), slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), (corr * corr).alias("r2"))


def correlation_positive(pair: DataFrame) -> DataFrame:
    """Correlation over the rows whose b is over 0."""
    return pair_statistics(pair.where("b > 0")).select("correlation")


def t_statistics(pair: DataFrame) -> DataFrame:
    """t_two: two samples, pooled; t_one: one sample (a) against 0."""
    x, y = F.col("a").cast("double"), F.col("b").cast("double")
    s = pair.agg(F.count("a").cast("double").alias("n"), F.count("b").cast("double").alias("m"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"))
    vx, vy = F.col("xx") - F.col("mx") * F.col("mx"), F.col("yy") - F.col("my") * F.col("my")
    n, m = F.col("n"), F.col("m")
    pooled = F.sqrt(F.try_divide(vx * (n - 1) + vy * (m - 1), n + m - 2)) * F.sqrt(1 / n + 1 / m)
    return s.select(F.try_divide(F.col("mx") - F.col("my"), pooled).alias("t_two"), (F.col("mx") * F.sqrt(F.try_divide(n - 1, vx))).alias("t_one"))


def center_of_mass(df: DataFrame) -> DataFrame:
    """Weighted means of the coordinates; the plain weighted sums where the total is 0."""
    total = F.sum("v").cast("double")
    parts = [F.coalesce(F.try_divide(F.sum(F.col(a) * F.col("v")).cast("double"), total), F.sum(F.col(a) * F.col("v")).cast("double")).alias(f"c{a}") for a in "xyz"]
    return df.groupBy("img").agg(*parts)


def center_of_mass_binary(df: DataFrame) -> DataFrame:
    return df.where("v <> 0").groupBy("img").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"])


def bounding_box(df: DataFrame, background=0, *by: str) -> DataFrame:
    """Half-open box of the voxels over the background."""
    ends = [e for a in "xyz" for e in (F.min(a).alias(f"{a}0"), (F.max(a) + 1).alias(f"{a}1"))]
    return df.where(F.col("v") > background).groupBy(*(by or ("img",))).agg(*ends, F.count("*").alias("n"))


def project(df: DataFrame, axis: str) -> DataFrame:
    """Sums along an axis."""
    keep = [a for a in "xyz" if a != axis]
    return df.groupBy("img", *keep).agg(F.sum("v").alias("v"))


def arg_extremes(df: DataFrame) -> DataFrame:
    """(img, arg_max, arg_min): the first index of each."""
    return df.groupBy("img").agg(F.max_by("idx", F.struct("v", -F.col("idx"))).alias("arg_max"), F.min_by("idx", F.struct("v", "idx")).alias("arg_min"))


def long_axis(grid: Grid) -> DataFrame:
    """(img, axis): the axis (0, 1, 2) along which the box of what is over 0 is longest; the lowest of equals."""
    b = bounding_box(grid.df)
    size = [F.struct((F.col(f"{a}1") - F.col(f"{a}0")).alias("n"), F.lit(-i).alias("k")) for i, a in enumerate("xyz")]
    return b.select("img", (-F.greatest(*size)["k"]).alias("axis"))


def symmetric_axis(grid: Grid) -> DataFrame:
    """(img, axis): the axis whose mirror image differs least (sum of absolute differences); the lowest of equals."""
    df = grid.df.select("img", "x", "y", "z", "v")
    out = None
    for i, (a, n) in enumerate(zip("xyz", grid.shape, strict=True)):
        other = df.withColumn(a, n - 1 - F.col(a)).withColumnRenamed("v", "m")
        d = df.join(other, ["img", "x", "y", "z"]).groupBy("img").agg(F.sum(F.abs(F.col("v") - F.col("m"))).cast("double").alias("d")).select("img", F.struct("d", F.lit(i).alias("axis")).alias("s"))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("img").agg(F.min("s")["axis"].alias("axis"))


def region_boxes(df: DataFrame, label: str = "v") -> DataFrame:
    """(img, label, x0, x1, y0, y1, size_x, size_y, n, cx, cy): inclusive 2D boxes, sizes and centres of the labels over 0."""
    return df.where(F.col(label) > 0).groupBy("img", F.col(label).alias("label")).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), (F.max("x") - F.min("x") + 1).alias("size_x"), (F.max("y") - F.min("y") + 1).alias("size_y"), F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def argmax_channel(channels: DataFrame) -> DataFrame:
    """(idx, label): the channel (from 1) with the highest p, the lowest of equals; channels has (idx, ch, p), ch from 0."""
    return channels.groupBy("idx").agg((F.max_by("ch", F.struct("p", -F.col("ch"))) + 1).alias("label"))


def softmax(channels: DataFrame) -> DataFrame:
    w = Window.partitionBy("idx")
    e = channels.withColumn("e", F.exp(F.col("p") - F.max("p").over(w)))
    return e.select("idx", "ch", (F.col("e") / F.sum("e").over(w)).alias("p"))


def gaussian_distribution(x: Column, mean: float, sd: float) -> Column:
    return F.lit(0.0) if sd == 0 else F.exp(-(x - mean) * (x - mean) / (2.0 * sd * sd)) / (sd * 2.5066282746310002)


def gaussian_radial_basis(r: Column, sd: float) -> Column:
    return F.lit(0.0) if sd == 0 else F.exp(-(r * r) / (2.0 * sd * sd))


def normal_dist(seed: int, mean: float = 0.0, sd: float = 1.0) -> Column:
    return F.randn(seed) * sd + mean


def uniform_dist(seed: int, low: float = 0.0, high: float = 1.0) -> Column:
    return F.rand(seed) * (high - low) + low


def bernoulli(seed: int, p: float = 0.5) -> Column:
    return (F.rand(seed) < p).cast("int")


def multiple_regression(rows: DataFrame, y: str, x: list[str]) -> dict:
    """Least squares of y on the columns x: b, t, rmse. The moments are one aggregate; only k^2 numbers come to the driver."""
    import numpy as np

    k = len(x)
    moments = [F.sum(F.col(p).cast("double") * F.col(q)).alias(f"m{i}_{j}") for i, p in enumerate(x) for j, q in enumerate(x) if j >= i]
    s = rows.agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double") * F.col(y)).alias("yy"), *[F.sum(F.col(p).cast("double") * F.col(y)).alias(f"y{i}") for i, p in enumerate(x)], *moments).first()
    a = np.array([[s[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    c = np.array([s[f"y{i}"] for i in range(k)])
    b = np.linalg.solve(a, c)
    rss = max(0.0, s["yy"] - 2 * b @ c + b @ a @ b)
    rmse = float(np.sqrt(rss / (s["n"] - k))) if s["n"] > k else 0.0
    se = rmse * np.sqrt(np.diag(np.linalg.inv(a)))
    return {"b": b.tolist(), "t": [float(u / v) if v else 0.0 for u, v in zip(b, se, strict=True)], "rmse": rmse}


def residual(rows: DataFrame, y: str, x: list[str], b: list[float], name: str = "residual") -> DataFrame:
    """rows with y less its fit, the sum of the columns x times their coefficients b."""
    fit = sum((F.col(p) * float(c) for p, c in zip(x, b, strict=True)), F.lit(0.0))
    return rows.withColumn(name, F.col(y) - fit)
