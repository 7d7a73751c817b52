"""Fixed-frame windows: filters and gradients.

A filter along an axis is a window over that line (lag and lead). Volumes are first dealt by plane, (img, z): windows along
x and along y are then satisfied where the rows are, and only z needs an exchange of its own, by (img, x, y). Passes that
follow start with the axis the rows are dealt for. No task holds a whole volume. Borders are clamped: a missing neighbour is
the voxel itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..layout import Grid, reindex
from .graph import saved

AXES = ("x", "y", "z")


def sides(grid: Grid, axis: str, col: str = "v") -> tuple[Column, Column, Column]:
    """(before, here, after) along an axis, clamped."""
    w, c = grid.line(axis), F.col(col)
    return F.coalesce(F.lag(c).over(w), c), c, F.coalesce(F.lead(c).over(w), c)


def smooth(grid: Grid, axis: str, col: str = "v") -> Column:
    a, b, c = sides(grid, axis, col)
    return a + 2 * b + c


def derivative(grid: Grid, axis: str, col: str = "v") -> Column:
    a, _, c = sides(grid, axis, col)
    return c - a


def axes(grid: Grid) -> tuple[str, ...]:
    return AXES[: grid.dim]


def planes(df: DataFrame, dim: int) -> DataFrame:
    """Rows dealt by plane. 2D images are left to their lines: a plane would be the whole image."""
    return df.repartition("img", "z") if dim == 3 else df


def passes(grid: Grid, step: Callable[[Grid, str], Grid], times: int = 1) -> Grid:
    """step along every axis, times over; every other pass runs z first, where the one before has left the rows."""
    for k in range(times):
        if grid.dim == 3 and k % 2:
            grid = step(grid, "z")
        grid = grid.with_df(planes(grid.df, grid.dim))
        for a in "xy":
            grid = step(grid, a)
        if grid.dim == 3 and not k % 2:
            grid = step(grid, "z")
    return grid


def gaussian(grid: Grid, bandwidth: int = 1) -> Grid:
    """[1 2 1] / 4 along each axis, bandwidth times."""
    return passes(grid, lambda g, a: g.map(smooth(g, a) / 4.0), bandwidth)


def mean(grid: Grid) -> Grid:
    """Mean of the three neighbours along each axis, clamped."""
    return passes(grid, lambda g, a: g.map(reduce(lambda p, q: p + q, sides(g, a)))).map(F.col("v") / float(3**grid.dim))


def sobel_parts(grid: Grid) -> Grid:
    """Columns gx, gy, gz: central difference along one axis, [1 2 1] along the others."""
    df, ax = planes(grid.df, grid.dim), axes(grid)
    for a in ax:
        df = df.withColumn(f"g{a}", derivative(grid, a))
    for a in ("z", "x", "y") if grid.dim == 3 else ax:  # a window along one axis serves all the columns it smooths
        if a == "x":
            df = planes(df, grid.dim)
        df = df.withColumns({f"g{b}": smooth(grid, a, f"g{b}") for b in ax if b != a})
    return grid.with_df(df)


def sobel(grid: Grid) -> Grid:
    """Sum of the absolute Sobel components."""
    g = sobel_parts(grid)
    return g.with_df(g.df.withColumn("v", reduce(lambda p, q: p + q, [F.abs(f"g{a}") for a in axes(grid)])).select(grid.df.columns))


def laplacian(grid: Grid) -> Grid:
    """Sum over axes of before - 2 here + after."""
    parts = []
    df = planes(grid.df, grid.dim)
    for a in axes(grid):
        b, h, c = sides(grid, a)
        df = df.withColumn(f"l{a}", b + c - 2 * h)
        parts.append(F.col(f"l{a}"))
    return grid.with_df(df.withColumn("v", reduce(lambda p, q: p + q, parts)).select(grid.df.columns))


def gradient_magnitude(grid: Grid) -> Grid:
    """Root of the summed squares of the central differences (not halved)."""
    df = planes(grid.df, grid.dim)
    for a in axes(grid):
        df = df.withColumn(f"g{a}", derivative(grid, a))
    return grid.with_df(df.withColumn("v", F.sqrt(reduce(lambda p, q: p + q, [F.col(f"g{a}") * F.col(f"g{a}") for a in axes(grid)]).cast("double"))).select(grid.df.columns))


def canny_edge(grid: Grid) -> Grid:
    """Sobel magnitude (L2) of a 2D image where it is not below its two neighbours across the edge; at a border its own."""
    g = sobel_parts(grid)
    df = g.df.withColumn("m", F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")))
    tan = 2.414213562373095
    ax, ay = F.abs("gx").cast("double"), F.abs("gy").cast("double")
    flat, steep = ax > ay * tan, ay > ax * tan
    df = df.withColumns({"dx": F.when(steep, 0).otherwise(1), "dy": F.when(flat, 0).when(steep, 1).when((F.col("gx") > 0) == (F.col("gy") > 0), 1).otherwise(-1)})
    near = df.select("img", "x", "y", "z", F.col("m").alias("n"))
    for sign in (1, -1):
        side = near.select("img", F.col("x").alias(f"x{sign}"), F.col("y").alias(f"y{sign}"), "z", F.col("n").alias(f"n{sign}"))
        df = df.withColumns({f"x{sign}": F.col("x") + sign * F.col("dx"), f"y{sign}": F.col("y") + sign * F.col("dy")}).join(side, ["img", "z", f"x{sign}", f"y{sign}"], "left")
    border = F.col("n1").isNull() | F.col("n-1").isNull()
    value = F.when(F.col("m") == 0, F.lit(0.0)).when(border, F.col("m")).when((F.col("m") >= F.col("n1")) & (F.col("m") >= F.col("n-1")), F.col("m")).otherwise(F.lit(0.0))
    return grid.with_df(df.withColumn("v", value).select(grid.df.columns))


def gradient(grid: Grid) -> DataFrame:
    """(…, gx, gy, gz): forward differences along each axis, 0 at the far end."""
    df = planes(grid.df, grid.dim)
    for a in axes(grid):
        w = grid.line(a)
        df = df.withColumn(f"g{a}", F.coalesce(F.lead("v").over(w) - F.col("v"), F.lit(0)))
    return df


def _shifted(grid: Grid, step: int, name: str) -> DataFrame:
    """(img, idx, name): the value step places on in storage order, looked up by idx, so no task holds an image."""
    return grid.df.select("img", (F.col("idx") - step).alias("idx"), F.col("v").alias(name))


def gradient_shift(grid: Grid, shift: int = 1) -> Grid:
    """v at idx + shift minus v, in storage order: rows run on into each other; 0 where there is no such voxel."""
    df = grid.df.join(_shifted(grid, shift, "on"), ["img", "idx"], "left")
    return grid.with_df(df.withColumn("v", F.coalesce(F.col("on") - F.col("v"), F.lit(0))).select(grid.df.columns))


def gradient_2(grid: Grid, axis: str) -> Grid:
    """v at idx + step minus v at idx - step for the axis' step, in storage order; 0 where either is missing."""
    w, h, _ = grid.shape
    step = {"x": 1, "y": w, "z": w * h}[axis]
    df = grid.df.join(_shifted(grid, step, "on"), ["img", "idx"], "left").join(_shifted(grid, -step, "back"), ["img", "idx"], "left")
    return grid.with_df(df.withColumn("v", F.coalesce(F.col("on") - F.col("back"), F.lit(0))).select(grid.df.columns))


def gradient_at(grid: Grid) -> DataFrame:
    """(…, gx, gy, gz): central differences, 0 at the border."""
    df = planes(grid.df, grid.dim)
    for a in axes(grid):
        w = grid.line(a)
        df = df.withColumn(f"g{a}", F.coalesce(F.lead("v").over(w) - F.lag("v").over(w), F.lit(0)))
    return df


def anisotropic_diffusion(grid: Grid, conductance: float = 1.0, iterations: int = 5, inverse: bool = False) -> Grid:
    """Perona-Malik diffusion; an axis' K is its mean squared gradient times conductance (and 2 ln 2 in the exponential form).

    Each round is written out: it is read for K and for the flow, and a plan of all rounds would double with each.
    """
    k0 = conductance * conductance * (1.0 if inverse else 1.3862943611198906)
    if not iterations or not conductance:
        return grid
    ax = [a for a, n in zip(AXES, grid.shape, strict=True) if n > 1]
    df = grid.df.withColumn("v", F.col("v").cast("double"))
    for k in range(iterations):
        df = planes(saved(df, "diffusion") if k else df, grid.dim)
        for a in ax:
            df = df.withColumn(f"d{a}", F.coalesce(F.col("v") - F.lag("v").over(grid.line(a)), F.lit(0.0)))
        k = df.groupBy("img").agg(*[(F.sum(F.col(f"d{a}") * F.col(f"d{a}")) * k0 / float(grid.size)).alias(f"k{a}") for a in ax])
        df = df.join(k, "img")
        total = F.lit(0.0)
        for a in ax:
            g, q = F.col(f"d{a}"), F.try_divide(F.col(f"d{a}") * F.col(f"d{a}"), F.col(f"k{a}"))
            flow = g / (1.0 + q) if inverse else g * F.pow(F.lit(2.0), -q)
            df = df.withColumn(f"f{a}", F.when(F.col(f"k{a}") > 0, flow).otherwise(F.lit(0.0)))
            total = total + F.coalesce(F.lead(f"f{a}").over(grid.line(a)), F.lit(0.0)) - F.col(f"f{a}")
        df = df.withColumn("u", total).withColumn("v", F.col("v") + F.col("u") / float(2**grid.dim)).select(*grid.df.columns)
    return grid.with_df(df)


def jacobian_determinant_dis(dis: DataFrame, grid: Grid) -> DataFrame:
    """Determinant of identity + central differences of a displacement (dx, dy, dz); 1 at the border. Returns (img, x, y, z, idx, v)."""
    df = dis
    ax = axes(grid)
    for a in ax:
        w = grid.line(a)
        df = df.withColumns({f"j{b}{a}": F.lead(f"d{b}").over(w) - F.lag(f"d{b}").over(w) + (1.0 if a == b else 0.0) for b in ax})
    j = {(b, a): F.col(f"j{b}{a}") for a in ax for b in ax}
    if len(ax) == 2:
        det = j["x", "x"] * j["y", "y"] - j["x", "y"] * j["y", "x"]
    else:
        minor = lambda p, q, r, s: j[p, r] * j[q, s] - j[p, s] * j[q, r]
        det = j["x", "x"] * minor("y", "z", "y", "z") - j["x", "y"] * minor("y", "z", "x", "z") + j["x", "z"] * minor("y", "z", "x", "y")
    return df.select("img", "x", "y", "z", "idx", F.coalesce(det, F.lit(1.0)).alias("v"))


def jacobian_determinant(mapping: DataFrame, grid: Grid) -> DataFrame:
    """Determinant of the halved central differences of a mapping (dx, dy, dz), on voxels that have both neighbours on every axis."""
    df, ax = mapping, axes(grid)
    for a in ax:
        w = grid.line(a)
        df = df.withColumns({f"j{b}{a}": (F.lead(f"d{b}").over(w) - F.lag(f"d{b}").over(w)) * 0.5 for b in ax})
    j = {(b, a): F.col(f"j{b}{a}") for a in ax for b in ax}
    if len(ax) == 2:
        det = j["x", "x"] * j["y", "y"] - j["x", "y"] * j["y", "x"]
    else:
        minor = lambda p, q, r, s: j[p, r] * j[q, s] - j[p, s] * j[q, r]
        det = j["x", "x"] * minor("y", "z", "y", "z") - j["x", "y"] * minor("y", "z", "x", "z") + j["x", "z"] * minor("y", "z", "x", "y")
    return df.select("img", "x", "y", "z", "idx", det.alias("v")).where("v is not null")


def shrink(grid: Grid, s: int) -> Grid:
    """Blocks of s voxels an axis: the sum of the positive ones over s^dim."""
    w, h, d = grid.shape
    n = (w // s, h // s, max(1, d // s) if grid.dim == 3 else 1)
    key = [F.floor(F.col(a) / s).cast("int").alias(a) for a in AXES[: grid.dim]] + ([F.lit(0).alias("z")] if grid.dim == 2 else [])
    df = grid.df.groupBy("img", *key).agg((F.sum(F.when(F.col("v") > 0, F.col("v")).otherwise(0)) / float(s**grid.dim)).alias("v"))
    return grid.with_df(reindex(df.where((F.col("x") < n[0]) & (F.col("y") < n[1]) & (F.col("z") < n[2])), n), n)


def pdf2cdf(grid: Grid) -> Grid:
    return grid.map(F.sum("v").over(grid.scan().rowsBetween(Window.unboundedPreceding, 0)))


def cdf2pdf(grid: Grid, corrected: bool = False) -> Grid:
    """Each value minus the previous result, an alternating sum; corrected: minus the previous value."""
    if corrected:
        return grid.map(F.col("v") - F.coalesce(F.lag("v").over(grid.scan()), F.lit(0)))
    sign = F.when(F.col("idx") % 2 == 0, 1).otherwise(-1)
    return grid.map(sign * F.sum(sign * F.col("v")).over(grid.scan().rowsBetween(Window.unboundedPreceding, 0)))


def rank(grid: Grid) -> Grid:
    """Place in ascending order from 0; ties by idx."""
    return grid.map(F.row_number().over(Window.partitionBy("img").orderBy("v", "idx")).cast("long") - 1)


def rank_avg_tie(grid: Grid) -> Grid:
    """Average place of equal values, from 0."""
    counts = grid.df.groupBy("img", "v").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("img").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("img", "v", (before + (F.col("n") - 1) / 2.0).alias("r"))
    return grid.with_df(grid.df.join(ranks, ["img", "v"]).drop("v").withColumnRenamed("r", "v"))


def window_values(grid: Grid, width: int = 1, axis: str = "x") -> DataFrame:
    """(…, window): the values within width along an axis, clipped at the ends."""
    return grid.df.withColumn("window", F.collect_list("v").over(grid.line(axis).rowsBetween(-width, width)))
