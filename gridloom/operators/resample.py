"""Resampling: each target voxel looks its source voxels up by an equi-join on their coordinates.

The target grid is made by the executors, a tap a row (1 for nearest, up to 8 for linear and majority, 64 for cubic), and
the weighted taps are added up by target voxel; near-identity transforms become coordinate shifts without taps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..layout import AXES, Grid, empty_grid, fill, reindex
from .geometry import crop

Position = tuple[Column, Column, Column]


def _targets(grid: Grid, shape: tuple[int, int, int], where: Callable[[Column, Column, Column], Position]) -> DataFrame:
    at = empty_grid(grid.df.sparkSession, grid.df, shape)
    p = where(*[F.col(a).cast("double") for a in AXES])
    return at.withColumns({f"p{a}": c for a, c in zip(AXES, p, strict=True)})


def _rounded(c: str) -> Column:
    return (F.signum(c) * F.floor(F.abs(c) + 0.5)).cast("int")


def _corners(t: DataFrame, grid: Grid, taps: range, weight: Callable[[Column, int], Column], clamp: bool) -> DataFrame:
    """A row for each target and tap: the tap's coordinates, weight w and number k. Axes are exploded one after the other."""
    df = t.select("img", *[F.col(a).alias(f"t{a}") for a in AXES], *[f"p{a}" for a in AXES])
    for i, (a, n) in enumerate(zip(AXES, grid.shape, strict=True)):
        low, f = F.floor(f"p{a}").cast("int"), F.col(f"p{a}") - F.floor(f"p{a}")
        edge = (lambda c, n=n: F.least(F.greatest(c, F.lit(0)), F.lit(n - 1))) if clamp else (lambda c: c)
        one = n == 1
        cells = [F.struct(edge(low + k).alias("at"), (F.lit(1.0) if one else weight(f, k)).alias("w"), F.lit(j * len(taps) ** i).alias("k")) for j, k in enumerate(range(1) if one else taps)]
        df = df.withColumn(f"c{a}", F.explode(F.array(*cells)))
    w, k = (F.col("cx." + c) for c in "wk")
    for a in AXES[1:]:
        w, k = w * F.col(f"c{a}.w"), k + F.col(f"c{a}.k")
    return df.select("img", "tx", "ty", "tz", *[F.col(f"c{a}.at").alias(a) for a in AXES], w.alias("w"), k.alias("k")).where("w <> 0")


def _inside(t: DataFrame, grid: Grid, last: int) -> DataFrame:
    """Targets whose position has a full cell: floor(p) >= 0 and floor(p) + last < extent."""
    for a, n in zip(AXES, grid.shape, strict=True):
        t = t.where((F.floor(f"p{a}") >= 0) & (F.floor(f"p{a}") + (last if n > 1 else 0) < n))
    return t


def _cubic(f: Column, k: int) -> Column:
    return {-1: ((2 - f) * f - 1) * f, 0: (3 * f - 5) * f * f + 2, 1: ((4 - 3 * f) * f + 1) * f, 2: (f - 1) * f * f}[k] * 0.5


def resample(grid: Grid, shape: tuple[int, int, int], where: Callable[[Column, Column, Column], Position], interpolation: str = "linear") -> Grid:
    """The value at where(x, y, z) for each voxel of a new shape, 0 outside.

    nearest: half away from zero. linear: needs a full cell of neighbours. majority: the value with most linear weight, the first
    of equals in the order of the corners. cubic: Catmull-Rom with the edge repeated.
    """
    t = _targets(grid, shape, where)
    values = grid.df.select("img", *AXES, "v")
    if interpolation == "nearest":
        t = t.select("img", *[F.col(a).alias(f"t{a}") for a in AXES], *[_rounded(f"p{a}").alias(a) for a in AXES])
        out = t.join(values, ["img", *AXES]).select("img", *[F.col(f"t{a}").alias(a) for a in AXES], "v")
    else:
        if interpolation == "cubic":
            for a, n in zip(AXES, grid.shape, strict=True):
                t = t.where((F.col(f"p{a}") >= 0) & (F.col(f"p{a}") <= n))
            taps = _corners(t, grid, range(-1, 3), _cubic, True)
        else:
            taps = _corners(_inside(t, grid, 1), grid, range(2), lambda f, k: f if k else 1.0 - f, False)
        found = taps.join(values, ["img", *AXES])
        key = ["img", "tx", "ty", "tz"]
        if interpolation == "majority":
            each = found.groupBy(*key, "v").agg(F.sum("w").alias("w"), F.min("k").alias("k"))
            out = each.groupBy(*key).agg(F.max_by("v", F.struct(F.round("w", 9), -F.col("k"))).alias("v"))
        else:
            out = found.groupBy(*key).agg(F.sum(F.col("w") * F.col("v")).alias("v"))
        out = out.select("img", *[F.col(f"t{a}").alias(a) for a in AXES], "v")
    return fill(grid.with_df(out), shape)


def affine_position(m: list[float]) -> Callable[[Column, Column, Column], Position]:
    """Position by a row-major 3x4 matrix."""
    return lambda x, y, z: tuple(m[4 * i] * x + m[4 * i + 1] * y + m[4 * i + 2] * z + m[4 * i + 3] for i in range(3))


def resample_affine(grid: Grid, shape: tuple[int, int, int], m: list[float], interpolation: str = "linear") -> Grid:
    """resample() by a matrix; the identity with an integer shift is a crop."""
    eye = (1, 0, 0, 0, 1, 0, 0, 0, 1)
    shift = [m[4 * i + 3] for i in range(3)]
    near = all(abs(m[4 * i + j] - eye[3 * i + j]) < 1e-4 for i in range(3) for j in range(3)) and all(abs(s - round(s)) < 1e-4 for s in shift)
    if near:
        low = tuple(round(s) for s in shift)
        return crop(grid, low, tuple(a + n for a, n in zip(low, shape, strict=True)))
    return resample(grid, shape, affine_position(m), interpolation)


def scale(grid: Grid, shape: tuple[int, int, int], interpolation: str = "linear") -> Grid:
    """Stretched so that the first and last voxels meet."""
    step = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(grid.shape, shape, strict=True)]
    return resample(grid, shape, lambda x, y, z: (x * step[0], y * step[1], z * step[2]), interpolation)


def fast_resample(grid: Grid, shape: tuple[int, int, int]) -> Grid:
    """The voxel at trunc(0.5 + i * (n - 1) / (m - 1))."""
    step = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(grid.shape, shape, strict=True)]
    t = empty_grid(grid.df.sparkSession, grid.df, shape)
    t = t.select("img", *[F.col(a).alias(f"t{a}") for a in AXES], *[F.floor(0.5 + F.col(a) * s).cast("int").alias(a) for a, s in zip(AXES, step, strict=True)])
    out = t.join(grid.df.select("img", *AXES, "v"), ["img", *AXES])
    return grid.with_df(reindex(out.select("img", *[F.col(f"t{a}").alias(a) for a in AXES], "v"), shape), shape)


def translocate(grid: Grid, shift: tuple[float, float, float], interpolation: str = "linear") -> Grid:
    m = [1, 0, 0, -shift[0], 0, 1, 0, -shift[1], 0, 0, 1, -shift[2]]
    return resample_affine(grid, grid.shape, m, interpolation)


def regrid(grid: Grid, vs: tuple[float, float, float], interpolation: str = "linear") -> Grid:
    """Resampled to a voxel size; extents rounded up."""
    ratio = [new / old for new, old in zip(vs, grid.vs, strict=True)]
    shape = tuple(-int(-n * old // new) for n, old, new in zip(grid.shape, grid.vs, vs, strict=True))
    out = resample(grid, shape, lambda x, y, z: (x * ratio[0], y * ratio[1], z * ratio[2]), interpolation)
    a = list(grid.affine)
    for r in range(3):
        for c in range(3):
            a[4 * r + c] *= ratio[c]
    return replace(out, vs=vs, affine=tuple(a))


def upsample(grid: Grid, nearest: bool = False) -> Grid:
    """Twice as many voxels along each axis: even ones are samples, odd ones the mean with the next, the last repeated."""
    for a in AXES[: grid.dim]:
        n = list(grid.shape)
        n[AXES.index(a)] *= 2
        v = F.col("v")
        odd = v if nearest else (v + F.coalesce(F.lead("v").over(grid.line(a)), v)) / 2.0
        even = v if nearest else v.cast("double")
        df = grid.df.withColumn("s", F.array(even, odd)).select("img", *[c for c in AXES if c != a], F.col(a).alias("o"), F.posexplode("s").alias("k", "v")).withColumn(a, F.col("o") * 2 + F.col("k"))
        grid = grid.with_df(reindex(df, tuple(n)), tuple(n))
    return replace(grid, vs=tuple(s / 2 if i < grid.dim else s for i, s in enumerate(grid.vs)))


def downsample(grid: Grid) -> Grid:
    """Means of pairs along each axis, an odd tail dropped."""
    d = grid.dim
    shape = tuple(n // 2 if i < d else n for i, n in enumerate(grid.shape))
    half = {a: F.floor(F.col(a) / 2).cast("int") if i < d else F.col(a) for i, a in enumerate(AXES)}
    df = grid.df.groupBy("img", *[half[a].alias(a) for a in AXES]).agg((F.sum("v") / float(2**d)).alias("v"))
    for a, n in zip(AXES, shape, strict=True):
        df = df.where(F.col(a) < n)
    return grid.with_df(reindex(df, shape), shape)


def _cells(grid: Grid) -> tuple[DataFrame, tuple[int, int, int]]:
    """Rows of each voxel once for every place it takes in the 2^dim cells, the border repeated: (img, x, y, z, k, v)."""
    d = grid.dim
    shape = tuple((n + 1) // 2 if i < d else n for i, n in enumerate(grid.shape))
    df = grid.df.select("img", *AXES, "v")
    k = F.lit(0)
    for i, (a, n) in enumerate(list(zip(AXES, grid.shape, strict=True))[:d]):
        twice = (F.col(a) == n - 1) & (F.col(a) % 2 == 0)
        df = df.withColumn(f"b{a}", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array((F.col(a) % 2).cast("int")))))
        k = k + F.col(f"b{a}") * 2**i
    return df.select("img", *[F.floor(F.col(a) / 2).cast("int").alias(a) if i < d else F.col(a) for i, a in enumerate(AXES)], k.alias("k"), "v"), shape


def downsample_with_padding(grid: Grid) -> Grid:
    """Mean of each cell, the border repeated; integers are shifted right, so rounded down."""
    cells, shape = _cells(grid)
    integral = grid.df.schema["v"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    total = F.sum("v")
    df = cells.groupBy("img", *AXES).agg((F.call_function("shiftright", total, F.lit(grid.dim)) if integral else total / float(2**grid.dim)).alias("v"))
    return replace(grid.with_df(reindex(df, shape), shape), vs=tuple(s * 2 if i < grid.dim else s for i, s in enumerate(grid.vs)))


def downsample_label(grid: Grid) -> Grid:
    """Most frequent value of each cell, the first of equals."""
    cells, shape = _cells(grid)
    each = cells.groupBy("img", *AXES, "v").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    df = each.groupBy("img", *AXES).agg(F.max_by("v", F.struct("n", -F.col("k"))).alias("v"))
    return replace(grid.with_df(reindex(df, shape), shape), vs=tuple(s * 2 if i < grid.dim else s for i, s in enumerate(grid.vs)))


def compose_displacement(grid: Grid, dis: DataFrame, interpolation: str = "linear") -> Grid:
    """The grid sampled at each voxel plus its displacement (img, x, y, z, dx, dy, dz); 0 outside."""
    t = empty_grid(grid.df.sparkSession, grid.df, grid.shape).join(dis.select("img", *AXES, "dx", "dy", "dz"), ["img", *AXES])
    t = t.withColumns({f"p{a}": F.col(a) + F.col(f"d{a}").cast("double") for a in AXES})
    values = grid.df.select("img", *AXES, "v")
    if interpolation == "nearest":
        t = t.select("img", *[F.col(a).alias(f"t{a}") for a in AXES], *[_rounded(f"p{a}").alias(a) for a in AXES])
        out = t.join(values, ["img", *AXES])
    else:
        taps = _corners(_inside(t, grid, 1), grid, range(2), lambda f, k: f if k else 1.0 - f, False)
        out = taps.join(values, ["img", *AXES]).groupBy("img", "tx", "ty", "tz").agg(F.sum(F.col("w") * F.col("v")).alias("v"))
    return fill(grid.with_df(out.select("img", *[F.col(f"t{a}").alias(a) for a in AXES], "v")), grid.shape)


def displacement_to_mapping(dis: DataFrame) -> DataFrame:
    return dis.withColumns({f"d{a}": F.col(f"d{a}") + F.col(a) for a in AXES})


def mapping_to_displacement(mapping: DataFrame) -> DataFrame:
    return mapping.withColumns({f"d{a}": F.col(f"d{a}") - F.col(a) for a in AXES})


def accumulate_displacement(first: DataFrame, second: DataFrame, grid: Grid) -> DataFrame:
    """second(x) + first(x + second(x)), first interpolated linearly and 0 outside."""
    t = second.select("img", *AXES, *[F.col(f"d{a}").alias(f"s{a}") for a in AXES]).withColumns({f"p{a}": F.col(a) + F.col(f"s{a}").cast("double") for a in AXES})
    taps = _corners(_inside(t, grid, 1), grid, range(2), lambda f, k: f if k else 1.0 - f, False)
    hit = taps.join(first.select("img", *AXES, "dx", "dy", "dz"), ["img", *AXES]).groupBy("img", "tx", "ty", "tz").agg(*[F.sum(F.col("w") * F.col(f"d{a}")).alias(f"h{a}") for a in AXES])
    hit = hit.select("img", *[F.col(f"t{a}").alias(a) for a in AXES], "hx", "hy", "hz")
    return t.join(hit, ["img", *AXES], "left").select("img", *AXES, *[(F.col(f"s{a}") + F.coalesce(f"h{a}", F.lit(0.0))).alias(f"d{a}") for a in AXES])


def invert_displacement(dis: DataFrame, grid: Grid, iterations: int = 8) -> DataFrame:
    """Fixed point u(x) = -d(x + u(x))."""
    u = dis.select("img", *AXES, *[(-F.col(f"d{a}")).cast("double").alias(f"d{a}") for a in AXES])
    for _ in range(iterations):
        back = accumulate_displacement(dis, u, grid).select("img", *AXES, *[F.col(f"d{a}").alias(f"t{a}") for a in AXES])
        u = u.join(back, ["img", *AXES]).select("img", *AXES, *[(F.col(f"d{a}") - F.col(f"t{a}")).alias(f"d{a}") for a in AXES])
    return u


def upsample_axis(grid: Grid, axis: str, nearest: bool = True) -> Grid:
    """Twice as many voxels along one axis: each repeated, or the mean with the next between them."""
    n = list(grid.shape)
    n[AXES.index(axis)] *= 2
    v = F.col("v")
    odd = v if nearest else (v + F.coalesce(F.lead("v").over(grid.line(axis)), v)) / 2.0
    pair = F.array(v if nearest else v.cast("double"), odd)
    df = grid.df.withColumn("s", pair).select("img", *[c for c in AXES if c != axis], F.col(axis).alias("o"), F.posexplode("s").alias("k", "v")).withColumn(axis, F.col("o") * 2 + F.col("k"))
    return grid.with_df(reindex(df, tuple(n)), tuple(n))


def upsample_label(grid: Grid) -> Grid:
    """Each voxel repeated 2^dim times, in one projection: labels stay labels."""
    d = grid.dim
    shape = tuple(n * 2 if i < d else n for i, n in enumerate(grid.shape))
    at = F.explode(F.sequence(F.lit(0), F.lit(2**d - 1)))
    df = grid.df.select("img", *AXES, "v", at.alias("k"))
    df = df.select("img", *[(F.col(a) * 2 + F.shiftright("k", i).bitwiseAND(F.lit(1))).alias(a) if i < d else F.col(a) for i, a in enumerate(AXES)], "v")
    return replace(grid.with_df(reindex(df, shape), shape), vs=tuple(s / 2 if i < d else s for i, s in enumerate(grid.vs)))


def upsample_with_padding(grid: Grid, shape: tuple[int, int, int], interpolation: str = "linear") -> Grid:
    """A shape filled by sampling at half the place's coordinates; what lies beyond the last voxel is 0."""
    half = 0.5 if grid.dim == 3 else 1.0
    return resample(grid, shape, lambda x, y, z: (x * 0.5, y * 0.5, z * half), interpolation)


def decompose_displacement(whole: DataFrame, first: DataFrame, grid: Grid, rounds: int = 15) -> DataFrame:
    """The displacement u for which u(x) + first(x + u(x)) is whole(x), by fixed-point rounds; each is written out."""
    from .graph import saved

    names = {f"d{a}": f"w{a}" for a in AXES}
    base = saved(whole.select("img", *AXES, *[F.col(k).cast("double").alias(v) for k, v in names.items()]), "decompose")
    u = base.join(first, ["img", *AXES]).select("img", *AXES, *[(F.col(f"w{a}") - F.col(f"d{a}")).alias(f"d{a}") for a in AXES])
    for _ in range(rounds):
        moved = accumulate_displacement(first, u, grid).select("img", *AXES, *[F.col(f"d{a}").alias(f"t{a}") for a in AXES])
        # accumulated = u + first(x + u); what first gives there is that less u
        u = saved(u.join(moved, ["img", *AXES]).join(base, ["img", *AXES]).select("img", *AXES, *[(F.col(f"w{a}") - F.col(f"t{a}") + F.col(f"d{a}")).alias(f"d{a}") for a in AXES]), "decompose")
    return u


def is_label_image(grid: Grid) -> bool:
    """Whether every value is a whole number of 0 or more: one aggregate, one row to the driver."""
    if grid.df.schema["v"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        return bool(grid.df.agg(F.min("v") >= 0).first()[0])
    return bool(grid.df.agg(F.bool_and((F.col("v") >= 0) & (F.col("v") == F.floor("v")))).first()[0])


def to_space(grid: Grid, shape: tuple[int, int, int], affine: tuple[float, ...], interpolation: str | None = None) -> Grid:
    """The grid on another shape and affine: as it is where both agree, labels by majority, other values linearly."""
    import numpy as np

    m = np.linalg.inv(np.array(grid.affine, float).reshape(4, 4)) @ np.array(affine, float).reshape(4, 4)
    vs = tuple(float(x) for x in np.linalg.norm(np.array(affine, float).reshape(4, 4)[:3, :3], axis=0))
    if tuple(shape) == tuple(grid.shape) and np.abs(m - np.eye(4)).max() <= 1e-3:
        return replace(grid, affine=tuple(affine), vs=vs)
    kind = interpolation or ("majority" if is_label_image(grid) else "linear")
    return replace(resample_affine(grid, tuple(shape), m[:3].ravel().tolist(), kind), affine=tuple(affine), vs=vs)
