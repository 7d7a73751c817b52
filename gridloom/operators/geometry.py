"""Geometry as projections of coordinates: nothing here needs neighbours, and only padding needs a join."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..layout import AXES, Grid, empty_grid, fill, reindex


def _moved(grid: Grid, coords: dict[str, Column], shape: tuple[int, int, int]) -> Grid:
    return grid.with_df(reindex(grid.df.select("img", *[coords.get(a, F.col(a)).alias(a) for a in AXES], "v"), shape), shape)


def flip(grid: Grid, axis: str) -> Grid:
    n = grid.shape[AXES.index(axis)]
    return _moved(grid, {axis: n - 1 - F.col(axis)}, grid.shape)


def flip_xy(grid: Grid) -> Grid:
    """Each plane reversed."""
    w, h, _ = grid.shape
    return _moved(grid, {"x": w - 1 - F.col("x"), "y": h - 1 - F.col("y")}, grid.shape)


def swap(grid: Grid, a: str, b: str) -> Grid:
    """Axes exchanged, with their extents and voxel sizes."""
    i, j = AXES.index(a), AXES.index(b)
    shape, vs = list(grid.shape), list(grid.vs)
    shape[i], shape[j], vs[i], vs[j] = shape[j], shape[i], vs[j], vs[i]
    return replace(_moved(grid, {a: F.col(b), b: F.col(a)}, tuple(shape)), vs=tuple(vs))


def flip_code(grid: Grid, code: int) -> Grid:
    """0 to 2: flip x, y, z; 3: swap xy; 4: swap yz; 5: swap xz."""
    return flip(grid, AXES[code]) if code < 3 else swap(grid, *{3: "xy", 4: "yz", 5: "xz"}[code])


def compose_codes(grid: Grid, codes: list[int], reverse: bool = False) -> Grid:
    for c in reversed(codes) if reverse else codes:
        grid = flip_code(grid, c)
    return grid


def reorder(grid: Grid, order: tuple[int, int, int], flipped: tuple[bool, bool, bool] = (False, False, False)) -> Grid:
    """Axis k of the result is axis order[k] of the grid, reversed where flipped[k]."""
    shape = tuple(grid.shape[o] for o in order)
    coords = {AXES[k]: (grid.shape[o] - 1 - F.col(AXES[o]) if flipped[k] else F.col(AXES[o])) for k, o in enumerate(order)}
    return replace(_moved(grid, coords, shape), vs=tuple(grid.vs[o] for o in order))


def orientation(cosines: list[float]) -> tuple[tuple[int, ...], tuple[bool, ...]]:
    """(order, flipped) for three rows of direction cosines: each row's largest component."""
    rows = [cosines[3 * k : 3 * k + 3] for k in range(3)]
    order = tuple(max(range(3), key=lambda i, r=r: abs(r[i])) for r in rows)
    return order, tuple(rows[k][order[k]] < 0 for k in range(3))


def inverse_orientation(order: tuple[int, ...], flipped: tuple[bool, ...]) -> tuple[tuple[int, ...], tuple[bool, ...]]:
    inv = tuple(order.index(k) for k in range(3))
    return inv, tuple(flipped[i] for i in inv)


def crop(grid: Grid, low: tuple[int, int, int], high: tuple[int, int, int]) -> Grid:
    """The half-open box with its origin at 0; what lies outside the image is 0."""
    shape = tuple(b - a for a, b in zip(low, high, strict=True))
    inside = F.lit(True)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        inside = inside & (F.col(a) >= lo) & (F.col(a) < hi)
    part = _moved(grid.with_df(grid.df.where(inside)), {a: F.col(a) - lo for a, lo in zip(AXES, low, strict=True)}, shape)
    outside = any(lo < 0 or hi > n for lo, hi, n in zip(low, high, grid.shape, strict=True))
    return fill(part, shape) if outside else part


def trim(grid: Grid, background=0) -> DataFrame:
    """Every image cut to the box of what differs from the background; each has a shape of its own, so rows come back as (img, x, y, z, w, h, d, v)."""
    box = grid.df.where(F.col("v") != background).groupBy("img").agg(*[e for a in AXES for e in (F.min(a).alias(f"{a}0"), F.max(a).alias(f"{a}1"))])
    df = grid.df.join(box, "img")
    for a in AXES:
        df = df.where((F.col(a) >= F.col(f"{a}0")) & (F.col(a) <= F.col(f"{a}1")))
    return df.select("img", *[(F.col(a) - F.col(f"{a}0")).alias(a) for a in AXES], *[(F.col(f"{a}1") - F.col(f"{a}0") + 1).alias(n) for a, n in zip(AXES, "whd", strict=True)], "v")


def move(grid: Grid, shift: tuple[int, int, int]) -> Grid:
    """Content shifted, zeros behind it."""
    return crop(grid, tuple(-s for s in shift), tuple(n - s for n, s in zip(grid.shape, shift, strict=True)))


def reshape(grid: Grid, shape: tuple[int, int, int]) -> Grid:
    """Cut or padded with zeros at the far ends."""
    return crop(grid, (0, 0, 0), shape)


def resize_at_center(grid: Grid, shape: tuple[int, int, int]) -> Grid:
    low = tuple((n - m) // 2 if n >= m else -((m - n) // 2) for n, m in zip(grid.shape, shape, strict=True))
    return crop(grid, low, tuple(a + m for a, m in zip(low, shape, strict=True)))


def fill_rect(grid: Grid, low: tuple[int, int, int], high: tuple[int, int, int], value) -> Grid:
    inside = F.lit(True)
    for a, lo, hi in zip(AXES, low, high, strict=True):
        inside = inside & F.col(a).between(lo, hi - 1)
    return grid.map(F.when(inside, F.lit(value)).otherwise(F.col("v")))


def line_points(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Pixels of a straight line with a step of one along its longer side."""
    n = max(abs(x1 - x0), abs(y1 - y0))
    return [(x0, y0)] if not n else [(x0 + (2 * k * (x1 - x0) + n) // (2 * n), y0 + (2 * k * (y1 - y0) + n) // (2 * n)) for k in range(n + 1)]


def draw_line(grid: Grid, x0: int, y0: int, x1: int, y1: int, value) -> Grid:
    n = max(abs(x1 - x0), abs(y1 - y0))
    along, a, b, p, q = ("x", x0, x1, y0, y1) if abs(x1 - x0) >= abs(y1 - y0) else ("y", y0, y1, x0, x1)
    other = "y" if along == "x" else "x"
    if not n:
        on = (F.col("x") == x0) & (F.col("y") == y0)
    else:
        k = (F.col(along) - a) * (1 if b > a else -1)
        on = k.between(0, n) & (F.col(other) == p + F.floor((2 * k * (q - p) + n) / (2 * n)))
    return grid.map(F.when(on, F.lit(value)).otherwise(F.col("v")))


def draw(source: Grid, target: Grid, shift: tuple[int, int, int], add: bool = False, where: Column | None = None) -> Grid:
    """source pasted into (or added to) target at an offset, clipped; where says which source voxels (column v) count."""
    src = source.df if where is None else source.df.where(where)
    src = src.select("img", *[(F.col(a) + s).alias(a) for a, s in zip(AXES, shift, strict=True)], F.col("v").alias("s"))
    df = target.df.join(src, ["img", *AXES], "left")
    v = F.col("v") + F.coalesce("s", F.lit(0)) if add else F.coalesce("s", "v")
    return target.with_df(df.withColumn("v", v).select(target.df.columns))


def mosaic(grid: Grid, columns: int, skip: int = 1) -> Grid:
    """Every skip-th z slice side by side in rows of so many columns."""
    w, h, d = grid.shape
    n = -(-d // skip)
    shape = (w * columns, h * -(-n // columns), 1)
    k = F.floor(F.col("z") / skip)
    tiles = _moved(grid.with_df(grid.df.where(F.col("z") % skip == 0)), {"x": F.col("x") + (k % columns) * w, "y": F.col("y") + F.floor(k / columns) * h, "z": F.lit(0)}, shape)
    return fill(tiles, shape)


def slice_of(grid: Grid, axis: str, at: int) -> Grid:
    """The 2D slice across an axis: (y, z) for x, (x, z) for y, (x, y) for z."""
    a, b = {"x": ("y", "z"), "y": ("x", "z"), "z": ("x", "y")}[axis]
    shape = (grid.shape[AXES.index(a)], grid.shape[AXES.index(b)], 1)
    return _moved(grid.with_df(grid.df.where(F.col(axis) == at)), {"x": F.col(a), "y": F.col(b), "z": F.lit(0)}, shape)


def slice_scaled(grid: Grid, axis: str, at: int, ratio: float) -> Grid:
    """slice_of() stretched by a ratio, nearest voxels."""
    from .resample import resample

    g = slice_of(grid, axis, at)
    shape = (round(g.shape[0] * ratio), round(g.shape[1] * ratio), 1)
    return resample(g, shape, lambda x, y, z: (F.least(x / ratio, F.lit(g.shape[0] - 1.0)), F.least(y / ratio, F.lit(g.shape[1] - 1.0)), z), "nearest")


def space_to_slice(axis: str, point: tuple[int, int, int]) -> tuple[int, int, int]:
    """(column, row, slice) of a voxel in the slices across an axis; slice_to_space is the way back."""
    x, y, z = point
    return {"x": (y, z, x), "y": (x, z, y), "z": (x, y, z)}[axis]


def slice_to_space(axis: str, point: tuple[int, int, int]) -> tuple[int, int, int]:
    a, b, s = point
    return {"x": (s, a, b), "y": (a, s, b), "z": (a, b, s)}[axis]


def concatenate(a: Grid, b: Grid) -> Grid:
    """b appended to a along z; both need the same plane."""
    if a.shape[:2] != b.shape[:2]:
        raise ValueError("planes differ")
    shape = (*a.shape[:2], a.shape[2] + b.shape[2])
    both = a.df.select("img", *AXES, "v").unionByName(b.df.select("img", "x", "y", (F.col("z") + a.shape[2]).alias("z"), "v"))
    return a.with_df(reindex(both, shape), shape)


def volume_to_points(grid: Grid) -> DataFrame:
    return grid.df.where("v <> 0").select("img", *AXES)


def points_to_volume(points: DataFrame, like: Grid) -> Grid:
    """1 where there is a point; points outside are dropped."""
    on = points.select("img", *AXES, F.lit(1).alias("p")).distinct()
    df = like.df.join(on, ["img", *AXES], "left")
    return like.with_df(df.withColumn("v", F.coalesce("p", F.lit(0))).select(like.df.columns))


def sparse_index(mask: Grid) -> DataFrame:
    """(img, idx, si): the voxels that are set, numbered densely from 0 in each image."""
    from pyspark.sql import Window

    return mask.df.where("v <> 0").select("img", "idx", (F.row_number().over(Window.partitionBy("img").orderBy("idx")) - 1).cast("long").alias("si"))


def expand_labels(grid: Grid, n: int) -> Grid:
    """One block of planes a label 1..n, with 1 where the voxel has it."""
    w, h, d = grid.shape
    shape = (w, h, d * n)
    df = grid.df.select("img", "x", "y", F.explode(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.alias("k"), (F.col("v") == k).cast("long").alias("on")))).alias("s"), "z")
    return grid.with_df(reindex(df.select("img", "x", "y", (F.col("z") + (F.col("s.k") - 1) * d).alias("z"), F.col("s.on").alias("v")), shape), shape)


def remove_channel(grid: Grid, channel: int, depth: int) -> Grid:
    """Drop one block of depth planes."""
    w, h, d = grid.shape
    z = F.col("z")
    df = grid.df.where((z < channel * depth) | (z >= (channel + 1) * depth)).withColumn("z", F.when(z >= (channel + 1) * depth, z - depth).otherwise(z))
    return grid.with_df(reindex(df, (w, h, d - depth)), (w, h, d - depth))


def blank(like: Grid, value=0) -> Grid:
    return like.with_df(empty_grid(like.df.sparkSession, like.df, like.shape).withColumn("v", F.lit(value)))
