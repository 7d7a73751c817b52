"""Displacement fields between images, as relational stencils: forces, Poisson sweeps, smoothing and the search itself.

A field is a table (img, x, y, z, idx, dx, dy, dz). Forces need a window of both images around each voxel: sums over it are
separable, so they are windows along one axis after the other, and no task holds an image. Sweeps over neighbours run in
slabs: contiguous planes (lines of a 2D image) with as many further planes on both sides as there are sweeps, so a dozen
sweeps cost one exchange. Sampling at displaced places is a lookup join.

All images of a table are searched in lockstep, each with its own costs, smoothing and end; a few numbers an image come to
the driver in each round. The table of each round is written out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..layout import AXES, Grid, empty_grid
from .graph import saved
from .resample import _corners, _inside, compose_displacement, downsample_with_padding
from .stencil import axes, planes

D = ("dx", "dy", "dz")
#: Voxels of a slab without its halo, at least; neighbours within it stay in one task.
SLAB = 1 << 20
SWEEPS = 12
#: Voxels to each side of a regression window.
WIDTH = 2


def window_sums(df: DataFrame, grid: Grid, columns: dict[str, Column], width: int) -> DataFrame:
    """df with, for each name, the sum of a column over the voxels within width along every axis, clipped at the borders."""
    df = planes(df.withColumns(columns), grid.dim)
    for a in axes(grid):
        w = grid.line(a).rowsBetween(-width, width)
        df = df.withColumns({c: F.sum(c).over(w) for c in columns})
    return df


def central(df: DataFrame, grid: Grid, value: str) -> DataFrame:
    """df with gx, gy, gz: the value after minus the value before along each axis, 0 where either is missing."""
    for a in axes(grid):
        w = grid.line(a)
        df = df.withColumn(f"g{a}", F.coalesce(F.lead(value).over(w) - F.lag(value).over(w), F.lit(0.0)))
    return df if grid.dim == 3 else df.withColumn("gz", F.lit(0.0))


def force(moved: Grid, fixed: Grid, kind: str = "r") -> DataFrame:
    """(img, x, y, z, idx, dx, dy, dz, cost) of the moved image J and the fixed image I of one shape.

    kind r: I is regressed on J over the window within 2 voxels, I ~ a J + b. Where a > 0 and neither image is 0 at the voxel,
    the force is J's gradient times r2 (a J + b - I) and the cost is -r2; elsewhere both are 0.
    kind d: the gradient times J - I, and the cost (J - I)^2.
    """
    if kind not in ("r", "d"):
        raise ValueError(f"a force is of kind r or d, not {kind}")
    number = lambda g, name: g.df.select("img", "idx", F.col("v").cast("double").alias(name))
    df = moved.df.select("img", *AXES, "idx", F.col("v").cast("double").alias("j")).join(number(fixed, "i"), ["img", "idx"])
    j, i = F.col("j"), F.col("i")
    if kind == "d":
        weight, cost = j - i, (j - i) * (j - i)
        df = planes(df, fixed.dim)
    else:
        df = window_sums(df, fixed, {"n": F.lit(1.0), "sj": j, "si": i, "sjj": j * j, "sij": i * j, "sii": i * i}, WIDTH)
        n = F.col("n")
        cov, var_j, var_i = n * F.col("sij") - F.col("si") * F.col("sj"), n * F.col("sjj") - F.col("sj") * F.col("sj"), n * F.col("sii") - F.col("si") * F.col("si")
        # variances of equal values, up to rounding
        flat = (var_j <= 1e-12 * n * F.col("sjj")) | (var_i <= 1e-12 * n * F.col("sii"))
        df = df.withColumns({"cov": cov, "vj": var_j, "vi": var_i, "flat": flat})
        a = F.col("cov") / F.col("vj")
        r2 = F.col("cov") * F.col("cov") / F.col("vj") / F.col("vi")
        counts = ~F.col("flat") & (F.col("cov") > 0) & (j != 0) & (i != 0)
        weight = F.when(counts, r2 * (j * a + (F.col("si") - a * F.col("sj")) / n - i)).otherwise(F.lit(0.0))
        cost = F.when(counts, -r2).otherwise(F.lit(0.0))
    df = central(df.withColumns({"weight": weight, "cost": cost}), fixed, "j")
    return df.select("img", *AXES, "idx", *[(F.col(f"g{a}") * F.col("weight")).alias(f"d{a}") for a in AXES], "cost")


def forces(moved: list[Grid], fixed: list[Grid], kinds: str = "") -> DataFrame:
    """The sum of the forces of several image kinds, and of their costs over the number of kinds; kinds names each (r where it doesn't)."""
    each = [force(m, f, kinds[k] if k < len(kinds) else "r") for k, (m, f) in enumerate(zip(moved, fixed, strict=True))]
    if len(each) == 1:
        return each[0]
    total = [F.sum(d).alias(d) for d in D] + [(F.sum("cost") / float(len(each))).alias("cost")]
    return reduce(DataFrame.unionByName, each).groupBy("img", *AXES, "idx").agg(*total)


def steps(grid: Grid) -> tuple[int, ...]:
    """Distances of a voxel's face neighbours in storage order. They run on from a line's end into the next line."""
    w, h, _ = grid.shape
    return (1, w, w * h)[: grid.dim]


def in_slabs(df: DataFrame, grid: Grid, columns: tuple[str, ...], fun, halo: int, slab: int = SLAB) -> DataFrame:
    """(img, x, y, z, idx, *columns): fun on runs of values in storage order, [voxels, columns] to the same shape.

    What fun makes of a voxel may depend on values up to halo planes away (lines, in 2D).
    """
    w, h, d = grid.shape
    plane, n = (w * h, d) if grid.dim == 3 else (w, h)
    thick = max(2 * halo, -(-slab // plane))
    last = (n - 1) // thick
    at = F.floor(F.col("idx") / plane)
    first, end = F.floor((at - halo) / thick), F.floor((at + halo) / thick)
    dealt = df.select("img", "idx", *columns, F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(end, F.lit(last)))).alias("slab"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        idx, k = table.column("idx").to_numpy(), table.column("slab")[0].as_py()
        out = fun(np.column_stack([table.column(c).to_numpy() for c in columns]))
        own = (idx >= k * thick * plane) & (idx < (k + 1) * thick * plane)
        cols = [pa.array(out[own, c]) for c in range(len(columns))]
        return pa.Table.from_arrays([table.column("img").filter(pa.array(own)), pa.array(idx[own]), *cols], ["img", "idx", *columns])

    kind = df.schema["img"].dataType.simpleString()
    out = dealt.groupBy("img", "slab").applyInArrow(run, f"img {kind}, idx long, " + ", ".join(f"{c} double" for c in columns))
    place = [(F.col("idx") % w).cast("int").alias("x"), (F.floor(F.col("idx") / w) % h).cast("int").alias("y"), F.floor(F.col("idx") / (w * h)).cast("int").alias("z")]
    return out.select("img", *place, "idx", *columns)


def neighbour_sum(v: np.ndarray, distances: tuple[int, ...]) -> np.ndarray:
    total = np.zeros_like(v)
    for s in distances:
        total[s:] += v[:-s]
        total[:-s] += v[s:]
    return total


def poisson(forces_: DataFrame, grid: Grid, sweeps: int = SWEEPS, slab: int = SLAB) -> DataFrame:
    """Jacobi sweeps of Poisson's equation: a field whose Laplacian is the force. It starts at -force / (2 dim)."""
    near, share = steps(grid), -0.5 / grid.dim

    def run(f):
        u = f * share
        for _ in range(sweeps):
            u = (f - neighbour_sum(u, near)) * share
        return u

    return in_slabs(forces_, grid, D, run, sweeps, slab)


def smooth(dis: DataFrame, grid: Grid, smoothing: float, slab: int = SLAB) -> DataFrame:
    """A field times 1 - smoothing, plus smoothing times the sum of its face neighbours over 2 dim."""
    near, part = steps(grid), smoothing / (2.0 * grid.dim)
    return in_slabs(dis, grid, D, lambda v: v * (1.0 - smoothing) + neighbour_sum(v, near) * part, 1, slab)


def largest(dis: DataFrame) -> DataFrame:
    """(img, length): the length of each image's longest vector."""
    return dis.groupBy("img").agg(F.max(F.sqrt(reduce(lambda p, q: p + q, [F.col(c) * F.col(c) for c in D]))).alias("length"))


def follow(new: DataFrame, now: DataFrame, grid: Grid) -> DataFrame:
    """First new, then now: new(x) + now(x + new(x)), now sampled linearly; now(x) where that place has no full cell."""
    t = new.select("img", *AXES, "idx", *[F.col(d).alias(f"s{a}") for a, d in zip(AXES, D, strict=True)])
    t = t.withColumns({f"p{a}": F.col(a) + F.col(f"s{a}") for a in AXES})
    taps = _corners(_inside(t, grid, 1), grid, range(2), lambda f, k: f if k else 1.0 - f, False)
    hit = taps.join(now.select("img", *AXES, *D), ["img", *AXES]).groupBy("img", "tx", "ty", "tz").agg(*[F.sum(F.col("w") * F.col(d)).alias(f"h{d}") for d in D])
    hit = hit.withColumnsRenamed({f"t{a}": a for a in AXES})
    rows = t.join(now.select("img", "idx", *D), ["img", "idx"]).join(hit, ["img", *AXES], "left")
    moved = {d: F.when(F.col(f"h{d}").isNull(), F.col(d)).otherwise(F.col(f"s{a}") + F.col(f"h{d}")) for a, d in zip(AXES, D, strict=True)}
    return rows.select("img", *AXES, "idx", *[c.alias(d) for d, c in moved.items()])


def doubled(dis: DataFrame, coarse: Grid, fine: Grid) -> DataFrame:
    """A coarse level's field on the next finer one: sampled at half the coordinates and twice as long, 0 beyond its last cell."""
    half = [0.5 if n > 1 else 1.0 for n in fine.shape]
    at = empty_grid(dis.sparkSession, dis, fine.shape)
    t = at.withColumns({f"p{a}": F.col(a) * h for a, h in zip(AXES, half, strict=True)})
    taps = _corners(_inside(t, coarse, 1), coarse, range(2), lambda f, k: f if k else 1.0 - f, False)
    hit = taps.join(dis.select("img", *AXES, *D), ["img", *AXES]).groupBy("img", "tx", "ty", "tz").agg(*[(F.sum(F.col("w") * F.col(d)) / F.lit(h)).alias(d) for d, h in zip(D, half, strict=True)])
    hit = hit.withColumnsRenamed({f"t{a}": a for a in AXES})
    return at.join(hit, ["img", *AXES], "left").select("img", *AXES, "idx", *[F.coalesce(d, F.lit(0.0)).alias(d) for d in D])


def to_space(dis: DataFrame, grid: Grid, shape: tuple[int, int, int], affine) -> DataFrame:
    """A field of a grid's space on another shape and affine, sampled linearly, 0 where a place has no full cell.

    Vectors are in voxels, so they change with the voxels' size and axes: by the old axes in the new ones. Where both spaces
    have the same axes and cubic voxels that is the ratio of the voxel sizes.
    """
    old, new = (np.array(m, float).reshape(4, 4) for m in (grid.affine, affine))
    place, turn = np.linalg.inv(old) @ new, np.linalg.inv(new[:3, :3]) @ old[:3, :3]
    at = empty_grid(dis.sparkSession, dis, shape)
    along = lambda row, cols: sum((F.col(c) * float(v) for c, v in zip(cols, row, strict=False)), F.lit(0.0))
    t = at.withColumns({f"p{a}": along(place[k], AXES) + float(place[k, 3]) for k, a in enumerate(AXES)})
    # a place on a voxel, up to the rounding of the matrix, is on it
    t = t.withColumns({f"p{a}": F.when(F.abs(F.col(f"p{a}") - F.round(f"p{a}")) < 1e-9, F.round(f"p{a}")).otherwise(F.col(f"p{a}")) for a in AXES})
    taps = _corners(_inside(t, grid, 1), grid, range(2), lambda f, k: f if k else 1.0 - f, False)
    hit = taps.join(dis.select("img", *AXES, *D), ["img", *AXES]).groupBy("img", "tx", "ty", "tz").agg(*[F.sum(F.col("w") * F.col(d)).alias(d) for d in D])
    hit = hit.withColumnsRenamed({f"t{a}": a for a in AXES})
    rows = at.join(hit, ["img", *AXES], "left")
    return rows.select("img", *AXES, "idx", *[F.coalesce(along(turn[k], D), F.lit(0.0)).alias(d) for k, d in enumerate(D)])


@dataclass
class Progress:
    """What the driver keeps of one image's search."""

    smoothing: float
    least: float = float("inf")
    costs: list[float] = field(default_factory=list)
    length: float = 0.0

    def improves(self) -> bool:
        """Whether the line through the last costs doesn't rise; up to seven of them are kept."""
        n = len(self.costs)
        if n <= 5:
            return True
        if np.ptp(self.costs) and np.polyfit(range(n), self.costs, 1)[0] > 0:
            return False
        if n > 7:
            self.costs.pop(0)
        return True


@dataclass(frozen=True)
class Search:
    """Options of a search. kinds: the force of each image kind (r or d; r beyond its end). speed: the longest step of the first
    round, in voxels. smoothing: where easing ends that starts at `start`. resolution: levels on which it is still above 1
    after being halved from level to level are only interpolated, so 2 leaves the finest one out."""

    kinds: str = ""
    resolution: float = 2.0
    speed: float = 0.3
    smoothing: float = 0.05
    start: float = 0.8
    min_dimension: int = 16
    rounds: int = 200
    slab: int = SLAB


def _level(fixed: list[Grid], moving: list[Grid], dis: DataFrame, options: Search) -> DataFrame:
    """The search on one level from a field; the field of the least cost of each image."""
    grid, spark = fixed[0], dis.sparkSession
    state = saved(dis.select("img", *AXES, "idx", *D, *[F.col(d).alias(f"b{d}") for d in D]), "field")
    of: dict[int, Progress] = {}
    done: list[DataFrame] = []
    best = [F.col(f"b{d}").alias(d) for d in D]
    for round_ in range(options.rounds):
        now = state.select("img", *AXES, "idx", *D)
        push = saved(forces([compose_displacement(m, now) for m in moving], fixed, options.kinds), "forces")
        cost = {r["img"]: r["cost"] for r in push.groupBy("img").agg(F.avg("cost").alias("cost")).collect()}
        plan, ended = [], []
        for img, c in cost.items():
            p = of.setdefault(img, Progress(options.start))
            if not c:
                ended.append((img, False))
                continue
            p.costs.append(c)
            take, back = c < p.least, False
            p.least = min(c, p.least)
            if not p.improves():
                if p.smoothing <= options.smoothing:
                    ended.append((img, take and round_ > 0))
                    continue
                back, p.costs, p.smoothing = True, [], p.smoothing * 0.5
            plan.append((img, take and round_ > 0, back))
        step = saved(poisson(push, grid, slab=options.slab), "step")
        unknown = [img for img, _, _ in plan if not of[img].length]
        if unknown:
            for r in largest(step.where(F.col("img").isin(unknown))).collect():
                of[r["img"]].length = r["length"]
        ended += [(img, take) for img, take, _ in plan if not of[img].length]
        rows = [(img, take, back, options.speed / of[img].length, of[img].smoothing) for img, take, back in plan if of[img].length]
        if ended:
            last = spark.createDataFrame(ended, "img long, take boolean")
            kept = state.join(F.broadcast(last), "img").select("img", *AXES, "idx", *[F.when(F.col("take"), F.col(d)).otherwise(F.col(f"b{d}")).alias(d) for d in D])
            done.append(saved(kept, "ended"))
        if not rows:
            return reduce(DataFrame.unionByName, done)
        told = F.broadcast(spark.createDataFrame(rows, "img long, take boolean, back boolean, factor double, smoothing double"))
        if ended:  # the others go on alone
            fixed, moving = ([g.with_df(g.df.join(told, "img", "left_semi")) for g in kind] for kind in (fixed, moving))
        here = state.join(told, "img")
        taken = {f"b{d}": F.when(F.col("take"), F.col(d)).otherwise(F.col(f"b{d}")) for d in D}
        here = here.withColumns(taken).withColumns({d: F.when(F.col("back"), F.col(f"b{d}")).otherwise(F.col(d)) for d in D})
        move = step.join(told, "img").select("img", *AXES, "idx", *[(F.col(d) * F.col("factor")).alias(d) for d in D])
        moved = follow(move, here, grid).join(told.select("img", "smoothing"), "img")
        eased = in_slabs(moved, grid, (*D, "smoothing"), _easing(grid), 1, options.slab).drop("smoothing")
        state = saved(eased.join(here.select("img", "idx", *[f"b{d}" for d in D]), ["img", "idx"]).select(state.columns), "field")
    return reduce(DataFrame.unionByName, [*done, state.select("img", *AXES, "idx", *best)])


def _easing(grid: Grid):
    """smooth(), with each voxel's share in a fourth column."""
    near, dim = steps(grid), grid.dim

    def run(v):
        d, s = v[:, :3], v[:, 3:]
        return np.hstack([d * (1.0 - s) + neighbour_sum(d, near) * (s / (2.0 * dim)), s])

    return run


def search(fixed: list[Grid], moving: list[Grid], options: Search | None = None) -> DataFrame:
    """The field by which each moving image, sampled at x + d(x), comes close to the fixed one.

    Each list holds the kinds of an image, of one shape. Images are halved while their shortest side has over min_dimension
    voxels; each level starts from the coarser one's field. Of a level, the field of the least mean cost is kept. A level's
    smoothing eases from `start`: when costs have stopped falling it is halved and the search goes on from the best field,
    until that happens with smoothing at its end, or after `rounds`.
    """
    options = options or Search()
    grid = fixed[0]
    if min(grid.shape[: grid.dim]) <= options.min_dimension:
        zero = empty_grid(grid.df.sparkSession, grid.df, grid.shape).select("img", *AXES, "idx", *[F.lit(0.0).alias(d) for d in D])
        return _level(fixed, moving, zero, options)
    halves = [[g.with_df(saved(g.df, "half"), g.shape) for g in (downsample_with_padding(g) for g in kind)] for kind in (fixed, moving)]
    coarse = search(halves[0], halves[1], replace(options, resolution=options.resolution / 2))
    dis = doubled(coarse, halves[0][0], grid)
    return dis if options.resolution > 1 else _level(fixed, moving, dis, options)
