"""Search for an affine transform between images with voxel sizes: start from moments, costs of many transforms in one job,
bounded stages over levels.

A transform has twelve parameters in the units of the voxel sizes: shift, angles, scaling, shear. It takes the fixed image's
voxels to the moving image's, about the centres of both. Each evaluation asks for many parameter sets at once. Where the
moving images fit a byte limit they are sent to the executors once a level, and a task takes its fixed voxels through all
transforms in numpy and gives sums or joint counts; beyond the limit taps are looked up by joins. The driver gets a row for
each transform and kind of image.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.transform import rotation
from ..layout import AXES, Grid
from .graph import saved
from .optimize import lbfgs
from .resample import downsample_with_padding

#: Bytes of moving images that are sent to executors.
SENT_BYTES = 64 << 20
BINS = 256

# Bounds of shift (share of half the extent), angle (quarter turns), scale and shear, each (high, low), for x, y, z.
NARROW = [[(0.2, -0.2), (0.2, -0.2), (1.2, 0.8), (0.05, -0.05)], [(0.2, -0.2), (0.1, -0.1), (1.2, 0.8), (0.05, -0.05)], [(0.2, -0.2), (0.1, -0.1), (1.2, 0.8), (0.05, -0.05)]]
REGULAR = [[(0.75, -0.75), (0.4, -0.4), (1.5, 0.7), (0.1, -0.1)], [(0.75, -0.75), (0.25, -0.25), (1.5, 0.7), (0.1, -0.1)], [(0.75, -0.75), (0.25, -0.25), (1.5, 0.7), (0.1, -0.1)]]
LARGE = [[(1.0, -1.0), (0.5, -0.5), (2.0, 0.5), (0.25, -0.25)], [(1.0, -1.0), (0.4, -0.4), (2.0, 0.5), (0.25, -0.25)], [(1.0, -1.0), (0.4, -0.4), (2.0, 0.5), (0.25, -0.25)]]

# What each kind of transform lets go, and the stages on the way to it.
GOES = {
    "translocation": {"shift"},
    "rotation": {"angle"},
    "scaling": {"scale"},
    "rigid": {"shift", "angle"},
    "translocation_scaling": {"shift", "scale"},
    "rigid_scaling": {"shift", "angle", "scale"},
    "affine": {"shift", "angle", "scale", "shear"},
}
STAGES = {
    "translocation": ["translocation"],
    "rotation": ["rotation"],
    "scaling": ["scaling"],
    "rigid": ["translocation", "rigid"],
    "rigid_scaling": ["translocation", "translocation_scaling", "rigid_scaling"],
    "affine": ["translocation", "translocation_scaling", "rigid_scaling", "affine"],
}
PARTS = ("shift", "angle", "scale", "shear")
NONE = np.array([0, 0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0], float)


def turn(p: np.ndarray, dim: int) -> np.ndarray:
    """Shear after scaling after rotation, 3x3. In a plane the first angle and shear count."""
    angles, scale, shear = p[3:6], p[6:9], p[9:12]
    if dim == 2:
        r = np.eye(3)
        r[:2, :2] = [[np.cos(angles[0]), -np.sin(angles[0])], [np.sin(angles[0]), np.cos(angles[0])]]
        return np.array([[1, shear[0], 0], [0, 1, 0], [0, 0, 1.0]]) @ np.diag([scale[0], scale[1], 1.0]) @ r
    return np.array([[1, shear[0], shear[1]], [0, 1, shear[2]], [0, 0, 1.0]]) @ np.diag(scale) @ rotation(-np.asarray(angles))


def matrix(p, fixed: Grid, moving: Grid) -> list[float]:
    """Row-major 3x4 from fixed voxels to moving voxels; places are measured from the middle of the extents."""
    p, dim = np.asarray(p, float), fixed.dim
    f, m = (np.array([n * v for n, v in zip(g.shape, g.vs, strict=True)]) for g in (fixed, moving))
    sr, t = turn(p, dim), p[:3] - f / 2
    if dim == 2:
        f, t = np.append(f[:2], 0), np.append(t[:2], 0)
        m = np.append(m[:2], 0)
    vs = np.array(fixed.vs) if dim == 3 else np.append(fixed.vs[:2], 1.0)
    to = np.array(moving.vs) if dim == 3 else np.append(moving.vs[:2], 1.0)
    return np.hstack([sr * vs / to[:, None], ((sr @ t + m / 2) / to)[:, None]]).ravel().tolist()


def moments(grid: Grid) -> DataFrame:
    """(img, n, cx, cy, cz, cxx, cxy, cxz, cyy, cyz, czz): number, mean place and covariance of the voxels above 0, in voxel sizes."""
    at = {a: F.col(a) * float(v) for a, v in zip(AXES, grid.vs, strict=True)}
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return grid.df.where("v > 0").groupBy("img").agg(F.count("*").alias("n"), *[F.avg(at[a]).alias(f"c{a}") for a in AXES], *[F.covar_pop(at[a], at[b]).alias(f"c{a}{b}") for a, b in pairs])


def principal(m) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, falling variances, axes as rows) of a row of moments(). An axis points to where its largest component is above 0."""
    cov = np.array([[m[f"c{min(a, b)}{max(a, b)}"] for b in AXES] for a in AXES], float)
    values, vectors = np.linalg.eigh(cov)
    rows = vectors.T[::-1]
    signs = np.sign(rows[np.arange(3), np.abs(rows).argmax(1)])
    return np.array([m[f"c{a}"] for a in AXES], float), values[::-1], rows * signs[:, None]


def moment_start(fixed: Grid, moving: Grid) -> list[float]:
    """Twelve parameters that bring centres and principal axes of two 3D images together; NONE where one of them has no voxel above 0.

    The scale of each place in the order of variances is the root of theirs; angles are taken to within an eighth of a turn, as
    axes may point either way. A start for a search, not an alignment.
    """
    rows = [moments(g).groupBy().agg(*_pooled()).first() for g in (fixed, moving)]
    if any(not r["n"] for r in rows):
        return NONE.tolist()
    (c_f, l_f, v_f), (c_m, l_m, v_m) = (principal(r) for r in rows)
    scale = np.sqrt(np.maximum(l_m, 0) / np.maximum(l_f, 1e-6))
    r = v_m.T @ v_f
    if np.linalg.det(r) < 0:
        r[:, 2] = -r[:, 2]
    angles = [np.arctan2(r[2, 1], r[2, 2]), np.arctan2(-r[2, 0], np.hypot(r[2, 1], r[2, 2])), np.arctan2(r[1, 0], r[0, 0])]
    angles = [a - np.pi / 2 * np.round(a / (np.pi / 2)) for a in angles]
    half = lambda g: np.array([n * v * 0.5 for n, v in zip(g.shape, g.vs, strict=True)])
    shift = r.T @ ((c_m - half(moving)) / np.maximum(scale, 1e-6)) - (c_f - half(fixed))
    return [*map(float, shift), *map(float, angles), *map(float, scale), 0.0, 0.0, 0.0]


def _pooled() -> list:
    """The moments of several images taken as one."""
    n, mean = F.sum("n").alias("n"), {a: F.sum(F.col("n") * F.col(f"c{a}")) / F.sum("n") for a in AXES}
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    second = lambda a, b: F.sum(F.col("n") * (F.col(f"c{a}{b}") + F.col(f"c{a}") * F.col(f"c{b}"))) / F.sum("n") - mean[a] * mean[b]
    return [n, *[mean[a].alias(f"c{a}") for a in AXES], *[second(a, b).alias(f"c{a}{b}") for a, b in pairs]]


def limits(fixed: Grid, moving: Grid, kind: str, bounds=REGULAR, start=None) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the parameters around start (NONE if not given); those that the kind doesn't let go have no range."""
    low, high = (np.array(NONE if start is None else start, float) for _ in range(2))
    dim, go = fixed.dim, GOES[kind]
    for k in range(3):
        shift, angle, scale, shear = bounds[k]
        if k < dim and "shift" in go:
            reach = max(g.shape[k] * g.vs[k] for g in (fixed, moving)) * 0.5
            high[k], low[k] = high[k] + reach * shift[0], low[k] + reach * shift[1]
        if k < dim and "scale" in go:
            high[6 + k], low[6 + k] = high[6 + k] * scale[0], low[6 + k] * scale[1]
        if (dim == 3 or k == 0) and "angle" in go:
            high[3 + k], low[3 + k] = high[3 + k] + np.pi / 2 * angle[0], low[3 + k] + np.pi / 2 * angle[1]
        if (dim == 3 or k == 0) and "shear" in go:
            high[9 + k], low[9 + k] = high[9 + k] + shear[0], low[9 + k] + shear[1]
    return low, high


def stage_limits(now: np.ndarray, low: np.ndarray, high: np.ndarray, stage: str) -> tuple[np.ndarray, np.ndarray]:
    """Limits in a stage: what it doesn't let go stays where it is."""
    go = np.repeat([p in GOES[stage] for p in PARTS], 3)
    return np.where(go, low, now), np.where(go, high, now)


def to_bytes(grid: Grid) -> Grid:
    """Whole numbers 0 to 255 over each image's own range; an image of one value is 0."""
    ends = grid.df.groupBy("img").agg(F.min("v").cast("double").alias("lo"), F.max("v").cast("double").alias("hi"))
    level = F.coalesce(F.floor(F.try_divide((F.col("v") - F.col("lo")) * (BINS - 0.01), F.col("hi") - F.col("lo"))), F.lit(0))
    return grid.with_df(grid.df.join(ends, "img").withColumn("v", level.cast("long")).select(grid.df.columns))


def _taken(x: np.ndarray, at: np.ndarray, dim: int) -> np.ndarray:
    """x [z, y, x] linear at places [3, n]; 0 where there is no full cell."""
    n = x.shape[::-1]
    low = np.floor(at).astype(np.int64)
    ok = np.ones(at.shape[1], bool)
    for k in range(dim):
        ok &= (low[k] >= 0) & (low[k] + 1 < n[k])
    out = np.zeros(at.shape[1])
    low, f = low[:, ok], (at - low)[:, ok]
    total = np.zeros(int(ok.sum()))
    for c in range(1 << dim):
        w, pick = 1.0, []
        for k in range(3):
            b = c >> k & 1 if k < dim else 0
            w = w * ((f[k] if b else 1 - f[k]) if k < dim else 1.0)
            pick.append(low[k] + b if k < dim else np.zeros_like(low[k]))
        total += w * x[pick[2], pick[1], pick[0]]
    out[ok] = total
    return out


@dataclass
class Pair:
    """A fixed and a moving image of one kind, and the moving one as arrays where it is small enough to be sent."""

    fixed: Grid
    moving: Grid
    sent: object = None

    @classmethod
    def of(cls, fixed: Grid, moving: Grid, limit: int = SENT_BYTES) -> Pair:
        images = moving.df.select("img").distinct()
        if images.count() * moving.size * 8 > limit:
            return cls(fixed, moving)
        w, h, d = moving.shape
        arrays: dict[int, np.ndarray] = {}
        for r in moving.df.select("img", "idx", F.col("v").cast("double").alias("v")).toLocalIterator():  # at most `limit` bytes
            arrays.setdefault(r["img"], np.zeros(w * h * d))[r["idx"]] = r["v"]
        return cls(fixed, moving, moving.df.sparkSession.sparkContext.broadcast({k: v.reshape(d, h, w) for k, v in arrays.items()}))

    def samples(self, matrices: list[list[float]]) -> DataFrame:
        """(i, a, b): the fixed value and the moving one at each transform's place, 0 outside. By joins."""
        dim = self.fixed.dim
        many = F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(v)) for v in m]).alias("m")) for i, m in enumerate(matrices)])
        rows = self.fixed.df.select("img", "idx", *AXES, F.col("v").cast("double").alias("a"), F.explode(many).alias("c"))
        place = [sum((F.get("c.m", 4 * k + j) * F.col(a) for j, a in enumerate(AXES)), F.get("c.m", 4 * k + 3)).alias(f"p{n}") for k, n in enumerate(AXES)]
        base = rows.select("img", "idx", "a", F.col("c.i").alias("i"), *place)
        taps = base
        for k, (a, n) in enumerate(zip(AXES, self.moving.shape, strict=True)):
            low = F.floor(f"p{a}").cast("int")
            if k < dim:
                near = F.array(*[F.struct((low + b).alias("at"), (F.col(f"p{a}") - low if b else 1.0 - (F.col(f"p{a}") - low)).alias("w")) for b in (0, 1)])
                taps = taps.where((low >= 0) & (low + 1 < n)).withColumn(f"t{a}", F.explode(near))
            else:
                taps = taps.withColumn(f"t{a}", F.struct(F.lit(0).alias("at"), F.lit(1.0).alias("w")))
        taps = taps.select("img", "idx", "i", *[F.col(f"t{a}.at").alias(a) for a in AXES], (F.col("tx.w") * F.col("ty.w") * F.col("tz.w")).alias("w"))
        hit = taps.join(self.moving.df.select("img", *AXES, F.col("v").cast("double").alias("v")), ["img", *AXES]).groupBy("img", "idx", "i").agg(F.sum(F.col("w") * F.col("v")).alias("b"))
        return base.join(hit, ["img", "idx", "i"], "left").select("i", "a", F.coalesce("b", F.lit(0.0)).alias("b"))

    def _in_tasks(self, matrices, schema: str, add, give) -> DataFrame:
        """add(held, i, a, b) over all batches of a task, then give(held) for its rows."""
        sent, dim = self.sent, self.fixed.dim
        ms = [np.array(m, float).reshape(3, 4) for m in matrices]

        def run(batches) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                img, at = batch.column(0).to_numpy(), np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)]).astype(float)
                a = batch.column(4).to_numpy()
                for one in np.unique(img):
                    rows = img == one
                    if one in sent.value:
                        for i, m in enumerate(ms):
                            add(held, i, a[rows], _taken(sent.value[one], m[:, :3] @ at[:, rows] + m[:, 3:], dim))
            yield from give(held)

        return self.fixed.df.select("img", *AXES, F.col("v").cast("double").alias("a")).mapInArrow(run, schema)

    def joint(self, matrices: list[list[float]]) -> DataFrame:
        """(i, p, q, n): joint counts of whole values."""
        if self.sent is None:
            return self.samples(matrices).groupBy("i", F.floor("a").cast("int").alias("p"), F.floor(F.col("b") + 1e-9).cast("int").alias("q")).agg(F.count("*").alias("n"))

        def add(held, i, a, b):
            n = np.bincount(a.astype(np.int64) * BINS + np.floor(b + 1e-9).astype(np.int64), minlength=BINS * BINS)
            held[i] = held[i] + n if i in held else n

        def give(held):
            for i, n in held.items():
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i), pa.int32()), pa.array(k // BINS, pa.int32()), pa.array(k % BINS, pa.int32()), pa.array(n[k], pa.int64())], ["i", "p", "q", "n"])

        return self._in_tasks(matrices, "i int, p int, q int, n long", add, give).groupBy("i", "p", "q").agg(F.sum("n").alias("n"))

    def sums(self, matrices: list[list[float]]) -> DataFrame:
        """(i, n, a, b, aa, bb, ab): the number of voxels and the sums of values and their products."""
        names = ("n", "a", "b", "aa", "bb", "ab")
        if self.sent is None:
            a, b = F.col("a"), F.col("b")
            cols = dict(zip(names, (F.lit(1.0), a, b, a * a, b * b, a * b), strict=True))
            return self.samples(matrices).groupBy("i").agg(*[F.sum(c).alias(k) for k, c in cols.items()])

        def add(held, i, a, b):
            s = np.array([len(a), a.sum(), b.sum(), (a * a).sum(), (b * b).sum(), (a * b).sum()])
            held[i] = held[i] + s if i in held else s

        def give(held):
            for i, s in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.array([v], pa.float64()) for v in s]], ["i", *names])

        rows = self._in_tasks(matrices, "i int, " + ", ".join(f"{c} double" for c in names), add, give)
        return rows.groupBy("i").agg(*[F.sum(c).alias(c) for c in names])


def correlation_of(pair: Pair, matrices: list[list[float]]) -> DataFrame:
    """(i, cost): 1 - r^2 of each transform."""
    n, a, b, aa, bb, ab = (F.col(c) for c in ("n", "a", "b", "aa", "bb", "ab"))
    cov, va, vb = n * ab - a * b, n * aa - a * a, n * bb - b * b
    flat = (va <= 0) | (vb <= 0)
    return pair.sums(matrices).select("i", (1.0 - F.when(flat, 0.0).otherwise(F.try_divide(cov * cov, va * vb))).alias("cost"))


def information_of(pair: Pair, matrices: list[list[float]]) -> DataFrame:
    """(i, cost): minus the mean over all pairs of bins of n log(n / (np nq)), of images of to_bytes()."""
    h = saved(pair.joint(matrices), "joint")  # at most 65,536 rows a transform
    p, q = (h.groupBy("i", c).agg(F.sum("n").alias(f"n{c}")) for c in "pq")
    n = F.col("n").cast("double")
    term = n * F.ln(n / F.col("np") / F.col("nq"))
    return h.join(p, ["i", "p"]).join(q, ["i", "q"]).groupBy("i").agg((F.sum(term) / -float(BINS * BINS)).alias("cost"))


COSTS = {"correlation": correlation_of, "information": information_of}


def costs(pairs: list[Pair], cost: str, parameters: list[np.ndarray]) -> list[float]:
    """The cost of each parameter set: the sum over kinds of images over twice their number, in one job a kind."""
    total = np.zeros(len(parameters))
    for p in pairs:
        for r in COSTS[cost](p, [matrix(q, p.fixed, p.moving) for q in parameters]).collect():
            total[r["i"]] += r["cost"]
    return (total / (2 * len(pairs))).tolist()


def sweep(cost, p: np.ndarray, value: float, low: np.ndarray, high: np.ndarray, samples: int, rounds: int = 7) -> tuple[np.ndarray, float]:
    """The best of `samples` places along each free parameter, and of all best steps together; the range halves with each round.

    Mutual information of small images is rough, and a descent from far off ends in a side valley; samples find the main one.
    """
    for k in range(rounds):
        free = np.flatnonzero(high > low)
        points, of = [], []
        for i in free:
            for s in np.linspace(0, 1, samples):
                q = p.copy()
                q[i] = p[i] + ((low[i] - p[i]) * (1 - s) + (high[i] - p[i]) * s) / 2**k
                points.append(q)
                of.append(i)
        if not points:
            return p, value
        found = np.array(cost(points))
        together = p.copy()
        for i in free:
            mine = np.flatnonzero(np.array(of) == i)
            best = mine[found[mine].argmin()]
            if found[best] < value:
                together[i] = points[best][i]
        points.append(together)
        found = np.append(found, cost([together]))
        best = int(found.argmin())
        if not found[best] < value:
            continue
        p, value = points[best], float(found[best])
    return p, value


@dataclass(frozen=True)
class AffineSearch:
    """kind and cost of a search, its bounds, whether these lie around no transform at all or around the start, samples along a
    parameter before each stage, precision in shares of a range, rounds of a descent, and the voxels an axis above which images
    are halved and above which the finest level is left out."""

    kind: str = "affine"
    cost: str = "information"
    bounds: list = field(default_factory=lambda: REGULAR)
    absolute: bool = True
    samples: int = 16
    precision: float = 0.001
    rounds: int = 128
    halved_from: int = 96
    enough_from: int = 256


def search(fixed: list[Grid], moving: list[Grid], options: AffineSearch | None = None, start=None) -> tuple[np.ndarray, float]:
    """(parameters, cost) that bring the moving images to the fixed ones, several kinds of image together.

    Levels go from coarse to fine, halved while the fixed image has over halved_from voxels an axis. On the coarsest one every
    stage runs, after a sweep of samples; on finer ones the last stage alone.
    """
    o = options or AffineSearch()
    p = np.array(NONE if start is None else start, float)
    low, high = limits(fixed[0], moving[0], o.kind, o.bounds, None if o.absolute else p)
    ready = to_bytes if o.cost == "information" else (lambda g: g)
    keep = lambda g: g.with_df(saved(g.df, "level"), g.shape)
    levels = [([keep(ready(g)) for g in fixed], [keep(ready(g)) for g in moving])]
    dim = fixed[0].dim
    while levels[-1][0][0].size > o.halved_from**dim:
        levels.append(tuple([keep(downsample_with_padding(g)) for g in side] for side in levels[-1]))
    value = np.inf
    for level in reversed(range(len(levels))):
        pairs = [Pair.of(f, m) for f, m in zip(*levels[level], strict=True)]
        if level < len(levels) - 1 and pairs[0].fixed.size > o.enough_from**dim:
            break
        coarsest = level == len(levels) - 1
        fun = lambda ps, pairs=pairs: costs(pairs, o.cost, ps)
        value = fun([p])[0]
        for stage in STAGES[o.kind] if coarsest else STAGES[o.kind][-1:]:
            lo, hi = stage_limits(p, low, high, stage)
            if coarsest and o.samples:
                p, value = sweep(fun, p, value, lo, hi, o.samples)
            q, found = lbfgs(fun, p, lo, hi, o.precision if coarsest else o.precision * 0.2, o.rounds)
            if found < value:
                p, value = q, found
        for pair in pairs:
            if pair.sent is not None:
                pair.sent.unpersist()
    return p, value


def aligned(fixed: Grid, moving: Grid, p, interpolation: str = "linear") -> Grid:
    """The moving image on the fixed one's voxels."""
    from .resample import resample_affine

    return replace(resample_affine(moving, fixed.shape, matrix(p, fixed, moving), interpolation), vs=fixed.vs, affine=fixed.affine)
