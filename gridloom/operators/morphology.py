"""Morphology by neighbours, connected components, and what is built on them.

Neighbours are reached by exploding offsets on the side that is set and adding up by target, so a step is one exchange.
Connected components first join runs along x (one window), then merge touching runs by star contraction over a table of
run pairs, so rounds grow with the logarithm of a component's size, not with its diameter.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..layout import AXES, Grid, voxel_index
from . import graph


def offsets(dim: int, full: bool = False, here: bool = False, radius: int | None = None) -> list[tuple[int, int, int]]:
    """Face neighbours (4 or 6), all (8 or 26), or a ball's."""
    r = radius or 1
    span = range(-r, r + 1)
    out = []
    for dz, dy, dx in product(span if dim == 3 else (0,), span, span):
        size = abs(dx) + abs(dy) + abs(dz)
        near = dx * dx + dy * dy + dz * dz <= r * r if radius else full or size <= 1
        if near and (size or here):
            out.append((dx, dy, dz))
    return out


def spread(df: DataFrame, steps: list[tuple[int, int, int]], *cols: str) -> DataFrame:
    """Each row once for every offset, at the shifted place."""
    at = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in steps])
    return df.select("img", *AXES, *cols, F.explode(at).alias("o")).select("img", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], *cols)


def _with(grid: Grid, found: DataFrame, value: Column) -> Grid:
    """found: one row at most a place; value may use v and found's columns."""
    return grid.with_df(grid.df.join(found, ["img", *AXES], "left").withColumn("v", value).select(grid.df.columns))


def neighbor_count(grid: Grid, full: bool = True, here: bool = True) -> DataFrame:
    """(img, x, y, z, n): non-zero voxels around each place that has any."""
    return spread(grid.df.where("v <> 0"), offsets(grid.dim, full, here)).groupBy("img", *AXES).agg(F.count("*").alias("n"))


def erosion(grid: Grid) -> Grid:
    """0 where a face neighbour inside the image is 0."""
    hit = spread(grid.df.where("v = 0"), offsets(grid.dim)).distinct().withColumn("hit", F.lit(1))
    return _with(grid, hit, F.when(F.col("hit").isNotNull(), F.lit(0)).otherwise(F.col("v")))


def dilation(grid: Grid) -> Grid:
    """Each value or-ed bit by bit with its face neighbours'."""
    near = spread(grid.df.where("v <> 0"), offsets(grid.dim), "v").groupBy("img", *AXES).agg(F.bit_or("v").alias("o"))
    return _with(grid, near, F.col("v").bitwiseOR(F.coalesce("o", F.lit(0))))


def erosion_by_threshold(grid: Grid, ref: Grid, t: float) -> Grid:
    """Erosion only where the reference passes: over t, or under -t for a negative t."""
    e = erosion(grid).df.select("img", "idx", F.col("v").alias("e"))
    r = ref.df.select("img", "idx", F.col("v").alias("r"))
    ok = F.col("r") > t if t >= 0 else F.col("r") < -t
    return grid.with_df(grid.df.join(e, ["img", "idx"]).join(r, ["img", "idx"]).withColumn("v", F.when(ok, F.col("e")).otherwise(F.col("v"))).select(grid.df.columns))


def dilation_by_threshold(grid: Grid, ref: Grid, t: float) -> Grid:
    e = dilation(grid).df.select("img", "idx", F.col("v").alias("e"))
    r = ref.df.select("img", "idx", F.col("v").alias("r"))
    ok = F.col("r") > t if t >= 0 else F.col("r") < -t
    return grid.with_df(grid.df.join(e, ["img", "idx"]).join(r, ["img", "idx"]).withColumn("v", F.when(ok, F.col("e")).otherwise(F.col("v"))).select(grid.df.columns))


def erosion_by_radius(grid: Grid, radius: int) -> Grid:
    """Set voxels whose whole ball is set; what lies outside counts as 0."""
    ball = offsets(grid.dim, radius=radius, here=True)
    n = spread(grid.df.where("v <> 0"), ball).groupBy("img", *AXES).agg(F.count("*").alias("n"))
    return _with(grid, n, F.when(F.coalesce("n", F.lit(0)) == len(ball), F.col("v")).otherwise(F.lit(0)))


def dilation_by_radius(grid: Grid, radius: int) -> Grid:
    n = spread(grid.df.where("v <> 0"), offsets(grid.dim, radius=radius, here=True)).distinct().withColumn("n", F.lit(1))
    return _with(grid, n, F.when(F.col("v") != 0, F.col("v")).when(F.col("n").isNotNull(), F.lit(1)).otherwise(F.lit(0)))


def region_counts(grid: Grid) -> DataFrame:
    """(img, x, y, z, u, n): how many voxels of the 3^dim window have each value, the voxel itself included."""
    near = spread(grid.df, offsets(grid.dim, True, True), "v").groupBy("img", *AXES, F.col("v").alias("u")).agg(F.count("*").alias("n"))
    return near.join(grid.df.select("img", *AXES), ["img", *AXES], "left_semi")


def fit(grid: Grid, ref: Grid, weight: int = 2) -> Grid:
    """A mask's smoothing that listens to a reference image.

    A voxel's count is that of set voxels in its 3^dim window. Where it lies within 2 dim of half of the window, the
    neighbours whose reference values are closest to the voxel's (the closest half but the very closest; of equals the
    earlier in the window) each add weight if they are set, or take it away. Over half sets, under half clears.
    """
    half, reach = _half(grid), 2 * grid.dim
    both = grid.df.join(ref.df.select("img", "idx", F.col("v").cast("double").alias("r")), ["img", "idx"])
    steps = [o for o in offsets(grid.dim, True) if any(o)]
    at = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(-d).alias(f"d{a}") for d, a in zip(o, AXES, strict=True)]) for k, o in enumerate(steps)])
    out = both.select("img", *AXES, (F.col("v") != 0).cast("int").alias("on"), F.col("r").alias("near"), F.explode(at).alias("o"))
    out = out.select("img", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], "on", "near", F.col("o.k").alias("k"))
    own = both.select("img", *AXES, F.col("v").alias("mine"), "r")
    rows = out.join(own, ["img", *AXES]).groupBy("img", *AXES).agg(F.sum("on").alias("n"), F.first("mine").alias("mine"), F.sort_array(F.collect_list(F.struct(F.abs(F.col("near") - F.col("r")).alias("far"), "k", "on"))).alias("s"))
    n = F.col("n") + (F.col("mine") != 0).cast("int")
    some = F.slice("s", 2, F.greatest(F.floor((F.size("s") + 1) / 2).cast("int") - 1, F.lit(0)))
    vote = F.aggregate(some, F.lit(0), lambda a, x: a + F.when(x["on"] == 1, F.lit(weight)).otherwise(F.lit(-weight)))
    score = n + F.when(n.between(half - reach, half + reach), vote).otherwise(F.lit(0))
    found = rows.select("img", *AXES, score.alias("score"))
    return _with(grid, found, F.when(F.col("score") > half, F.lit(1)).when(F.col("score") < half, F.lit(0)).otherwise(F.col("v")))


def _edge_steps(shape: tuple[int, int, int], dim: int, kind: str) -> list[int]:
    w, h, _ = shape
    steps = {"x": 1, "y": w, "z": w * h}
    return [steps[a] for a in (AXES[:dim] if kind in ("all", "thin") else tuple(kind))]


def _differing(df: DataFrame, size: int, steps: list[int], kind: str, differ: Column, *keys: str) -> DataFrame:
    """(img, keys, idx) of places that differ from one a step on in storage order, and for "all" of that one too.

    Both ends of a pair are added up under its lower place, so a pair is an aggregate and no task holds an image.
    """
    ends = F.array(*[F.struct(F.lit(s).cast("long").alias("s"), F.lit(b).cast("long").alias("b")) for s in steps for b in (0, s)])
    rows = df.select("img", *keys, "idx", "v", F.explode(ends).alias("e")).select("img", *keys, F.col("e.s").alias("s"), (F.col("idx") - F.col("e.b")).alias("low"), "v")
    pairs = rows.where((F.col("low") >= 0) & (F.col("low") < size - F.col("s"))).groupBy("img", *keys, "s", "low").agg(differ.alias("d")).where("d")
    at = F.explode(F.array("low", F.col("low") + F.col("s"))) if kind == "all" else F.col("low")
    return pairs.select("img", *keys, at.alias("idx")).distinct()


def edge(grid: Grid, kind: str = "all") -> Grid:
    """1 where a face neighbour in storage order differs: all, thin (later ones only), xy, yz or xz. Rows run on into each other."""
    hits = _differing(grid.df, grid.size, _edge_steps(grid.shape, grid.dim, kind), kind, F.min("v") != F.max("v"))
    return _labelled(grid, hits.withColumn("n", F.lit(1)))


def is_edge(grid: Grid) -> Grid:
    """1 where one of the 8 or 26 neighbours inside the image differs."""
    near = spread(grid.df, offsets(grid.dim, True), "v").groupBy("img", *AXES).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return _with(grid, near, ((F.col("lo") != F.col("v")) | (F.col("hi") != F.col("v"))).cast("int"))


def inner_edge(grid: Grid) -> Grid:
    """1 where one of the neighbours is larger."""
    near = spread(grid.df, offsets(grid.dim, True), "v").groupBy("img", *AXES).agg(F.max("v").alias("hi"))
    return _with(grid, near, F.coalesce(F.col("hi") > F.col("v"), F.lit(False)).cast("int"))


def negate(grid: Grid) -> Grid:
    return grid.map((F.col("v") == 0).cast("int"))


def _half(grid: Grid) -> int:
    return 13 if grid.dim == 3 else 4


def smoothing(grid: Grid, fill_only: bool = False) -> Grid:
    """Set where over half of the 3^dim window is set, cleared where under, kept where equal."""
    n, k = F.coalesce("n", F.lit(0)), _half(grid)
    clear = F.col("v") if fill_only else F.when(n < k, F.lit(0)).otherwise(F.col("v"))
    return _with(grid, neighbor_count(grid), F.when(n > k, F.lit(1)).otherwise(clear))


def recursive_smoothing(grid: Grid, rounds: int = 100) -> Grid:
    """smoothing() until nothing changes, at most so many rounds; a settled image stays as it is while others go on."""
    for _ in range(rounds):
        both = graph.saved(smoothing(grid).df.withColumnRenamed("v", "next").join(grid.df.select("img", "idx", "v"), ["img", "idx"]), "smoothing")
        if not both.where("next <> v").limit(1).count():
            break
        grid = grid.with_df(both.drop("v").withColumnRenamed("next", "v").select(grid.df.columns))
    return grid


def smoothing_multiple_region(grid: Grid) -> Grid:
    """The most frequent value of the 3^dim window (the smallest of equals) where it fills over half of it."""
    each = spread(grid.df, offsets(grid.dim, True, True), "v").groupBy("img", *AXES, F.col("v").alias("u")).agg(F.count("*").alias("n"))
    top = each.groupBy("img", *AXES).agg(F.max(F.struct("n", (-F.col("u")).alias("u"))).alias("t"))
    return _with(grid, top, F.when(F.col("t.n") > _half(grid), -F.col("t.u")).otherwise(F.col("v")))


def smoothing_by_kind(grid: Grid) -> Grid:
    """smoothing_multiple_region() for images that hold anything but 0 and 1, smoothing() for the others."""
    each = spread(grid.df, offsets(grid.dim, True, True), "v").groupBy("img", *AXES, F.col("v").alias("u")).agg(F.count("*").alias("n"))
    near = each.groupBy("img", *AXES).agg(F.max(F.struct("n", (-F.col("u")).alias("u"))).alias("t"), F.sum(F.when(F.col("u") != 0, F.col("n")).otherwise(0)).alias("on"))
    kinds = grid.df.groupBy("img").agg(F.bool_or(~F.col("v").isin(0, 1)).alias("many"))
    k = _half(grid)
    regions = F.when(F.col("t.n") > k, -F.col("t.u")).otherwise(F.col("v"))
    plain = F.when(F.col("on") > k, F.lit(1)).when(F.col("on") < k, F.lit(0)).otherwise(F.col("v"))
    df = grid.df.join(near, ["img", *AXES], "left").join(kinds, "img")
    return grid.with_df(df.withColumn("v", F.when(F.col("many"), regions).otherwise(plain)).select(grid.df.columns))


@dataclass(frozen=True)
class Masks:
    """Masks (img, k, x, y, z): a row a set voxel, k telling the masks of an image apart. Places without a row aren't set."""

    df: DataFrame
    shape: tuple[int, int, int]
    dim: int

    def near(self, steps: list[tuple[int, int, int]]) -> DataFrame:
        """(img, k, x, y, z, n, on): how many set voxels a place inside the image has within the steps, and whether it is one."""
        at = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for d, a in zip(o, AXES, strict=True)]) for o in steps])
        rows = self.df.select("img", "k", *AXES, F.explode(at).alias("o"))
        here = F.lit(True)
        for a in AXES:
            here = here & (F.col(f"o.d{a}") == 0)
        rows = rows.select("img", "k", *[(F.col(a) + F.col(f"o.d{a}")).alias(a) for a in AXES], here.alias("here"))
        for a, n in zip(AXES, self.shape, strict=True):
            rows = rows.where(F.col(a).between(0, n - 1))
        return rows.groupBy("img", "k", *AXES).agg(F.count("*").alias("n"), F.max("here").alias("on"))

    def with_df(self, df: DataFrame) -> Masks:
        return replace(self, df=df.select("img", "k", *AXES))


def mask_dilation(m: Masks) -> Masks:
    return m.with_df(m.near(offsets(m.dim, here=True)))


def mask_erosion(m: Masks) -> Masks:
    """Voxels stay whose face neighbours inside the image are all set."""
    sides = sum(((F.col(a) > 0).cast("int") + (F.col(a) < n - 1).cast("int") for a, n in zip(AXES[: m.dim], m.shape, strict=False)), F.lit(1))
    return m.with_df(m.near(offsets(m.dim, here=True)).where(F.col("on") & (F.col("n") == sides)))


def mask_edge(m: Masks, kind: str = "all") -> Masks:
    w, h, d = m.shape
    rows = m.df.select("img", "k", voxel_index("x", "y", "z", m.shape).alias("idx"), F.lit(1).alias("v"))
    hits = _differing(rows, w * h * d, _edge_steps(m.shape, m.dim, kind), kind, F.count("*") == 1, "k")
    z = F.floor(F.col("idx") / (w * h))
    return m.with_df(hits.select("img", "k", (F.col("idx") % w).cast("int").alias("x"), (F.floor(F.col("idx") / w) % h).cast("int").alias("y"), z.cast("int").alias("z")))


def _waves(m: Masks, closes: bool) -> Masks:
    """Opening or closing of every mask by itself.

    A voxel's count is that of set voxels in its 3^dim window, itself included. The limit lies t from half of the window,
    where t is the largest from 4 (2D) or 8 (3D) down to 0 at which the mask changes at all: set voxels of fewer than
    half - t go, or unset ones of more than half + t are set, in waves until none is left. That t follows from a mask's
    extreme count. Each wave is one aggregate and one table.
    """
    half, top = (13, 8) if m.dim == 3 else (4, 4)
    steps = offsets(m.dim, True, True)
    near = graph.saved(m.near(steps), "waves")
    if closes:
        limits = near.where("not on").groupBy("img", "k").agg(F.least(F.lit(top), F.max("n") - half - 1).alias("t"))
    else:
        limits = near.where("on").groupBy("img", "k").agg(F.least(F.lit(top), F.lit(half - 1) - F.min("n")).alias("t"))
    limits = graph.saved(limits.where("t >= 0"), "waves")
    hit = ~F.col("on") & (F.col("n") > half + F.col("t")) if closes else F.col("on") & (F.col("n") < half - F.col("t"))
    while True:
        now = graph.saved(near.join(limits, ["img", "k"], "left").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("t"), "waves")
        if not now.where("hit").limit(1).count():
            return m.with_df(now.where("on"))
        near = m.with_df(now.where(F.col("on") != F.col("hit"))).near(steps)


def mask_opening(m: Masks) -> Masks:
    return _waves(m, False)


def mask_closing(m: Masks) -> Masks:
    return _waves(m, True)


def opening(grid: Grid) -> Grid:
    """Removes voxels with few neighbours in waves, each image with its own limit (see _waves)."""
    return _whole(grid, mask_opening)


def closing(grid: Grid) -> Grid:
    """Sets voxels with many neighbours to 1 in waves, each image with its own limit (see _waves)."""
    return _whole(grid, mask_closing)


def _whole(grid: Grid, op: Callable[[Masks], Masks]) -> Grid:
    """op on the mask of an image's non-zero voxels; those that stay keep their values, new ones are 1."""
    m = op(Masks(grid.df.where("v <> 0").select("img", F.lit(0).alias("k"), *AXES), grid.shape, grid.dim))
    kind = grid.df.schema["v"].dataType.simpleString()
    v = F.when(F.col("k").isNull(), F.lit(0)).when(F.col("v") != 0, F.col("v")).otherwise(F.lit(1))
    return grid.with_df(grid.df.join(m.df, ["img", *AXES], "left").withColumn("v", v.cast(kind)).select(grid.df.columns))


def convex_x(grid: Grid) -> Grid:
    """Each row set from its first to its last positive voxel, where it has two."""
    return _between(grid, "x")


def convex_y(grid: Grid) -> Grid:
    return _between(grid, "y")


def _between(grid: Grid, axis: str) -> Grid:
    w = Window.partitionBy("img", *[a for a in AXES if a != axis])
    on = F.when(F.col("v") > 0, F.col(axis))
    return grid.map(F.when((F.min(on).over(w) < F.max(on).over(w)) & F.col(axis).between(F.min(on).over(w), F.max(on).over(w)), F.lit(1)).otherwise(F.col("v")))


def components(grid: Grid, full: bool = False, by_slice: bool = False) -> DataFrame:
    """(img, x, y, z, idx, label): connected non-zero voxels share the smallest idx among them. Faces join, or all neighbours."""
    on = grid.df.where("v <> 0").select("img", *AXES, "idx")
    line = Window.partitionBy("img", "y", "z").orderBy("x")
    starts = F.when(F.coalesce(F.col("x") - F.lag("x").over(line), F.lit(2)) > 1, F.col("idx"))
    cells = graph.saved(on.withColumn("run", F.last(starts, True).over(line)), "runs")
    runs = cells.groupBy("img", "y", "z", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    dim = 2 if by_slice else grid.dim
    steps = [(dy, dz) for dx, dy, dz in offsets(dim, full) if (dz, dy) > (0, 0)]
    reach = 1 if full else 0
    # runs touch if cells do: join cells of the next line by equal coordinates, so there is no range join
    near = spread(cells, sorted({(dx, dy, dz) for dx in range(-reach, reach + 1) for dy, dz in steps}), "run")
    touch = near.join(cells.select("img", *AXES, F.col("run").alias("other")), ["img", *AXES]).select("img", "run", "other").distinct()
    node = lambda c: F.struct("img", F.col(c).alias("run"))
    edges = touch.select(node("run").alias("a"), node("other").alias("b"))
    roots = graph.components(edges).select(F.col("node.img").alias("img"), F.col("node.run").alias("run"), F.col("root.run").alias("root"))
    labels = runs.select("img", "run").join(roots, ["img", "run"], "left").select("img", "run", F.coalesce("root", "run").alias("label"))
    return cells.join(labels, ["img", "run"]).select("img", *AXES, "idx", "label")


def connected_component_labeling(grid: Grid) -> Grid:
    """Labels 1..n in each image, in the order of the components' first voxels; 0 elsewhere."""
    c = components(grid)
    named = c.select("img", "label").distinct().withColumn("n", F.row_number().over(Window.partitionBy("img").orderBy("label")).cast("long"))
    return _labelled(grid, c.join(named, ["img", "label"]).select("img", "idx", "n"))


def _labelled(grid: Grid, rows: DataFrame) -> Grid:
    return grid.with_df(grid.df.join(rows, ["img", "idx"], "left").withColumn("v", F.coalesce("n", F.lit(0))).select(grid.df.columns))


def component_sizes(grid: Grid) -> DataFrame:
    """(img, label, n)."""
    return components(grid).groupBy("img", "label").agg(F.count("*").alias("n"))


def _largest(c: DataFrame) -> DataFrame:
    sizes = c.groupBy("img", "label").agg(F.count("*").alias("n"))
    return sizes.groupBy("img").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))


def defragment(grid: Grid) -> Grid:
    """The largest component stays, the first of equals."""
    c = graph.saved(components(grid), "cells")
    keep = c.join(_largest(c), ["img", "label"]).select("img", "idx", F.lit(1).alias("n"))
    return grid.with_df(grid.df.join(keep, ["img", "idx"], "left").withColumn("v", F.when(F.col("n").isNotNull(), F.col("v")).otherwise(F.lit(0))).select(grid.df.columns))


keep_largest = defragment


def defragment_by_size_ratio(grid: Grid, ratio: float = 0.05) -> Grid:
    """Components of at most ratio times the largest size (rounded down) go."""
    c = graph.saved(components(grid), "cells")
    sizes = c.groupBy("img", "label").agg(F.count("*").alias("n"))
    top = sizes.groupBy("img").agg(F.floor(F.max("n") * ratio).alias("least"))
    keep = c.join(sizes.join(top, "img").where("n > least").select("img", "label"), ["img", "label"]).select("img", "idx", F.lit(1).alias("k"))
    return grid.with_df(grid.df.join(keep, ["img", "idx"], "left").withColumn("v", F.when(F.col("k").isNotNull(), F.col("v")).otherwise(F.lit(0))).select(grid.df.columns))


def fill_holes(grid: Grid) -> Grid:
    """All components of zeros but the largest become 1."""
    c = graph.saved(components(negate(grid)), "cells")
    holes = c.join(_largest(c), ["img", "label"], "left_anti").select("img", "idx", F.lit(1).alias("h"))
    return grid.with_df(grid.df.join(holes, ["img", "idx"], "left").withColumn("v", F.when(F.col("h").isNotNull(), F.lit(1)).otherwise(F.col("v"))).select(grid.df.columns))


def fill_holes_by_slice(grid: Grid) -> Grid:
    """In each z slice, components of zeros that don't touch its border become 1."""
    w, h, _ = grid.shape
    c = graph.saved(components(negate(grid), by_slice=True), "cells")
    border = (F.col("x") == 0) | (F.col("x") == w - 1) | (F.col("y") == 0) | (F.col("y") == h - 1)
    inner = c.groupBy("img", "label").agg(F.bool_or(border).alias("b")).where("not b").select("img", "label")
    holes = c.join(inner, ["img", "label"]).select("img", "idx", F.lit(1).alias("h"))
    return grid.with_df(grid.df.join(holes, ["img", "idx"], "left").withColumn("v", F.when(F.col("h").isNotNull(), F.lit(1)).otherwise(F.col("v"))).select(grid.df.columns))


def defragment_and_fill_holes(grid: Grid) -> Grid:
    """The largest component of what is set, and all that isn't the largest component of zeros."""
    a = defragment(grid).df.select("img", "idx", (F.col("v") != 0).alias("a"))
    b = negate(defragment(negate(grid))).df.select("img", "idx", (F.col("v") != 0).alias("b"))
    hole = grid.df.join(a, ["img", "idx"]).join(b, ["img", "idx"])
    return grid.with_df(hole.withColumn("v", (F.col("a") | (F.col("b") & (F.col("v") == 0))).cast("int")).select(grid.df.columns))


def region_growing(grid: Grid, seeds: DataFrame, low, high) -> DataFrame:
    """(img, x, y, z, idx) of the voxels within [low, high] connected with a seed (img, idx) over all neighbours."""
    c = graph.saved(components(grid.map(F.col("v").between(low, high).cast("int")), full=True), "cells")
    hit = c.join(seeds, ["img", "idx"], "left_semi").select("img", "label").distinct()
    return c.join(hit, ["img", "label"], "left_semi").select("img", *AXES, "idx")


def for_each_label(grid: Grid, op: Callable[[Masks], Masks]) -> Grid:
    """op on the mask of each label of each image; the highest label wins where results overlap.

    An image whose maximum is 1 or less is one mask of its non-zero voxels. The label is a key beside img, so the number
    of labels has no bound and each is worked on where its voxels are.
    """
    kind = grid.df.schema["v"].dataType.simpleString()
    top = grid.df.groupBy("img").agg((F.max("v") > 1).alias("many"))
    rows = grid.df.where("v <> 0").join(top, "img").where("v > 0 or not many")
    masks = rows.select("img", F.when(F.col("many"), F.col("v")).otherwise(F.lit(1)).cast(kind).alias("k"), *AXES)
    found = op(Masks(masks, grid.shape, grid.dim)).df.groupBy("img", *AXES).agg(F.max("k").alias("n"))
    return _with(grid, found, F.coalesce("n", F.lit(0)).cast(kind))
