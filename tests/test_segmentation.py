"""Labels, probabilities, alignment, options, colours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import color
from gridloom.layout import Grid, empty_grid
from gridloom.operators import geometry as G
from gridloom.operators import morphology as M
from gridloom.operators import segmentation as S
from gridloom.operators.alignment import Alignment, match_resolution
from gridloom.operators.displacement import Search
from gridloom.options import Options


def grid(spark, values, shape):
    table = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.asarray(values).ravel())], "idx long, v double")
    return Grid(empty_grid(spark, [0], shape).join(table, "idx").select("img", "x", "y", "z", "idx", "v"), shape)


def values(g):
    return [r["v"] for r in g.df.orderBy("idx").collect()]


def test_channels(spark):
    rows = [(0, i, c, p) for i, ps in enumerate([(0.2, 0.3), (0.9, 0.8), (0.0, 0.0)]) for c, p in enumerate(ps)]
    ch = spark.createDataFrame(rows, "img long, idx long, ch int, p double")
    bg = {(r["idx"], r["ch"]): round(r["p"], 6) for r in S.create_bg(ch).collect()}
    assert bg[0, 0] == 0.5 and bg[1, 0] == 0 and bg[2, 0] == 1 and bg[1, 1] == 0.9
    n = {(r["idx"], r["ch"]): r["p"] for r in S.renormalize(S.create_bg(ch)).collect()}
    assert abs(n[1, 1] - 0.9 / 1.7) < 1e-9
    mask = grid(spark, [1, 1, 0], (3, 1, 1))
    assert values(S.argmax(S.create_bg(ch), mask)) == [2, 1, 0]
    assert S.zero_channel(S.clamp_prob(ch), 1).where("p > 0 and ch = 1").count() == 0


def test_labels_grow_and_orientation(spark):
    labels = grid(spark, [1, 0, 0, 0, 0, 2], (6, 1, 1))
    mask = grid(spark, [1, 1, 1, 1, 1, 1], (6, 1, 1))
    assert values(S.fill_and_smooth_labels(labels, mask, 6, 1)) == [1, 1, 1, 2, 2, 2]
    g = grid(spark, np.arange(6), (3, 2, 1))
    there = S.handle_orientation(g, "flip_x+swap_xy")
    assert there.shape == (2, 3, 1) and values(S.handle_orientation(there, "flip_x+swap_xy", True)) == values(g)
    z = values(S.zscore_nonzero(grid(spark, [0, 2, 4], (3, 1, 1))))
    assert z == [0, -1, 1]


def test_morphology_of_a_blob(spark):
    a = np.zeros((1, 9, 9))
    a[0, 2:7, 2:7] = 1
    a[0, 4, 4] = 0
    a[0, 0, 0] = 1
    clean = np.zeros((1, 9, 9))
    clean[0, 2:7, 2:7] = 1
    assert values(M.defragment_and_fill_holes(grid(spark, a, (9, 9, 1)))) == clean.ravel().tolist()
    out = np.array(values(S.dndnco(grid(spark, a, (9, 9, 1)))))
    assert out.sum() >= 20 and out.reshape(9, 9)[4, 4] == 1 and out[0] == 0


def test_alignment(spark):
    rng = np.random.default_rng(1)
    base = rng.random((1, 14, 16))
    for _ in range(3):
        base = (base + np.roll(base, 1, 1) + np.roll(base, 1, 2)) / 3
    fixed, moving = grid(spark, base[:, :, 1:13], (12, 14, 1)), grid(spark, base[:, :, :12], (12, 14, 1))
    a = Alignment([moving], [fixed])
    before = a.correlations()[0]
    cost = a.linear([0] * 6 + [1] * 3 + [0] * 3, [2, 0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0], rounds=1)
    # one column of the moved image comes from outside and is 0, so the cost stays above 0
    assert a.matrix[3] == pytest.approx(1.0) and cost < 1 - before**2 and a.correlations()[0] > before
    a.nonlinear(Search(rounds=3))
    assert a.moved().df.count() == fixed.size and a.correlations()[0] > before
    assert a.match_field_of_view()[0].df.where("v = 0").count() >= 14
    from dataclasses import replace

    s, t = match_resolution(replace(fixed, vs=(0.5, 0.5, 1.0)), replace(fixed, vs=(1.0, 1.0, 1.0)))
    assert s.vs[0] == 1.0 and s.shape == (6, 7, 1) and t.shape == (12, 14, 1)


def test_slices_options_and_colours(spark):
    for axis in "xyz":
        assert G.slice_to_space(axis, G.space_to_slice(axis, (1, 2, 3))) == (1, 2, 3)
    g = grid(spark, np.arange(8), (2, 2, 2))
    s = G.slice_scaled(g, "z", 1, 2.0)
    assert s.shape == (4, 4, 1) and set(values(s)) <= {4, 5, 6, 7} and len(values(s)) == 16
    o = Options(["--n=3", "--flag", "--list=a,b", "--extra=1"])
    assert o.get("n", 1) == 3 and o.get("flag", False) is True and o.files("list") == ["a", "b"] and o.get("other", 2.5) == 2.5 and o.unused() == ["extra"]
    with pytest.raises(ValueError):
        o.get("missing")
    with pytest.raises(ValueError):
        Options(["n=3"])
    c = color.value_to_color(g.df, color.palette(spark, (0, 0, 0), (255, 0, 0)), 0, 7).orderBy("idx").collect()
    assert c[0]["r"] == 0 and c[7]["r"] == 255 and c[7]["g"] == 0
    assert spark.range(1).select(F.round(color.hue(F.lit(0.0), F.lit(1.0), F.lit(0.0)), 4)).first()[0] == 2.0944


def waves(a, closes):
    """Opening or closing of one mask (z, y, x) by a queue of voxels, with counts kept up to date."""
    a = a.astype(int).copy()
    d, h, w = a.shape
    flat = d == 1
    half, top = (4, 4) if flat else (13, 8)

    def around(p):
        for dz in (0,) if flat else (-1, 0, 1):
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = (p[0] + dz, p[1] + dy, p[2] + dx)
                    if (dz, dy, dx) != (0, 0, 0) and 0 <= q[0] < d and 0 <= q[1] < h and 0 <= q[2] < w:
                        yield q

    for t in range(top, -1, -1):
        count = {p: a[p] + sum(a[q] for q in around(p)) for p in np.ndindex(a.shape)}
        hit = lambda p: (not a[p] and count[p] > half + t) if closes else (a[p] and count[p] < half - t)  # noqa: B023, E731
        queue, changed = [p for p in count if hit(p)], False
        while queue:
            changed = True
            for p in queue:
                a[p] = int(closes)
            seen = set()
            for p in queue:
                for q in around(p):
                    if bool(a[q]) != closes:
                        count[q] += 1 if closes else -1
                        seen.add(q)
            queue = [q for q in sorted(seen) if hit(q)]
        if changed:
            return a
    return a


def masks(spark, arrays):
    """Arrays (z, y, x) of one shape as the images of a grid."""
    d, h, w = arrays[0].shape
    rows = [(i, int(p[2]), int(p[1]), int(p[0]), int((p[0] * h + p[1]) * w + p[2]), int(v)) for i, a in enumerate(arrays) for p, v in np.ndenumerate(a)]
    return Grid(spark.createDataFrame(rows, "img long, x int, y int, z int, idx long, v int"), (w, h, d))


def arrays(g, n):
    w, h, d = g.shape
    rows = g.df.orderBy("img", "idx").collect()
    return np.array([r["v"] for r in rows]).reshape(n, d, h, w)


@pytest.mark.parametrize("closes", [False, True])
@pytest.mark.parametrize("depth", [1, 4])
def test_waves_by_hand(spark, closes, depth):
    rng = np.random.default_rng(7)
    some = [(rng.random((depth, 8, 9)) < p).astype(int) for p in (0.2, 0.5, 0.75, 0.9)]
    lone = np.zeros((depth, 8, 9), int)
    lone[0, 1, 1] = lone[0, 5, 4] = lone[0, 5, 5] = 1
    some += [lone, np.zeros_like(lone), np.ones_like(lone)]
    op = M.closing if closes else M.opening
    got = arrays(op(masks(spark, some)), len(some))
    for a, b in zip(some, got, strict=True):
        assert (b == waves(a, closes)).all()
    assert any((a != b).any() for a, b in zip(some, got, strict=True))
    if not closes and depth == 1:
        assert got[4].sum() == 2  # the lone voxel goes, the pair stays
    kept = arrays(op(masks(spark, [some[1] * 3])), 1)[0]
    assert ((kept == 3) <= (some[1] == 1)).all() and ((kept != 0) == (waves(some[1], closes) != 0)).all()


def by_label(a, op):
    """op on the mask of each label of one array, the highest label winning."""
    if a.max() <= 1:
        return op((a != 0).astype(int))
    out = np.zeros_like(a)
    for k in range(1, a.max() + 1):
        out[(op((a == k).astype(int)) != 0) & (out < k)] = k
    return out


def faces(a, erode):
    out = a.copy()
    for axis in range(3):
        for step in (1, -1):
            near = np.roll(a, step, axis)
            edge = [slice(None)] * 3
            edge[axis] = 0 if step == 1 else -1
            near[tuple(edge)] = a[tuple(edge)] if erode else 0
            out = np.minimum(out, near) if erode else np.maximum(out, near)
    return out


def edges_in_order(a):
    d, h, w = a.shape
    f, out = a.ravel(), np.zeros(a.size, int)
    for s in (1, w, w * h) if d > 1 else (1, w):
        i = np.flatnonzero(f[:-s] != f[s:])
        out[i] = out[i + s] = 1
    return out.reshape(a.shape)


@pytest.mark.parametrize(("op", "plain"), [(M.mask_dilation, lambda a: faces(a, False)), (M.mask_erosion, lambda a: faces(a, True)), (M.mask_opening, lambda a: waves(a, False)), (M.mask_closing, lambda a: waves(a, True)), (M.mask_edge, edges_in_order)])
def test_labels_of_several_images_by_hand(spark, op, plain):
    rng = np.random.default_rng(3)
    blocks = [np.kron(rng.integers(0, 4, (2, 3, 3)), np.ones((2, 3, 3), int)) for _ in range(2)] + [rng.integers(0, 2, (4, 9, 9)), rng.integers(-1, 3, (4, 9, 9)), np.zeros((4, 9, 9), int)]
    blocks[0][rng.random(blocks[0].shape) < 0.1] = 0
    got = arrays(M.for_each_label(masks(spark, blocks), op), len(blocks))
    for a, b in zip(blocks, got, strict=True):
        assert (b == by_label(a, plain)).all()


def test_smoothing_decides_by_image(spark):
    rng = np.random.default_rng(4)
    some = [rng.integers(0, 2, (3, 5, 6)), rng.integers(0, 4, (3, 5, 6))]
    both = arrays(M.smoothing_by_kind(masks(spark, some)), 2)
    assert (both[0] == arrays(M.smoothing(masks(spark, some[:1])), 1)[0]).all()
    assert (both[1] == arrays(M.smoothing_multiple_region(masks(spark, some[1:])), 1)[0]).all()


def test_every_label_has_its_mask(spark):
    n = 5_000
    df = spark.range(0, n, 1, 4).select(F.lit(3).cast("long").alias("img"), F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.col("id").alias("idx"), (F.col("id") + 1).alias("v"))
    got = M.for_each_label(Grid(df, (n, 1, 1)), lambda m: m).df
    assert sorted((r["img"], r["x"], r["v"]) for r in got.collect()) == [(3, k, k + 1) for k in range(n)]


def test_otsu_median_of_floats_and_of_zeros(spark):
    from gridloom.operators.histogram import normalize_otsu_median

    a = np.array([[[0.0, 1, 2, 9, 10, 11, 12, 0, 0, 0, 0, 0]]])
    rows = [(i, k, 0, 0, k, float(v) * s) for i, s in ((0, 1.0), (1, 0.0)) for k, v in enumerate(a.ravel())]
    g = Grid(spark.createDataFrame(rows, "img long, x int, y int, z int, idx long, v double"), (12, 1, 1))
    got = arrays(normalize_otsu_median(g), 2)
    assert got[0].max() <= 1.0 and abs(got[0].ravel()[4] - 0.5) < 1e-9 and (got[1] == 0).all()
