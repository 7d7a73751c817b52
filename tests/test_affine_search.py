"""Affine search: starts from moments, matrices, bounds, costs by both ways, and what is found again."""

from dataclasses import replace

import numpy as np
import pytest

from gridloom.layout import from_arrays
from gridloom.operators import affine_search as S


def grid(spark, images, vs=(1.0, 1.0, 1.0)):
    images = images if isinstance(images, list) else [images]
    d, h, w = images[0].shape
    g = from_arrays(spark.createDataFrame([(k, [float(v) for v in x.ravel()]) for k, x in enumerate(images)], "img long, data array<double>"), (w, h, d))
    return replace(g, vs=vs)


def shape_at(shape, vs, centre, widths, angle=0.0):
    """A smooth ellipsoid in voxel sizes."""
    z, y, x = np.mgrid[: shape[0], : shape[1], : shape[2]].astype(float)
    x, y, z = x * vs[0] - centre[0], y * vs[1] - centre[1], z * vs[2] - centre[2]
    x, y = x * np.cos(angle) - y * np.sin(angle), x * np.sin(angle) + y * np.cos(angle)
    return 200 * np.exp(-(x / widths[0]) ** 2 - (y / widths[1]) ** 2 - (z / widths[2]) ** 2)


def test_matrix_takes_centre_to_centre(spark):
    f, m = grid(spark, np.zeros((4, 6, 8)), (1.0, 2.0, 3.0)), grid(spark, np.zeros((5, 7, 9)), (2.0, 1.0, 0.5))
    at = lambda p, x: (np.array(S.matrix(p, f, m)).reshape(3, 4) @ [*x, 1]) * m.vs
    middle = np.array([4.0, 3, 2])
    assert np.allclose(at(S.NONE, middle), np.array([9, 7, 5]) / 2 * m.vs)
    p = np.array([1.0, -2, 0.5, 0.2, -0.1, 0.3, 1.1, 0.9, 1.2, 0.05, -0.04, 0.02])
    assert np.allclose(at(p, middle + 1) - at(p, middle), S.turn(p, 3) @ f.vs)
    assert np.allclose(at(p, middle) - np.array([9, 7, 5]) / 2 * m.vs, S.turn(p, 3) @ p[:3])
    x, y, z = 0.2, -0.1, 0.3
    first = [np.cos(y) * np.cos(z), np.cos(y) * np.sin(z), -np.sin(y)]
    assert np.allclose(S.turn(np.array([0, 0, 0, x, y, z, 1, 1, 1, 0, 0, 0.0]), 3)[0], first)
    flat = replace(f, shape=(8, 6, 1))
    assert np.allclose(S.turn(np.array([0, 0, 0, 0.3, 0, 0, 1, 1, 1, 0, 0, 0.0]), flat.dim)[0], [np.cos(0.3), -np.sin(0.3), 0])


def test_moments_and_start(spark):
    vs, to = (1.0, 1.5, 2.0), (2.0, 1.0, 1.0)
    a = shape_at((12, 16, 24), vs, (11, 12, 11), (6, 4, 3)) - 20
    b = shape_at((24, 26, 14), to, (15, 12, 12), (6.6, 4.4, 3.3)) - 20
    f, m = grid(spark, a, vs), grid(spark, b, to)
    row = S.moments(f).first()
    k = np.argwhere(a > 0)[:, ::-1] * vs
    assert row["n"] == len(k) and np.allclose([row["cx"], row["cy"], row["cz"]], k.mean(0))
    assert np.allclose([row["cxx"], row["cxy"], row["czz"]], np.cov(k.T, bias=True)[[0, 0, 2], [0, 1, 2]])
    p = S.moment_start(f, m)
    assert np.allclose(p[6:9], 1.1, atol=0.06) and np.allclose(p[3:6], 0, atol=0.05)
    back = np.array(S.matrix(p, f, m)).reshape(3, 4) @ [*(np.array([row["cx"], row["cy"], row["cz"]]) / vs), 1]
    to_ = S.moments(m).first()
    assert np.allclose(back * to, [to_["cx"], to_["cy"], to_["cz"]], atol=0.3)
    assert S.moment_start(f, grid(spark, -np.ones((3, 3, 3)))) == S.NONE.tolist()
    two = grid(spark, [a, np.roll(a, 2, 2)], vs)
    both = np.concatenate([np.argwhere(x > 0)[:, ::-1] * vs for x in (a, np.roll(a, 2, 2))])
    pooled = S.moments(two).groupBy().agg(*S._pooled()).first()
    assert np.isclose(pooled["cx"], both[:, 0].mean()) and np.isclose(pooled["cxx"], both[:, 0].var())


def test_limits(spark):
    f, m = grid(spark, np.zeros((4, 6, 8)), (1.0, 2.0, 3.0)), grid(spark, np.zeros((5, 7, 9)), (2.0, 1.0, 0.5))
    low, high = S.limits(f, m, "affine")
    assert np.allclose(high[:3], 0.75 * np.array([18, 12, 12]) / 2) and np.allclose(low[:3], -high[:3])
    assert np.allclose(high[3:6], np.pi / 2 * np.array([0.4, 0.25, 0.25])) and high[6] == 1.5 and low[6] == 0.7 and high[9] == 0.1
    low, high = S.limits(f, m, "rigid", S.NARROW, [1.0] * 3 + [0.0] * 3 + [1.2] * 3 + [0.0] * 3)
    assert high[6] == low[6] == 1.2 and np.isclose(high[0], 1 + 0.2 * 9) and high[9] == 0
    lo, hi = S.stage_limits(np.full(12, 0.5), low, high, "translocation")
    assert (lo[3:] == 0.5).all() and (hi[3:] == 0.5).all() and hi[0] == high[0]
    flat = grid(spark, np.zeros((1, 6, 8)))
    low, high = S.limits(flat, flat, "affine")
    assert np.flatnonzero(high > low).tolist() == [0, 1, 3, 6, 7, 9]


@pytest.mark.parametrize("cost", ["correlation", "information"])
def test_costs_by_both_ways_and_by_hand(spark, cost):
    r = np.random.default_rng(5)
    fixed, moving = ([r.integers(0, 256, (4, 6, 7)).astype(float) for _ in range(2)] for _ in range(2))
    f, m = grid(spark, fixed, (1.0, 1.0, 2.0)), grid(spark, moving, (1.5, 1.0, 2.0))
    sets = [S.NONE, np.array([0.7, -0.4, 0.3, 0.1, 0.05, -0.2, 1.1, 0.95, 1.0, 0.03, 0, -0.02]), np.array([90.0, 0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0])]
    ms = [S.matrix(p, f, m) for p in sets]
    near, far = S.Pair.of(f, m), S.Pair.of(f, m, 0)
    assert near.sent is not None and far.sent is None
    got = [{x["i"]: x["cost"] for x in S.COSTS[cost](p, ms).collect()} for p in (near, far)]
    for i, one in enumerate(ms):
        a, b = [], []
        for x, y in zip(fixed, moving, strict=True):
            for z, v, u in np.ndindex(x.shape):
                at = np.array(one).reshape(3, 4) @ [u, v, z, 1]
                low = np.floor(at).astype(int)
                value = 0.0
                if (low >= 0).all() and (low + 1 < y.shape[::-1]).all():
                    for c in np.ndindex(2, 2, 2):
                        value += np.prod([q - lo if k else 1 - (q - lo) for k, q, lo in zip(c, at, low, strict=True)]) * y[low[2] + c[2], low[1] + c[1], low[0] + c[0]]
                a.append(x[z, v, u])
                b.append(value)
        a, b = np.array(a), np.array(b)
        if cost == "correlation":
            want = 1.0 if not b.std() else 1 - np.corrcoef(a, b)[0, 1] ** 2
        else:
            h = np.zeros((256, 256))
            np.add.at(h, (a.astype(int), np.floor(b + 1e-9).astype(int)), 1)
            p, q = np.nonzero(h)
            want = -(h[p, q] * np.log(h[p, q] / h.sum(1)[p] / h.sum(0)[q])).sum() / 65536
        assert np.isclose(got[0][i], want) and np.isclose(got[1][i], want)


@pytest.mark.parametrize("cost", ["correlation", "information"])
def test_an_anisotropic_pair_is_found_again(spark, cost):
    vs, to = (1.0, 1.5, 2.0), (1.25, 1.0, 2.0)
    f = grid(spark, shape_at((10, 14, 20), vs, (10, 10, 10), (6, 4, 4)), vs)
    m = grid(spark, shape_at((10, 22, 18), to, (12.5, 10.0, 11.0), (6, 4, 4)), to)
    p, value = S.search([f], [m], S.AffineSearch("translocation", cost, samples=17, rounds=15))
    there = (np.array(S.matrix(p, f, m)).reshape(3, 4) @ [10, 10 / 1.5, 5, 1]) * to
    assert np.abs((there - [12.5, 10.0, 11.0]) / to).max() < 0.1
    pairs = [S.Pair.of(*(S.to_bytes(g) if cost == "information" else g for g in (f, m)))]
    assert np.isclose(value, S.costs(pairs, cost, [p])[0]) and value < S.costs(pairs, cost, [S.NONE])[0]


def test_two_kinds_and_levels(spark):
    a = shape_at((1, 24, 28), (1, 1, 1), (13, 11, 0), (5, 4, 9))
    b = shape_at((1, 24, 28), (1, 1, 1), (15, 12, 0), (5, 4, 9))
    f, m = [grid(spark, a), grid(spark, 255 - a)], [grid(spark, b), grid(spark, 255 - b)]
    options = S.AffineSearch("translocation", "correlation", samples=0, rounds=15, halved_from=16)
    p, _ = S.search(f, m, options)
    assert np.abs(p[:2] - [2, 1]).max() < 0.1 and (p[2:] == S.NONE[2:]).all()
    coarse, _ = S.search(f, m, replace(options, enough_from=20))  # the finest level is left out
    assert np.abs(coarse[:2] - [2, 1]).max() < 0.5
    moved = S.aligned(f[0], m[0], p).df.orderBy("idx").collect()
    inner = [(r["x"], r["y"]) for r in moved if 3 < r["x"] < 24 and 3 < r["y"] < 20]
    got = {(r["x"], r["y"]): r["v"] for r in moved}
    assert max(abs(got[x, y] - a[0, y, x]) for x, y in inner) < 8
