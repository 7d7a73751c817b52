"""Displacement fields: the search against plain loops over voxels, slabs against whole images."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.layout import AXES, from_arrays
from gridloom.operators import displacement as D


def grid(spark, images):
    """Images [z, y, x], numbered from 0."""
    d, h, w = images[0].shape
    rows = [(k, [float(v) for v in x.ravel()]) for k, x in enumerate(images)]
    return from_arrays(spark.createDataFrame(rows, "img long, data array<double>"), (w, h, d))


def field_of(df, img, shape):
    rows = df.where(F.col("img") == img).orderBy("idx").collect()
    return np.array([[r[c] for c in D.D] for r in rows]).reshape(*shape, 3)


def sample(f, p):
    """f linear at p = (x, y, z) in a full cell, None elsewhere."""
    n = f.shape[2::-1]
    low = [int(np.floor(v)) for v in p]
    if any(lo < 0 or lo + (1 if m > 1 else 0) >= m for lo, m in zip(low, n, strict=True)):
        return None
    total = 0.0
    for k in itertools.product(*[(0, 1) if m > 1 else (0,) for m in n]):
        w = np.prod([(v - lo if b else 1 - (v - lo)) if m > 1 else 1.0 for b, v, lo, m in zip(k, p, low, n, strict=True)])
        total = total + w * f[low[2] + k[2], low[1] + k[1], low[0] + k[0]]
    return total


def places(shape):
    return [(z, y, x) for z in range(shape[0]) for y in range(shape[1]) for x in range(shape[2])]


def force_by_hand(j, i, kind):
    g, cost = np.zeros((*j.shape, 3)), np.zeros(j.shape)
    for z, y, x in places(j.shape):
        at = (z, y, x)
        for a, axis in enumerate((2, 1, 0)):
            if 0 < at[axis] < j.shape[axis] - 1:
                step = np.eye(3, dtype=int)[axis]
                g[at][a] = j[tuple(at + step)] - j[tuple(at - step)]
        if kind == "d":
            g[at] *= j[at] - i[at]
            cost[at] = (j[at] - i[at]) ** 2
            continue
        box = tuple(slice(max(0, c - 2), c + 3) for c in at)
        p, q = j[box].ravel(), i[box].ravel()
        weight = 0.0
        if j[at] and i[at] and np.ptp(p) and np.ptp(q):
            cov = ((p - p.mean()) * (q - q.mean())).mean()
            a, r2 = cov / p.var(), cov * cov / p.var() / q.var()
            if a > 0:
                weight, cost[at] = r2 * (j[at] * a + q.mean() - a * p.mean() - i[at]), -r2
        g[at] *= weight
    return g, cost


def around(f, shape):
    """Sums of neighbours in storage order."""
    d, h, w = shape
    flat, out = f.reshape(-1, 3), np.zeros((d * h * w, 3))
    for s in (1, w, w * h) if d > 1 else (1, w):
        for n in range(len(flat)):
            if n >= s:
                out[n] += flat[n - s]
            if n + s < len(flat):
                out[n] += flat[n + s]
    return out.reshape(f.shape)


def poisson_by_hand(f, shape):
    share = -0.5 / (3 if shape[0] > 1 else 2)
    u = f * share
    for _ in range(12):
        u = (f - around(u, shape)) * share
    return u


def search_by_hand(fixed, moving, kinds, rounds, speed=0.3, smoothing=0.05, now=None):
    shape = fixed[0].shape
    dim = 3 if shape[0] > 1 else 2
    best = np.zeros((*shape, 3)) if now is None else now
    now, least, costs, ease, length = best, np.inf, [], 0.8, 0.0
    for r in range(rounds):
        push, cost = 0.0, 0.0
        for i, m, kind in zip(fixed, moving, kinds, strict=True):
            j = np.zeros(shape)
            for z, y, x in places(shape):
                v = sample(m, np.array([x, y, z]) + now[z, y, x])
                j[z, y, x] = 0.0 if v is None else v
            g, c = force_by_hand(j, i, kind)
            push, cost = push + g, cost + c.mean()
        if cost == 0:
            return best
        costs.append(cost / len(fixed))
        if costs[-1] < least:
            least, best = costs[-1], now if r else best
        if len(costs) > 5:
            if np.ptp(costs) and np.polyfit(range(len(costs)), costs, 1)[0] > 0:
                if ease <= smoothing:
                    return best
                now, ease, costs = best, ease / 2, []
            elif len(costs) > 7:
                costs.pop(0)
        u = poisson_by_hand(push, shape)
        length = length or np.sqrt((u * u).sum(-1)).max()
        if not length:
            return best
        u = u * (speed / length)
        new = np.zeros_like(now)
        for z, y, x in places(shape):
            h = sample(now, np.array([x, y, z]) + u[z, y, x])
            new[z, y, x] = now[z, y, x] if h is None else u[z, y, x] + h
        now = new * (1 - ease) + around(new, shape) * (ease / (2 * dim))
    return best


def blob(shape, x0, y0, z0=0.0, spread=4.0):
    z, y, x = np.mgrid[: shape[0], : shape[1], : shape[2]].astype(float)
    return 100 * np.exp(-((x - x0) ** 2 + (y - y0) ** 2 + (z - z0) ** 2) / spread) + 1


@pytest.mark.parametrize("kinds", ["r", "d", "rd"])
def test_forces_by_hand(spark, kinds):
    r = np.random.default_rng(3)
    j, i = [r.integers(0, 6, (4, 5, 7)).astype(float) for _ in kinds], [r.integers(0, 6, (4, 5, 7)).astype(float) for _ in kinds]
    j[0][:, :, :4] = 3.0  # flat windows
    got = D.forces([grid(spark, [x]) for x in j], [grid(spark, [x]) for x in i], kinds)
    want = [force_by_hand(a, b, k) for a, b, k in zip(j, i, kinds, strict=True)]
    np.testing.assert_allclose(field_of(got, 0, (4, 5, 7)), sum(w[0] for w in want), atol=1e-9)
    assert np.isclose(got.agg(F.avg("cost")).first()[0], sum(w[1].mean() for w in want) / len(kinds))
    with pytest.raises(ValueError, match="kind"):
        D.force(grid(spark, j[:1]), grid(spark, i[:1]), "x")


@pytest.mark.parametrize("shape", [(30, 3, 4), (1, 40, 5)])
def test_slabs_agree_with_whole_images(spark, shape):
    f = np.random.default_rng(1).normal(size=(*shape, 3)) * ((1, 1, 1) if shape[0] > 1 else (1, 1, 0))
    g = grid(spark, [np.zeros(shape)])
    rows = [(n, *map(float, v)) for n, v in enumerate(f.reshape(-1, 3))]
    df = g.df.drop("v").join(spark.createDataFrame(rows, "idx long, dx double, dy double, dz double"), "idx")
    for slab in (1, 50, D.SLAB):
        np.testing.assert_allclose(field_of(D.poisson(df, g, slab=slab), 0, shape), poisson_by_hand(f, shape), atol=1e-12)
    dim = 3 if shape[0] > 1 else 2
    np.testing.assert_allclose(field_of(D.smooth(df, g, 0.4, 1), 0, shape), f * 0.6 + around(f, shape) * 0.4 / (2 * dim), atol=1e-12)


def test_search_by_hand(spark):
    """Several images at once, which end in different rounds; one has nothing to find."""
    shape = (1, 9, 10)
    fixed = [blob(shape, 4, 4), blob(shape, 5, 4, spread=6.0), np.zeros(shape)]
    moving = [blob(shape, 5, 4), blob(shape, 5, 5, spread=6.0), blob(shape, 4, 4)]
    got = D.search([grid(spark, fixed)], [grid(spark, moving)], D.Search("r", rounds=9))
    for k in range(3):
        want = search_by_hand([fixed[k]], [moving[k]], "r", 9)
        np.testing.assert_allclose(field_of(got, k, shape), want, atol=1e-9)
    assert not field_of(got, 2, shape).any()


def test_search_of_two_kinds_in_volumes(spark):
    shape = (5, 6, 7)
    fixed, moving = [blob(shape, 3, 3, 2), blob(shape, 2, 3, 2)], [blob(shape, 4, 3, 2), blob(shape, 3, 3, 2)]
    got = D.search([grid(spark, [x]) for x in fixed], [grid(spark, [x]) for x in moving], D.Search("rd", rounds=3, slab=1))
    np.testing.assert_allclose(field_of(got, 0, shape), search_by_hand(fixed, moving, "rd", 3), atol=1e-9)


def test_smoothing_eases_until_costs_stand():
    p = D.Progress(0.8)
    p.costs = [5.0, 4.0, 3.0, 2.0, 1.0, 1.0, 1.0, 1.0]
    assert p.improves() and len(p.costs) == 7
    p.costs = [1.0, 1.0, 1.0, 1.0, 1.0, 2.0]
    assert not p.improves()
    p.costs = [1.0] * 6
    assert p.improves()


def test_levels(spark):
    """Halved while the shortest side is above min_dimension; the finest level is only interpolated at resolution 2."""
    shape = (1, 12, 14)
    fixed, moving = blob(shape, 6, 6, spread=12.0), blob(shape, 8, 6, spread=12.0)
    f, m = [grid(spark, [fixed])], [grid(spark, [moving])]
    half = lambda x: x.reshape(1, 6, 2, 7, 2).mean((2, 4))
    coarse = search_by_hand([half(fixed)], [half(moving)], "r", 4)
    up = np.zeros((*shape, 3))
    for z, y, x in places(shape):
        v = sample(coarse, np.array([x / 2, y / 2, 0]))
        up[z, y, x] = 0.0 if v is None else v * 2
    got = D.search(f, m, D.Search(min_dimension=8, rounds=4))
    np.testing.assert_allclose(field_of(got, 0, shape), up, atol=1e-9)
    fine = D.search(f, m, D.Search(min_dimension=8, rounds=4, resolution=1.0))
    np.testing.assert_allclose(field_of(fine, 0, shape), search_by_hand([fixed], [moving], "r", 4, now=up), atol=1e-9)
    assert set(fine.columns) == {"img", *AXES, "idx", *D.D}


def test_fields_between_spaces(spark):
    """An affine field there and back, over other voxel sizes and axes; and the plain ratio of sizes where axes agree."""
    from dataclasses import replace

    old = np.array([[1.0, 0, 0, 0], [0, 1.5, 0, 0], [0, 0, 2, 0], [0, 0, 0, 1]])
    new = np.array([[0.0, -1.2, 0, 10.4], [1.5, 0, 0, 1.7], [0, 0, 1.6, 1.3], [0, 0, 0, 1]])
    g = replace(grid(spark, [np.zeros((8, 10, 13))]), affine=tuple(old.ravel()))
    a, b = np.array([[0.1, -0.2, 0.05], [0.3, 0.1, -0.1], [0.02, 0.04, 0.2]]), np.array([1.0, -2.0, 0.5])
    at = {d: sum((F.col(c) * float(a[k, j]) for j, c in enumerate(AXES)), F.lit(float(b[k]))) for k, d in enumerate(D.D)}
    dis = g.df.select("img", *AXES, "idx", *[c.alias(d) for d, c in at.items()])
    h = replace(grid(spark, [np.zeros((7, 8, 7))]), affine=tuple(new.ravel()))
    there = D.to_space(dis, g, h.shape, new.ravel())
    f = field_of(there, 0, (7, 8, 7))
    inside = 0
    for z, y, x in places((7, 8, 7)):
        p = (np.linalg.inv(old) @ new @ [x, y, z, 1])[:3]
        if all(0 <= np.floor(v) and np.floor(v) + 1 < n for v, n in zip(p, g.shape, strict=True)):
            inside += 1
            assert np.allclose(new[:3, :3] @ f[z, y, x], old[:3, :3] @ (a @ p + b), atol=1e-9)
    assert inside > 100
    back, want = field_of(D.to_space(there, h, g.shape, old.ravel()), 0, (8, 10, 13)), field_of(dis, 0, (8, 10, 13))
    met = 0
    for z, y, x in places((8, 10, 13)):
        p = (np.linalg.inv(new) @ old @ [x, y, z, 1])[:3]
        cell = [int(np.floor(v)) for v in p]
        if all(0 <= c and c + 1 < n for c, n in zip(cell, h.shape, strict=True)) and all(f[cell[2] + k, cell[1] + j, cell[0] + i].any() for i, j, k in itertools.product((0, 1), repeat=3)):
            met += 1
            assert np.allclose(back[z, y, x], want[z, y, x], atol=1e-6)
    assert met > 50
    cubes = D.to_space(dis, replace(g, affine=tuple(np.eye(4).ravel())), (6, 5, 4), np.diag([2.0, 2, 2, 1]).ravel())
    np.testing.assert_allclose(field_of(cubes, 0, (4, 5, 6))[1, 1, 1], (a @ [2, 2, 2] + b) / 2)
