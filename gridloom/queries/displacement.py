"""Forces, sweeps and smoothing of displacement fields; each volume is held against the next one."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import VOL_SQL, vol
from ..layout import AXES
from ..operators import displacement as D
from .registry import Registry

REG = Registry()

PAIR_SQL = f"""{VOL_SQL},
p AS (SELECT a.img, a.x, a.y, a.z, a.idx, b.v::DOUBLE AS j, a.v::DOUBLE AS i FROM vol a JOIN vol b ON b.img = (a.img + 1) % 4 AND b.idx = a.idx)"""

#: Central differences of j; 0 where a voxel lacks one of its two neighbours.
GRADIENT_SQL = """e AS (SELECT *,
    coalesce(lead(j) OVER (PARTITION BY img, y, z ORDER BY x) - lag(j) OVER (PARTITION BY img, y, z ORDER BY x), 0) AS gx,
    coalesce(lead(j) OVER (PARTITION BY img, x, z ORDER BY y) - lag(j) OVER (PARTITION BY img, x, z ORDER BY y), 0) AS gy,
    coalesce(lead(j) OVER (PARTITION BY img, x, y ORDER BY z) - lag(j) OVER (PARTITION BY img, x, y ORDER BY z), 0) AS gz FROM p)"""

#: The regression of i on j over the clipped window of 5 voxels an axis.
WINDOW_SQL = """w AS (SELECT p.img, p.idx, regr_slope(q.i, q.j) AS a, regr_intercept(q.i, q.j) AS b, regr_r2(q.i, q.j) AS r2
    FROM p JOIN p q ON q.img = p.img AND q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2 AND q.z BETWEEN p.z - 2 AND p.z + 2
    GROUP BY p.img, p.idx),
f AS (SELECT e.*, CASE WHEN a > 0 AND i <> 0 AND j <> 0 THEN r2 * (a * j + b - i) ELSE 0 END AS weight,
    CASE WHEN a > 0 AND i <> 0 AND j <> 0 THEN -r2 ELSE 0 END AS cost FROM e JOIN w ON w.img = e.img AND w.idx = e.idx)"""

FORCE_SQL = """SELECT img, x, y, z, round(gx * weight, 4) + 0.0 AS dx, round(gy * weight, 4) + 0.0 AS dy, round(gz * weight, 4) + 0.0 AS dz,
    round(cost, 6) + 0.0 AS cost FROM f"""


def _next(g):
    """Each volume's voxels under the number of the one before it."""
    return g.with_df(g.df.withColumn("img", (F.col("img") + 3) % 4))


def _out(df, digits: int, *more):
    return df.select("img", *AXES, *[(F.round(c, digits) + 0.0).alias(c) for c in D.D], *more)


@REG("reg_displacement_force", f"WITH {PAIR_SQL}, {GRADIENT_SQL}, {WINDOW_SQL} {FORCE_SQL}")
def force(spark, sf_dir):
    g = vol(spark, sf_dir)
    return _out(D.force(_next(g), g, "r"), 4, (F.round("cost", 6) + 0.0).alias("cost"))


@REG(
    "reg_displacement_force_difference",
    f"WITH {PAIR_SQL}, {GRADIENT_SQL}, f AS (SELECT *, j - i AS weight, (j - i) * (j - i) AS cost FROM e) {FORCE_SQL}",
)
def force_difference(spark, sf_dir):
    g = vol(spark, sf_dir)
    return _out(D.force(_next(g), g, "d"), 4, (F.round("cost", 6) + 0.0).alias("cost"))


@REG(
    "reg_displacement_kinds",
    f"""WITH {PAIR_SQL}, {GRADIENT_SQL}, {WINDOW_SQL},
h AS (SELECT *, weight + (j - i) AS total, (cost + (j - i) * (j - i)) / 2 AS mean FROM f)
SELECT img, x, y, z, round(gx * total, 4) + 0.0 AS dx, round(gy * total, 4) + 0.0 AS dy, round(gz * total, 4) + 0.0 AS dz,
    round(mean, 6) + 0.0 AS cost FROM h""",
)
def kinds(spark, sf_dir):
    """Two kinds of image (here the same one twice), one force by regression and one by difference."""
    g = vol(spark, sf_dir)
    return _out(D.forces([_next(g)] * 2, [g] * 2, "rd"), 4, (F.round("cost", 6) + 0.0).alias("cost"))


#: A field with whole components from the volumes' values.
FIELD_SQL = f"{VOL_SQL}, f AS (SELECT img, x, y, z, idx, (v % 7 - 3)::DOUBLE AS dx, (v % 5 - 2)::DOUBLE AS dy, (v % 3 - 1)::DOUBLE AS dz FROM vol)"


def _field(g):
    part = lambda n: (F.col("v") % n - n // 2).cast("double")
    return g.df.select("img", *AXES, "idx", part(7).alias("dx"), part(5).alias("dy"), part(3).alias("dz"))


def _around(c: str) -> str:
    """The sum of the face neighbours in storage order of 16 x 12 planes."""
    near = [f"coalesce({way}({c}, {s}) OVER s, 0)" for s in (1, 16, 192) for way in ("lag", "lead")]
    return "(" + " + ".join(near) + ")"


def _sweeps(n: int) -> str:
    out = ["u0 AS (SELECT img, x, y, z, idx, dx, dy, dz, -dx / 6 AS ux, -dy / 6 AS uy, -dz / 6 AS uz FROM f)"]
    for k in range(n):
        each = ", ".join(f"(d{a} - {_around('u' + a)}) / -6 AS u{a}" for a in AXES)
        out.append(f"u{k + 1} AS (SELECT img, x, y, z, idx, dx, dy, dz, {each} FROM u{k} WINDOW s AS (PARTITION BY img ORDER BY idx))")
    return ", ".join(out)


@REG(
    "reg_displacement_poisson",
    f"WITH {FIELD_SQL}, {_sweeps(D.SWEEPS)} SELECT img, x, y, z, " + ", ".join(f"round(u{a}, 6) + 0.0 AS d{a}" for a in AXES) + f" FROM u{D.SWEEPS}",
)
def poisson(spark, sf_dir):
    g = vol(spark, sf_dir)
    return _out(D.poisson(_field(g), g), 6)


@REG(
    "reg_displacement_smooth",
    f"WITH {FIELD_SQL} SELECT img, x, y, z, "
    + ", ".join(f"round(d{a} * 0.2::DOUBLE + {_around('d' + a)} * 0.8::DOUBLE / 6, 6) + 0.0 AS d{a}" for a in AXES)
    + " FROM f WINDOW s AS (PARTITION BY img ORDER BY idx)",
)
def smooth(spark, sf_dir):
    g = vol(spark, sf_dir)
    return _out(D.smooth(_field(g), g, 0.8), 6)


@REG("reg_displacement_length", f"WITH {FIELD_SQL} SELECT img, round(max(sqrt(dx * dx + dy * dy + dz * dz)), 9) AS length FROM f GROUP BY img")
def length(spark, sf_dir):
    return D.largest(_field(vol(spark, sf_dir))).select("img", F.round("length", 9).alias("length"))


def _shifted(a: str) -> str:
    """Component a of the field f, linear at the place (px, py, pz) of a full cell."""
    return f"sum(w * f.d{a}) AS h{a}"


@REG(
    "reg_displacement_follow",
    f"""WITH {FIELD_SQL},
n AS (SELECT img, x, y, z, dx / 4 AS sx, dy / 8 AS sy, dz / 2 AS sz, x + dx / 4 AS px, y + dy / 8 AS py, z + dz / 2 AS pz FROM f),
c AS (SELECT n.*, floor(px) + a.a AS cx, floor(py) + b.b AS cy, floor(pz) + c.c AS cz,
    abs(1 - a.a - (px - floor(px))) * abs(1 - b.b - (py - floor(py))) * abs(1 - c.c - (pz - floor(pz))) AS w
    FROM n, range(2) a(a), range(2) b(b), range(2) c(c)
    WHERE floor(px) BETWEEN 0 AND 14 AND floor(py) BETWEEN 0 AND 10 AND floor(pz) BETWEEN 0 AND 5),
h AS (SELECT c.img, c.x, c.y, c.z, any_value(sx) AS sx, any_value(sy) AS sy, any_value(sz) AS sz, {', '.join(_shifted(a) for a in AXES)}
    FROM c JOIN f ON f.img = c.img AND f.x = cx AND f.y = cy AND f.z = cz GROUP BY c.img, c.x, c.y, c.z)
SELECT f.img, f.x, f.y, f.z, {', '.join(f'round(coalesce(s{a} + h{a}, d{a}), 6) + 0.0 AS d{a}' for a in AXES)}
FROM f LEFT JOIN h ON h.img = f.img AND h.x = f.x AND h.y = f.y AND h.z = f.z""",
)
def follow(spark, sf_dir):
    """A field after a shorter one: fractions of its own components, sampled linearly."""
    g = vol(spark, sf_dir)
    now = _field(g)
    new = now.select("img", *AXES, "idx", (F.col("dx") / 4).alias("dx"), (F.col("dy") / 8).alias("dy"), (F.col("dz") / 2).alias("dz"))
    return _out(D.follow(new, now, g), 6)


OLD = [1.0, 0, 0, 0, 0, 1.5, 0, 0, 0, 0, 2.0, 0, 0, 0, 0, 1.0]
#: Other voxel sizes, x and y exchanged and one of them turned round.
NEW = [0.0, -1.2, 0, 12.3, 1.5, 0, 0, 0.4, 0, 0, 1.6, 0.3, 0, 0, 0, 1.0]
NEW_SHAPE = (10, 11, 7)


def _sums(rows, cols) -> list[str]:
    return [" + ".join(f"({float(v)!r}::DOUBLE) * {c}" for v, c in zip(r, cols, strict=True)) for r in rows]


def _space_sql() -> str:
    old, new = (np.array(m).reshape(4, 4) for m in (OLD, NEW))
    px, py, pz = _sums((np.linalg.inv(old) @ new)[:3], ("x", "y", "z", "1"))
    d = _sums(np.linalg.inv(new[:3, :3]) @ old[:3, :3], ("hx", "hy", "hz"))
    w, h, n = NEW_SHAPE
    return f"""WITH {FIELD_SQL}, t AS (SELECT i.i AS img, CAST(n.n % {w} AS INT) AS x, CAST((n.n // {w}) % {h} AS INT) AS y, CAST(n.n // {w * h} AS INT) AS z
    FROM range(4) i(i), range({w * h * n}) n(n)),
q AS (SELECT *, {px} AS px, {py} AS py, {pz} AS pz FROM t),
c AS (SELECT q.*, floor(px) + a.a AS cx, floor(py) + b.b AS cy, floor(pz) + c.c AS cz,
    abs(1 - a.a - (px - floor(px))) * abs(1 - b.b - (py - floor(py))) * abs(1 - c.c - (pz - floor(pz))) AS w
    FROM q, range(2) a(a), range(2) b(b), range(2) c(c)
    WHERE floor(px) BETWEEN 0 AND 14 AND floor(py) BETWEEN 0 AND 10 AND floor(pz) BETWEEN 0 AND 5),
h AS (SELECT c.img, c.x, c.y, c.z, {', '.join(_shifted(a) for a in AXES)} FROM c JOIN f ON f.img = c.img AND f.x = cx AND f.y = cy AND f.z = cz GROUP BY ALL)
SELECT t.img, t.x, t.y, t.z, {', '.join(f'round(coalesce({e}, 0), 6) + 0.0 AS d{a}' for a, e in zip(AXES, d, strict=True))}
FROM t LEFT JOIN h ON h.img = t.img AND h.x = t.x AND h.y = t.y AND h.z = t.z"""


@REG("res_displacement_to_space", _space_sql())
def to_space(spark, sf_dir):
    g = replace(vol(spark, sf_dir), affine=tuple(OLD))
    return _out(D.to_space(_field(g), g, NEW_SHAPE, NEW), 6)
