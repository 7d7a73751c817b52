"""Moments of the volumes and costs of transforms between each volume and the next."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..fixtures import VOL_SQL, vol
from ..layout import AXES
from ..operators import affine_search as S
from .registry import Registry

REG = Registry()
VS = (1.0, 1.5, 2.5)
#: Parameter sets: none, a shift, a shift with angles, scaling and shear.
SETS = [
    [0, 0, 0, 0, 0, 0, 1, 1, 1, 0, 0, 0],
    [1.25, -0.75, 0.5, 0, 0, 0, 1, 1, 1, 0, 0, 0],
    [0.5, 0.25, -0.5, 0.05, -0.04, 0.1, 1.1, 0.9, 1.05, 0.05, -0.02, 0.03],
]


def _moving(g):
    """Each volume under the number of the one before it."""
    return g.with_df(g.df.withColumn("img", (F.col("img") + 3) % 4))


def _grids(spark, sf_dir):
    g = replace(vol(spark, sf_dir), vs=VS)
    return g, replace(_moving(g), vs=(1.0, 1.0, 2.0))


@REG(
    "reg_moments",
    f"""WITH {VOL_SQL}, p AS (SELECT img, x * 1.0::DOUBLE AS x, y * 1.5::DOUBLE AS y, z * 2.5::DOUBLE AS z FROM vol WHERE v > 300)
SELECT img, count(*) AS n, {', '.join(f'round(avg({a}), 6) AS c{a}' for a in AXES)},
    {', '.join(f'round(covar_pop({a}, {b}), 6) + 0.0 AS c{a}{b}' for i, a in enumerate(AXES) for b in AXES[i:])} FROM p GROUP BY img""",
)
def moments(spark, sf_dir):
    """Of the voxels above 300."""
    g, _ = _grids(spark, sf_dir)
    m = S.moments(g.map(F.col("v") - 300))
    return m.select("img", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in m.columns[2:]])


def _m(k: int) -> list[float]:
    from ..layout import Grid

    like = lambda vs: Grid(None, (16, 12, 7), vs)
    return S.matrix(SETS[k], like(VS), like((1.0, 1.0, 2.0)))


def _place(k: int, r: int) -> str:
    m = _m(k)[4 * r : 4 * r + 4]
    return " + ".join(f"({v!r}::DOUBLE) * {c}" for v, c in zip(m, ("x", "y", "z", "1"), strict=True))


#: (i, img, idx, a, b): what each transform finds, 0 outside.
SAMPLES_SQL = f"""{VOL_SQL}, t AS ({' UNION ALL '.join(f"SELECT {k} AS i, img, idx, v, {', '.join(f'{_place(k, r)} AS p{a}' for r, a in enumerate(AXES))} FROM vol" for k in range(len(SETS)))}),
c AS (SELECT i, img, idx, floor(px) + a.a AS cx, floor(py) + b.b AS cy, floor(pz) + k.k AS cz,
    abs(1 - a.a - (px - floor(px))) * abs(1 - b.b - (py - floor(py))) * abs(1 - k.k - (pz - floor(pz))) AS w
    FROM t, range(2) a(a), range(2) b(b), range(2) k(k)
    WHERE floor(px) BETWEEN 0 AND 14 AND floor(py) BETWEEN 0 AND 10 AND floor(pz) BETWEEN 0 AND 5),
h AS (SELECT i, c.img, c.idx, sum(w * v.v) AS b FROM c JOIN SRC v ON v.img = (c.img + 1) % 4 AND v.x = cx AND v.y = cy AND v.z = cz GROUP BY i, c.img, c.idx),
s AS (SELECT t.i, t.img, t.idx, f.v AS a, coalesce(h.b, 0) AS b FROM t JOIN SRC f ON f.img = t.img AND f.idx = t.idx
    LEFT JOIN h ON h.i = t.i AND h.img = t.img AND h.idx = t.idx)"""

BYTES_SQL = """bytes AS (SELECT vol.img, x, y, z, idx, CAST(floor((v - lo) * 255.99::DOUBLE / (hi - lo)) AS BIGINT) AS v
    FROM vol JOIN (SELECT img, min(v) AS lo, max(v) AS hi FROM vol GROUP BY img) e ON e.img = vol.img)"""


@REG("reg_correlation_costs", f"WITH {SAMPLES_SQL.replace('SRC', 'vol')} SELECT CAST(i AS INT) AS i, round(1 - corr(a, b) * corr(a, b), 9) AS cost FROM s GROUP BY i")
def correlation_costs(spark, sf_dir):
    f, m = _grids(spark, sf_dir)
    return S.correlation_of(S.Pair.of(f, m), [_m(k) for k in range(len(SETS))]).select("i", F.round("cost", 9).alias("cost"))


@REG(
    "reg_information_costs",
    f"""WITH {SAMPLES_SQL.replace('SRC', 'bytes').replace(', t AS', f', {BYTES_SQL}, t AS', 1)},
j AS (SELECT i, a AS p, floor(b + 1e-9) AS q, count(*) AS n FROM s GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY i, p) AS np, sum(n) OVER (PARTITION BY i, q) AS nq FROM j)
SELECT CAST(i AS INT) AS i, round(-sum(n * ln(n::DOUBLE / np / nq)) / 65536, 9) AS cost FROM k GROUP BY i""",
)
def information_costs(spark, sf_dir):
    f, m = (S.to_bytes(g) for g in _grids(spark, sf_dir))
    return S.information_of(S.Pair.of(f, m), [_m(k) for k in range(len(SETS))]).select("i", F.round("cost", 9).alias("cost"))
