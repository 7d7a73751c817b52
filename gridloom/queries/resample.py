"""Resampling, pyramids and displacement fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import VOL_SQL, vol
from ..operators import resample as R
from ..plans.commands import command
from .registry import Registry

REG = Registry()
OUT = ["img", "x", "y", "z"]


def _v(g, digits: int | None = 6):
    return g.df.select(*OUT, F.round("v", digits).alias("v") if digits is not None else "v")


def _targets(w: int, h: int, d: int) -> str:
    return f"t AS (SELECT i.i AS img, CAST(n.n % {w} AS INT) AS x, CAST((n.n // {w}) % {h} AS INT) AS y, CAST(n.n // {w * h} AS INT) AS z FROM range(4) i(i), range({w * h * d}) n(n))"


def _linear(shape: tuple[int, int, int], px: str, py: str, pz: str, out: str = "sum(w * v)") -> str:
    """Linear interpolation at (px, py, pz): floor cells that lie inside, eight corners, weighted."""
    return f"""{_targets(*shape)}, p AS (SELECT *, ({px})::DOUBLE AS px, ({py})::DOUBLE AS py, ({pz})::DOUBLE AS pz FROM t),
q AS (SELECT *, CAST(floor(px) AS INT) AS ix, CAST(floor(py) AS INT) AS iy, CAST(floor(pz) AS INT) AS iz FROM p WHERE floor(px) >= 0 AND floor(px) + 1 < 16 AND floor(py) >= 0 AND floor(py) + 1 < 12 AND floor(pz) >= 0 AND floor(pz) + 1 < 7),
c AS (SELECT q.*, a.a, b.b, k.k, (CASE WHEN a.a = 1 THEN px - ix ELSE 1 - (px - ix) END) * (CASE WHEN b.b = 1 THEN py - iy ELSE 1 - (py - iy) END) * (CASE WHEN k.k = 1 THEN pz - iz ELSE 1 - (pz - iz) END) AS w FROM q, range(2) a(a), range(2) b(b), range(2) k(k)),
r AS (SELECT c.img, c.x, c.y, c.z, c.w, vol.v, c.a + 2 * c.b + 4 * c.k AS k FROM c JOIN vol ON vol.img = c.img AND vol.x = c.ix + c.a AND vol.y = c.iy + c.b AND vol.z = c.iz + c.k WHERE c.w <> 0)"""


def _filled(value: str) -> str:
    return f"s AS (SELECT img, x, y, z, {value} AS v FROM r GROUP BY ALL) SELECT t.img, t.x, t.y, t.z, round(coalesce(s.v, 0), 6) AS v FROM t LEFT JOIN s ON s.img = t.img AND s.x = t.x AND s.y = t.y AND s.z = t.z"


@REG("res_linear", f"WITH {VOL_SQL}, {_linear((10, 9, 6), 'x * 1.5 + 0.25', 'y * 1.25 + 0.5', 'z + 0.75')}, {_filled('sum(w * v)')}")
def linear(spark, sf_dir):
    return _v(R.resample(vol(spark, sf_dir), (10, 9, 6), lambda x, y, z: (x * 1.5 + 0.25, y * 1.25 + 0.5, z + 0.75)))


@REG("res_affine", f"WITH {VOL_SQL}, {_linear((16, 12, 7), '0.75 * x + 0.25 * y + 1', '-0.25 * x + 0.75 * y + 2', 'z + 0.5')}, {_filled('sum(w * v)')}")
def affine(spark, sf_dir):
    return _v(R.resample_affine(vol(spark, sf_dir), (16, 12, 7), [0.75, 0.25, 0, 1, -0.25, 0.75, 0, 2, 0, 0, 1, 0.5]))


@REG("res_majority", f"WITH {VOL_SQL}, {_linear((10, 9, 6), 'x * 1.5 + 0.25', 'y * 1.25 + 0.5', 'z + 0.75').replace('vol.v,', 'vol.v % 5 AS v,')}, votes AS (SELECT img, x, y, z, v, sum(w) AS w, min(k) AS k FROM r GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY img, x, y, z ORDER BY round(w, 9) DESC, k) AS o FROM votes) SELECT t.img, t.x, t.y, t.z, coalesce(m.v, 0) AS v FROM t LEFT JOIN m ON m.img = t.img AND m.x = t.x AND m.y = t.y AND m.z = t.z AND m.o = 1")
def majority(spark, sf_dir):
    return _v(R.resample(vol(spark, sf_dir).map(F.col("v") % 5), (10, 9, 6), lambda x, y, z: (x * 1.5 + 0.25, y * 1.25 + 0.5, z + 0.75), "majority"), None)


@REG("res_nearest", f"WITH {VOL_SQL}, {_targets(10, 9, 6)} SELECT t.img, t.x, t.y, t.z, coalesce(vol.v, 0) AS v FROM t LEFT JOIN vol ON vol.img = t.img AND vol.x = floor(t.x * 1.5 + 0.25 + 0.5) AND vol.y = floor(t.y * 1.25 + 0.5 + 0.5) AND vol.z = floor(t.z + 0.75 + 0.5)")
def nearest(spark, sf_dir):
    return _v(R.resample(vol(spark, sf_dir), (10, 9, 6), lambda x, y, z: (x * 1.5 + 0.25, y * 1.25 + 0.5, z + 0.75), "nearest"), None)


_W = {-1: "((2 - {f}) * {f} - 1) * {f} * 0.5", 0: "((3 * {f} - 5) * {f} * {f} + 2) * 0.5", 1: "((4 - 3 * {f}) * {f} + 1) * {f} * 0.5", 2: "({f} - 1) * {f} * {f} * 0.5"}


def _tap(f: str, k: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} = {i} THEN {e.format(f=f)}" for i, e in _W.items()) + " END"


@REG("res_cubic", f"""WITH {VOL_SQL}, {_targets(10, 9, 6)}, p AS (SELECT *, x * 1.5::DOUBLE + 0.25 AS px, y * 1.25::DOUBLE + 0.5 AS py, z + 0.75::DOUBLE AS pz FROM t),
c AS (SELECT p.*, CAST(floor(px) + a.a AS INT) AS ix, CAST(floor(py) + b.b AS INT) AS iy, CAST(floor(pz) + k.k AS INT) AS iz, ({_tap('(px - floor(px))', 'a.a')}) * ({_tap('(py - floor(py))', 'b.b')}) * ({_tap('(pz - floor(pz))', 'k.k')}) AS w FROM p, range(-1, 3) a(a), range(-1, 3) b(b), range(-1, 3) k(k) WHERE px <= 16 AND py <= 12 AND pz <= 7),
s AS (SELECT c.img, c.x, c.y, c.z, sum(c.w * vol.v) AS v FROM c JOIN vol ON vol.img = c.img AND vol.x = least(greatest(c.ix, 0), 15) AND vol.y = least(greatest(c.iy, 0), 11) AND vol.z = least(greatest(c.iz, 0), 6) GROUP BY ALL)
SELECT t.img, t.x, t.y, t.z, round(coalesce(s.v, 0), 6) AS v FROM t LEFT JOIN s ON s.img = t.img AND s.x = t.x AND s.y = t.y AND s.z = t.z""")
def cubic(spark, sf_dir):
    return _v(R.resample(vol(spark, sf_dir), (10, 9, 6), lambda x, y, z: (x * 1.5 + 0.25, y * 1.25 + 0.5, z + 0.75), "cubic"))


@REG("res_fast", f"WITH {VOL_SQL}, {_targets(10, 9, 6)} SELECT t.img, t.x, t.y, t.z, vol.v FROM t JOIN vol ON vol.img = t.img AND vol.x = floor(0.5 + t.x * 15 / 9.0::DOUBLE) AND vol.y = floor(0.5 + t.y * 11 / 8.0::DOUBLE) AND vol.z = floor(0.5 + t.z * 6 / 5.0::DOUBLE)")
def fast(spark, sf_dir):
    return _v(R.fast_resample(vol(spark, sf_dir), (10, 9, 6)), None)


@REG("res_scale", f"WITH {VOL_SQL}, {_linear((9, 9, 5), 'x * (15 / 8.0::DOUBLE)', 'y * (11 / 8.0::DOUBLE)', 'z * (6 / 4.0::DOUBLE)')}, {_filled('sum(w * v)')}")
def scale(spark, sf_dir):
    return _v(R.scale(vol(spark, sf_dir), (9, 9, 5)))


@REG("cmd_translocate", f"WITH {VOL_SQL}, {_linear((16, 12, 7), 'x - 0.5', 'y - 0.25', 'z - 0.75')}, {_filled('sum(w * v)')}")
def translocate(spark, sf_dir):
    return _v(command(vol(spark, sf_dir), "translocate", "0.5 0.25 0.75"))


@REG("cmd_regrid", f"WITH {VOL_SQL}, {_linear((11, 8, 5), 'x * 1.5', 'y * 1.5', 'z * 1.5')}, {_filled('sum(w * v)')}")
def regrid(spark, sf_dir):
    return _v(command(vol(spark, sf_dir), "regrid", "1.5"))


@REG("cmd_transform", f"WITH {VOL_SQL}, {_linear((16, 12, 7), 'x * 0.5 + 1', 'y * 0.5 + 2', 'z * 0.5 + 0.5')}, {_filled('sum(w * v)')}")
def transform(spark, sf_dir):
    return _v(command(vol(spark, sf_dir), "transform", "0.5 0 0 1 0 0.5 0 2 0 0 0.5 0.5 0 0 0 1"))


@REG("cmd_upsampling", f"WITH {VOL_SQL}, n AS (SELECT *, CAST(coalesce(lead(v) OVER (PARTITION BY img, y, z ORDER BY x), v) AS BIGINT) AS nx FROM vol), ua AS (SELECT img, 2 * x + k.k AS x, y, z, CASE WHEN k.k = 0 THEN v ELSE (v + nx) / 2.0::DOUBLE END AS v FROM n, range(2) k(k)), ub AS (SELECT img, x, 2 * y + k.k AS y, z, CASE WHEN k.k = 0 THEN v ELSE (v + n) / 2.0::DOUBLE END AS v FROM (SELECT *, coalesce(lead(v) OVER (PARTITION BY img, x, z ORDER BY y), v) AS n FROM ua), range(2) k(k)) SELECT img, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(2 * z + k.k AS INT) AS z, CASE WHEN k.k = 0 THEN v ELSE (v + n) / 2.0::DOUBLE END AS v FROM (SELECT *, coalesce(lead(v) OVER (PARTITION BY img, x, y ORDER BY z), v) AS n FROM ub), range(2) k(k)")
def upsampling(spark, sf_dir):
    return _v(command(vol(spark, sf_dir), "upsampling"), None)


@REG("res_upsample_nearest", f"WITH {VOL_SQL} SELECT img, CAST(2 * x + a.a AS INT) AS x, CAST(2 * y + b.b AS INT) AS y, CAST(2 * z + c.c AS INT) AS z, v FROM vol, range(2) a(a), range(2) b(b), range(2) c(c)")
def upsample_nearest(spark, sf_dir):
    return _v(R.upsample(vol(spark, sf_dir), True), None)


@REG("res_downsample", f"WITH {VOL_SQL} SELECT img, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST(z // 2 AS INT) AS z, sum(v) / 8.0::DOUBLE AS v FROM vol WHERE z < 6 GROUP BY ALL")
def downsample(spark, sf_dir):
    return _v(R.downsample(vol(spark, sf_dir)), None)


@REG("cmd_downsampling", f"WITH {VOL_SQL} SELECT img, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST(z // 2 AS INT) AS z, CAST(sum(CASE WHEN z = 6 THEN 2 * v ELSE v END) AS BIGINT) >> 3 AS v FROM vol GROUP BY ALL")
def downsampling(spark, sf_dir):
    return _v(command(vol(spark, sf_dir), "downsampling"), None)


@REG("res_downsample_label", f"WITH {VOL_SQL}, c AS (SELECT img, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST(z // 2 AS INT) AS z, v % 5 AS v, sum(CASE WHEN z = 6 THEN 2 ELSE 1 END) AS n, min(x % 2 + 2 * (y % 2) + 4 * (z % 2)) AS k FROM vol GROUP BY ALL) SELECT img, x, y, z, v FROM (SELECT *, row_number() OVER (PARTITION BY img, x, y, z ORDER BY n DESC, k) AS r FROM c) WHERE r = 1")
def downsample_label(spark, sf_dir):
    return _v(R.downsample_label(vol(spark, sf_dir).map(F.col("v") % 5)), None)


def _dis(g):
    v = F.col("v")
    return g.df.select("img", "x", "y", "z", ((v % 3) - 1).alias("dx"), ((v % 5) / 2.0 - 1).alias("dy"), ((v % 2) / 2.0).alias("dz"))




@REG("res_compose_displacement", f"""WITH {VOL_SQL}, t AS (SELECT img, x, y, z, x + (v % 3) - 1 AS px, y + (v % 5) / 2.0::DOUBLE - 1 AS py, z + (v % 2) / 2.0::DOUBLE AS pz FROM vol),
q AS (SELECT *, CAST(floor(px) AS INT) AS ix, CAST(floor(py) AS INT) AS iy, CAST(floor(pz) AS INT) AS iz FROM t WHERE floor(px) >= 0 AND floor(px) + 1 < 16 AND floor(py) >= 0 AND floor(py) + 1 < 12 AND floor(pz) >= 0 AND floor(pz) + 1 < 7),
r AS (SELECT q.img, q.x, q.y, q.z, (CASE WHEN a.a = 1 THEN px - ix ELSE 1 - (px - ix) END) * (CASE WHEN b.b = 1 THEN py - iy ELSE 1 - (py - iy) END) * (CASE WHEN k.k = 1 THEN pz - iz ELSE 1 - (pz - iz) END) AS w, vol.v FROM q, range(2) a(a), range(2) b(b), range(2) k(k), vol WHERE vol.img = q.img AND vol.x = ix + a.a AND vol.y = iy + b.b AND vol.z = iz + k.k), {_filled('sum(w * v)')}""")
def compose(spark, sf_dir):
    g = vol(spark, sf_dir)
    return _v(R.compose_displacement(g, _dis(g)))


@REG("res_mapping", f"WITH {VOL_SQL} SELECT img, x, y, z, (v % 3) - 1 + x AS dx, (v % 5) / 2.0::DOUBLE - 1 + y AS dy, (v % 2) / 2.0::DOUBLE + z AS dz FROM vol")
def mapping(spark, sf_dir):
    return R.displacement_to_mapping(_dis(vol(spark, sf_dir)))


@REG("res_invert_displacement")
def invert(spark, sf_dir):
    g = vol(spark, sf_dir)
    small = g.df.select("img", "x", "y", "z", (F.col("x") / 64.0).alias("dx"), (F.col("y") / 64.0).alias("dy"), F.lit(0.0).alias("dz"))
    return R.invert_displacement(small, g, 2).select("img", "x", "y", "z", *[F.round(f"d{a}", 6).alias(f"d{a}") for a in "xyz"])
