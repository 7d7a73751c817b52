"""Vectors, decompositions in closed form, colours, headers, upsampling, loops of neighbours, fields of view."""

from __future__ import annotations

import gzip

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..fixtures import IMG_SQL, VOL_SQL, pic, spread, table, vol
from ..functions import color, dicom
from ..functions import matrix as M
from ..functions import vectors as V
from ..layout import from_arrays, to_arrays
from ..operators import morphology as O
from ..operators import resample as R
from ..operators import segmentation as S
from ..operators import stats, views
from ..operators import stencil as W
from ..operators.graph import saved, shared_path
from ..sources import formats, gzip_ranges, images
from .arrays import E_SQL, _parts
from .morphology import CC_SQL, waves_sql
from .registry import Registry

REG = Registry()
_L = lambda *xs: "[" + ", ".join(xs) + "]"


def _vector(name: str, value, sql: str, n: int = 9) -> None:
    """value of a and b, elements as rows, rounded to 5 places."""

    def run(spark, sf_dir):
        out = _parts(spark, sf_dir, n).select("vec_id", F.posexplode(value(F.col("a"), F.col("b"))).alias("i", "v"))
        return out.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("v", 5) + 0.0).alias("v"))

    REG.add(name, run, f"WITH {E_SQL}, p AS (SELECT vec_id, f[1:{n}] AS a, f[{n + 1}:{2 * n}] AS b FROM e), q AS (SELECT vec_id, {sql} AS r FROM p) SELECT vec_id, CAST(i.i AS BIGINT) AS i, round(r[i.i + 1], 5) + 0.0::DOUBLE AS v FROM q, range(128) i(i) WHERE i.i < len(r)")


_vector("vec_elem_mul", V.elem_mul, "list_transform(list_zip(a, b), lambda z: z[1] * z[2])", 3)
_vector("vec_elem_div", lambda a, b: V.elem_div(a, F.transform(b, lambda x: x * x + 1.0)), "list_transform(list_zip(a, b), lambda z: z[1] / (z[2] * z[2] + 1.0::DOUBLE))", 3)
_vector("vec_floor", lambda a, b: V.floor(M.scale(a, 100.0)), "list_transform(a, lambda x: floor(x * 100.0::DOUBLE))", 3)
_vector("vec_ceil", lambda a, b: V.ceil(M.scale(a, 100.0)), "list_transform(a, lambda x: ceil(x * 100.0::DOUBLE))", 3)
_vector("vec_round", lambda a, b: V.round_half_away(M.scale(a, 100.0)), "list_transform(a, lambda x: sign(x) * floor(abs(x * 100.0::DOUBLE) + 0.5))", 3)
_vector("vec_rotate", lambda a, b: V.rotate(F.slice(b, 1, 3), a), _L(*[" + ".join(f"a[{3 * r + c + 1}] * b[{c + 1}]" for c in range(3)) for r in range(3)]))
_vector("vec_reorient_vector", lambda a, b: V.reorient_vector(a, (2, 0, 1)), "[a[2], a[3], a[1]]", 3)
_vector("vec_reorient_matrix", lambda a, b: V.reorient_matrix(a, (2, 0, 1), (True, False, True)), "[a[4], a[5], a[6], -a[7], -a[8], -a[9], -a[1], -a[2], -a[3]]")
_vector("mat_col_rotate", lambda a, b: M.col_rotate(a, 0, 2, 0.6, 0.8, 3, 3), _L(*[x for r in range(3) for x in (f"0.6::DOUBLE * a[{3 * r + 1}] - 0.8::DOUBLE * a[{3 * r + 3}]", f"a[{3 * r + 2}]", f"0.8::DOUBLE * a[{3 * r + 1}] + 0.6::DOUBLE * a[{3 * r + 3}]")]))
_vector("mat_col_swap", lambda a, b: M.col_swap(a, 0, 2, 3, 3), _L(*[f"a[{3 * r + c}]" for r in range(3) for c in (3, 2, 1)]))
_vector("mat_scaling_matrix", lambda a, b: M.scaling_matrix(a), "[a[1], 0, 0, 0, a[2], 0, 0, 0, a[3]]", 3)
_vector("mat_to_matrix", lambda a, b: M.to_matrix(a), "[a[1], a[2], a[3], a[10], a[4], a[5], a[6], a[11], a[7], a[8], a[9], a[12], 0, 0, 0, 1]", 12)

# a with 2 added to its diagonal, so that no triangle is close to singular
_PLUS = lambda a: F.zip_with(a, M.scale(M.identity(3), 2.0), lambda p, q: p + q)
_m = lambda r, c: f"(a[{3 * r + c + 1}] + {2.0 if r == c else 0.0}::DOUBLE)"
_vector("mat_inverse_lower", lambda a, b: M.inverse_lower(_PLUS(a), 3), _L(f"1 / {_m(0, 0)}", "0", "0", f"-{_m(1, 0)} / {_m(0, 0)} / {_m(1, 1)}", f"1 / {_m(1, 1)}", "0", f"-({_m(2, 0)} / {_m(0, 0)} - {_m(2, 1)} * {_m(1, 0)} / {_m(0, 0)} / {_m(1, 1)}) / {_m(2, 2)}", f"-{_m(2, 1)} / {_m(1, 1)} / {_m(2, 2)}", f"1 / {_m(2, 2)}"))
_vector("mat_inverse_upper", lambda a, b: M.inverse_upper(_PLUS(a), 3), _L(f"1 / {_m(0, 0)}", f"-{_m(0, 1)} / {_m(0, 0)} / {_m(1, 1)}", f"-({_m(0, 2)} / {_m(0, 0)} - {_m(1, 2)} * {_m(0, 1)} / {_m(0, 0)} / {_m(1, 1)}) / {_m(2, 2)}", "0", f"1 / {_m(1, 1)}", f"-{_m(1, 2)} / {_m(1, 1)} / {_m(2, 2)}", "0", "0", f"1 / {_m(2, 2)}"))


def _det3(e) -> str:
    return f"({e(0, 0)} * ({e(1, 1)} * {e(2, 2)} - {e(1, 2)} * {e(2, 1)}) - {e(0, 1)} * ({e(1, 0)} * {e(2, 2)} - {e(1, 2)} * {e(2, 0)}) + {e(0, 2)} * ({e(1, 0)} * {e(2, 1)} - {e(1, 1)} * {e(2, 0)}))"


def _adjugate3(e) -> list[list[str]]:
    """Rows of the adjugate of a 3x3 matrix by cofactors."""
    minor = lambda r, c: (lambda rs, cs: f"({e(rs[0], cs[0])} * {e(rs[1], cs[1])} - {e(rs[0], cs[1])} * {e(rs[1], cs[0])})")([k for k in range(3) if k != r], [k for k in range(3) if k != c])
    return [[("-" if (r + c) % 2 else "") + minor(c, r) for c in range(3)] for r in range(3)]


_vector("mat_inverse_3", lambda a, b: M.inverse(_PLUS(a), 3), _L(*[f"{x} / {_det3(_m)}" for row in _adjugate3(_m) for x in row]))


def _decomposed(name: str, udf, rows: int, cols: int, gram: str, out: str) -> None:
    """A decomposition of a (rows x cols) whose values follow from a 3x3 Gram matrix g: out is a list of g11 to g33."""
    n = rows * cols

    def run(spark, sf_dir):
        got = _parts(spark, sf_dir, n).select("vec_id", F.posexplode(udf(F.col("a"))).alias("i", "v"))
        return got.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("v", 4) + 0.0).alias("v"))

    e = lambda r, c: f"a[{r * cols + c + 1}]"
    cells = []
    for i in range(3):
        for j in range(3):
            terms = [f"{e(i, k)} * {e(j, k)}" for k in range(cols)] if gram == "rows" else [f"{e(k, i)} * {e(k, j)}" for k in range(rows)]
            cells.append(f"{' + '.join(terms)} AS g{i + 1}{j + 1}")
    REG.add(name, run, f"WITH {E_SQL}, p AS (SELECT vec_id, f[1:{n}] AS a FROM e), g AS (SELECT vec_id, a, {', '.join(cells)} FROM p), {out}, q2 AS (SELECT vec_id, r FROM q) SELECT vec_id, CAST(i.i AS BIGINT) AS i, round(r[i.i + 1], 4) + 0.0::DOUBLE AS v FROM q2, range(128) i(i) WHERE i.i < len(r)")


_CHOL = "l1 AS (SELECT *, sqrt(g11) AS l11, g21 / sqrt(g11) AS l21, g31 / sqrt(g11) AS l31 FROM g), l2 AS (SELECT *, sqrt(g22 - l21 * l21) AS l22 FROM l1), l3 AS (SELECT *, (g32 - l31 * l21) / l22 AS l32 FROM l2), l AS (SELECT *, sqrt(g33 - l31 * l31 - l32 * l32) AS l33 FROM l3)"
_LOWER, _UPPER = "[l11, 0, 0, l21, l22, 0, l31, l32, l33]", "[l11, l21, l31, 0, l22, l32, 0, 0, l33]"
_decomposed("mat_qr", lambda a: M.qr_r(4, 3)(a), 4, 3, "columns", f"{_CHOL}, q AS (SELECT vec_id, {_UPPER} AS r FROM l)")
_decomposed("mat_lq", lambda a: M.lq_l(3, 4)(a), 3, 4, "rows", f"{_CHOL}, q AS (SELECT vec_id, {_LOWER} AS r FROM l)")
_q = lambda i, c: f"({' + '.join(f'a[{i * 3 + k + 1}] * u{k + 1}{c + 1}' for k in range(3))})"
_decomposed("mat_qr_q", lambda a: M.qr_q(4, 3)(a), 4, 3, "columns", f"{_CHOL}, u AS (SELECT *, 1 / l11 AS u11, -l21 / l11 / l22 AS u12, 1 / l22 AS u22, (l21 * l32 / l22 - l31) / l11 / l33 AS u13, -l32 / l22 / l33 AS u23, 1 / l33 AS u33, 0 AS u21, 0 AS u31, 0 AS u32 FROM l), q AS (SELECT vec_id, {_L(*[_q(i, c) for i in range(4) for c in range(3)])} AS r FROM u)")
_EIGEN = "t AS (SELECT *, (g11 + g22 + g33) / 3 AS m, g12 * g12 + g13 * g13 + g23 * g23 AS o FROM g), t2 AS (SELECT *, sqrt(((g11 - m) * (g11 - m) + (g22 - m) * (g22 - m) + (g33 - m) * (g33 - m) + 2 * o) / 6) AS s FROM t), t3 AS (SELECT *, ((g11 - m) * ((g22 - m) * (g33 - m) - g23 * g23) - g12 * (g12 * (g33 - m) - g23 * g13) + g13 * (g12 * g23 - (g22 - m) * g13)) / (s * s * s) / 2 AS d FROM t2), t4 AS (SELECT *, acos(greatest(least(d, 1), -1)) / 3 AS w FROM t3), ev AS (SELECT *, m + 2 * s * cos(w) AS e1, m + 2 * s * cos(w + 2 * pi() / 3) AS e3 FROM t4)"
_decomposed("mat_eigenvalues", lambda a: M.eigenvalues_symmetric(3)(M.square(a, 3, 3)), 3, 3, "rows", f"{_EIGEN}, q AS (SELECT vec_id, [e1, 3 * m - e1 - e3, e3] AS r FROM ev)")
_decomposed("mat_svd", lambda a: M.svd_values(3, 4)(a), 3, 4, "rows", f"{_EIGEN}, q AS (SELECT vec_id, [sqrt(e1), sqrt(3 * m - e1 - e3), sqrt(greatest(e3, 0))] AS r FROM ev)")
_g = lambda r, c: f"g{r + 1}{c + 1}"
_inv = _adjugate3(_g)
_decomposed("mat_pseudo_inverse", lambda a: M.pseudo_inverse(3, 4)(a), 3, 4, "rows", "q AS (SELECT vec_id, " + _L(*["(" + " + ".join(f"a[{k * 4 + i + 1}] * ({_inv[k][j]})" for k in range(3)) + f") / {_det3(_g)}" for i in range(4) for j in range(3)]) + " AS r FROM g)")
_decomposed("mat_cholesky", lambda a: M.cholesky(3)(F.zip_with(M.square(a, 3, 3), M.identity(3), lambda p, q: p + q)), 3, 3, "rows", f"{_CHOL}, q AS (SELECT vec_id, {_LOWER} AS r FROM l)")
REG.sql["mat_cholesky"] = REG.sql["mat_cholesky"].replace(", l1 AS (", ", h AS (SELECT * REPLACE (g11 + 1 AS g11, g22 + 1 AS g22, g33 + 1 AS g33) FROM g), l1 AS (").replace("/ sqrt(g11) AS l31 FROM g)", "/ sqrt(g11) AS l31 FROM h)")

# colours


def _numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *[((F.col("p_partkey") * k % n) / float(n)).alias(c) for c, k, n in (("h", 7, 101), ("s", 3, 97), ("l", 5, 89))])


_HSL = "n AS (SELECT p_partkey, (p_partkey * 7 % 101) / 101.0::DOUBLE * 6.2 AS h, (p_partkey * 3 % 97) / 97.0::DOUBLE AS s, (p_partkey * 5 % 89) / 89.0::DOUBLE AS l FROM part)"
_TOP = lambda v, top: f"CAST(floor(least(greatest(({v}) * {top}, 0), 255)) AS BIGINT)"
_SIX = lambda *six: "CASE CAST(floor(t) AS INT) % 6 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(six)) + " END"
_HSL_TO = "c1 AS (SELECT *, h / (pi() / 3) AS t, (1.0 - abs(2.0 * l - 1.0)) * s AS c FROM {n}), c2 AS (SELECT *, c * (1.0 - abs(t % 2.0 - 1.0)) AS x, l - c * 0.5 AS m FROM c1) SELECT {key}, " + ", ".join(f"{_TOP(v + ' + m', '256.0')} AS {k}" for k, v in (("r", _SIX("c", "x", "0.0", "0.0", "x", "c")), ("g", _SIX("x", "c", "c", "x", "0.0", "0.0")), ("b", _SIX("0.0", "0.0", "x", "c", "c", "x")))) + " FROM c2"


def _rgb(df, key, c):
    return df.select(key, c.alias("c")).select(key, "c.r", "c.g", "c.b")


@REG("color_from_hsl", f"WITH {_HSL}, {_HSL_TO.format(n='n', key='p_partkey')}")
def from_hsl(spark, sf_dir):
    return _rgb(_numbers(spark, sf_dir), "p_partkey", color.from_hsl(F.col("h") * 6.2, F.col("s"), F.col("l")))


_THIRD = lambda a, b, c: f"CASE CAST(floor(h / (2 * pi() / 3)) AS INT) WHEN 0 THEN {a} WHEN 1 THEN {b} ELSE {c} END"


@REG("color_from_hsi", f"WITH {_HSL}, c1 AS (SELECT *, h - floor(h / (2 * pi() / 3)) * (2 * pi() / 3) AS t FROM n), c2 AS (SELECT *, l * (1.0 - s) AS low, l * (1.0 + s * cos(t) / cos(pi() / 3 - t)) AS high FROM c1), c3 AS (SELECT *, 3.0 * l - low - high AS rest FROM c2) SELECT p_partkey, " + ", ".join(f"{_TOP(v, '255.0')} AS {k}" for k, v in (("r", _THIRD("high", "low", "rest")), ("g", _THIRD("rest", "high", "low")), ("b", _THIRD("low", "rest", "high")))) + " FROM c3")
def from_hsi(spark, sf_dir):
    return _rgb(_numbers(spark, sf_dir), "p_partkey", color.from_hsi(F.col("h") * 6.2, F.col("s"), F.col("l")))


@REG("color_generate", f"WITH n AS (SELECT p_partkey, (p_partkey * 0.618033988749895::DOUBLE) % 2.0 * pi() AS h, CASE WHEN (p_partkey // 13) % 2 = 1 THEN 0.75::DOUBLE ELSE 0.95::DOUBLE END AS s, [0.0, -0.2, 0.1, -0.15, 0.05, -0.2, 0.1, -0.15][(p_partkey // 13) % 8 + 1]::DOUBLE + 0.7::DOUBLE AS l FROM part), {_HSL_TO.format(n='n', key='p_partkey')}")
def generate(spark, sf_dir):
    return _rgb(table(spark, sf_dir, "part"), "p_partkey", color.generate(F.col("p_partkey")))


@REG("color_generate_hue", f"WITH n AS (SELECT p_partkey, (p_partkey * 0.618033988749895::DOUBLE) % 2.0 * pi() AS h, 0.85::DOUBLE AS s, 0.7::DOUBLE AS l FROM part), {_HSL_TO.format(n='n', key='p_partkey')}")
def generate_hue(spark, sf_dir):
    return _rgb(table(spark, sf_dir, "part"), "p_partkey", color.generate_hue(F.col("p_partkey")))


_BAR = "b AS (SELECT CAST(i.i % 20 AS INT) AS x, CAST(i.i // 20 AS INT) AS y FROM range(5140) i(i)), f AS (SELECT *, x BETWEEN 1 AND 18 AND y BETWEEN 1 AND 255 AS inside FROM b)"


@REG("color_bar", f"WITH {_BAR} SELECT x, y, " + ", ".join(f"CAST(CASE WHEN inside THEN floor(y / 257.0::DOUBLE * {p}.0 + (1.0 - y / 257.0::DOUBLE) * {q}.0) ELSE 0 END AS BIGINT) AS {n}" for n, p, q in (("r", 10, 250), ("g", 200, 0), ("b", 30, 90))) + " FROM f")
def bar(spark, sf_dir):
    return color.color_bar(spark, (10, 200, 30), (250, 0, 90))


@REG("color_spectrum_bar", f"WITH {_BAR}, v AS (SELECT *, floor(y * 255.0::DOUBLE / 257) AS v FROM f) SELECT x, y, " + ", ".join(f"CAST(CASE WHEN NOT inside THEN 0 WHEN abs(v - {c}) < 32 THEN 255 WHEN abs(v - {c}) >= 96 THEN 0 ELSE 255 - (abs(v - {c}) - 32) * 4 END AS BIGINT) AS {n}" for n, c in (("r", 64), ("g", 128), ("b", 192))) + " FROM v")
def spectrum_bar(spark, sf_dir):
    return color.spectrum_bar(spark)


@REG("color_map_values", f"WITH {VOL_SQL} SELECT img, idx, CAST(least(greatest(floor((v - 100) * (256 / 400.0::DOUBLE)), 0), 255) AS BIGINT) AS i FROM vol")
def map_values(spark, sf_dir):
    return vol(spark, sf_dir).df.select("img", "idx", color.map_values(F.col("v"), 100, 500, 256).alias("i"))


# places


@REG("geo_is_valid", f"WITH {VOL_SQL} SELECT img, idx, x - 2 >= 0 AND y + 3 < 12 AND z - 1 >= 0 AS inside, x = 0 OR x = 15 OR y = 0 OR y = 11 OR z = 0 OR z = 6 AS border FROM vol")
def is_valid(spark, sf_dir):
    g = vol(spark, sf_dir)
    return g.df.select("img", "idx", V.is_valid(F.col("x") - 2, F.col("y") + 3, F.col("z") - 1, g.shape).alias("inside"), V.is_border(F.col("x"), F.col("y"), F.col("z"), g.shape).alias("border"))


def _v(g, digits=6):
    v = F.round("v", digits) if digits is not None else F.col("v")
    return g.df.select("img", "x", "y", "z", v.alias("v"))


@REG("res_upsample_label", f"WITH {VOL_SQL} SELECT img, CAST(2 * x + a.a AS INT) AS x, CAST(2 * y + b.b AS INT) AS y, CAST(2 * z + c.c AS INT) AS z, v % 5 AS v FROM vol, range(2) a(a), range(2) b(b), range(2) c(c)")
def upsample_label(spark, sf_dir):
    return _v(R.upsample_label(vol(spark, sf_dir).map(F.col("v") % 5)), None)


def _along(axis: str) -> None:
    at = ", ".join(f"CAST({'2 * ' + a + ' + k.k' if a == axis else a} AS INT) AS {a}" for a in "xyz")
    REG.add(f"res_upsample_{axis}_nearest", lambda s, d: _v(R.upsample_axis(vol(s, d), axis), None), f"WITH {VOL_SQL} SELECT img, {at}, v FROM vol, range(2) k(k)")


for _axis in "xyz":
    _along(_axis)


@REG("res_upsample_with_padding", f"WITH {VOL_SQL}, t AS (SELECT i.i AS img, CAST(n.n % 32 AS INT) AS x, CAST((n.n // 32) % 24 AS INT) AS y, CAST(n.n // 768 AS INT) AS z FROM range(4) i(i), range(10752) n(n)), s AS (SELECT t.img, t.x, t.y, t.z, sum(v.v * (CASE WHEN a.a = 1 THEN t.x % 2 / 2.0::DOUBLE ELSE 1 - t.x % 2 / 2.0::DOUBLE END) * (CASE WHEN b.b = 1 THEN t.y % 2 / 2.0::DOUBLE ELSE 1 - t.y % 2 / 2.0::DOUBLE END) * (CASE WHEN c.c = 1 THEN t.z % 2 / 2.0::DOUBLE ELSE 1 - t.z % 2 / 2.0::DOUBLE END)) AS v FROM t, range(2) a(a), range(2) b(b), range(2) c(c), vol v WHERE v.img = t.img AND v.x = t.x // 2 + a.a AND v.y = t.y // 2 + b.b AND v.z = t.z // 2 + c.c AND t.x // 2 + 1 < 16 AND t.y // 2 + 1 < 12 AND t.z // 2 + 1 < 7 GROUP BY ALL) SELECT t.img, t.x, t.y, t.z, round(coalesce(s.v, 0), 6) AS v FROM t LEFT JOIN s ON s.img = t.img AND s.x = t.x AND s.y = t.y AND s.z = t.z")
def upsample_with_padding(spark, sf_dir):
    return _v(R.upsample_with_padding(vol(spark, sf_dir).map(F.col("v").cast("double")), (32, 24, 14)))


@REG("res_to_space", f"WITH {VOL_SQL}, t AS (SELECT i.i AS img, CAST(n.n % 10 AS INT) AS x, CAST((n.n // 10) % 8 AS INT) AS y, CAST(n.n // 80 AS INT) AS z FROM range(4) i(i), range(400) n(n)) SELECT t.img, t.x, t.y, t.z, vol.v FROM t JOIN vol ON vol.img = t.img AND vol.x = t.x + 3 AND vol.y = t.y + 2 AND vol.z = t.z + 1")
def to_space(spark, sf_dir):
    """A shift of whole voxels between two spaces of equal voxel size."""
    from dataclasses import replace

    g = replace(vol(spark, sf_dir), affine=(2.0, 0, 0, 10.0, 0, 2.0, 0, 20.0, 0, 0, 3.0, 30.0, 0, 0, 0, 1.0))
    return _v(R.to_space(g, (10, 8, 5), (2.0, 0, 0, 16.0, 0, 2.0, 0, 24.0, 0, 0, 3.0, 33.0, 0, 0, 0, 1.0)), None)


@REG("res_decompose_displacement", f"WITH {VOL_SQL} SELECT img, x, y, z, 0.25::DOUBLE AS dx, -0.5::DOUBLE AS dy, 0.0::DOUBLE AS dz FROM vol WHERE x BETWEEN 3 AND 12 AND y BETWEEN 3 AND 8 AND z BETWEEN 1 AND 4")
def decompose(spark, sf_dir):
    """Two shifts: away from the border, what is left of the whole after the first is the difference."""
    g = vol(spark, sf_dir)
    shift = lambda x, y: g.df.select("img", "x", "y", "z", F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(0.0).alias("dz"))
    u = R.decompose_displacement(shift(0.75, 0.0), shift(0.5, 0.5), g, 3)
    inner = u.where("x between 3 and 12 and y between 3 and 8 and z between 1 and 4")
    return inner.select("img", "x", "y", "z", *[(F.round(c, 9) + 0.0).alias(c) for c in ("dx", "dy", "dz")])


# neighbours


@REG("morph_region_counts", f"WITH {VOL_SQL}, m AS (SELECT img, x, y, z, v % 5 AS v FROM vol) SELECT a.img, a.x, a.y, a.z, b.v AS u, count(*) AS n FROM m a JOIN m b ON a.img = b.img AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY ALL")
def region_counts(spark, sf_dir):
    return O.region_counts(vol(spark, sf_dir).map(F.col("v") % 5)).select("img", "x", "y", "z", "u", "n")


@REG("morph_fit", f"""WITH {IMG_SQL}, m AS (SELECT x, y, idx, CAST(v > 20 AS INT) AS v, v::DOUBLE AS r FROM pic),
p AS (SELECT a.x, a.y, a.idx, a.v, b.v AS bv, abs(b.r - a.r) AS far, (b.y - a.y + 1) * 3 + b.x - a.x + 1 AS k FROM m a JOIN m b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.idx <> b.idx),
o AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY far, k) AS pos, count(*) OVER (PARTITION BY idx) + 1 AS m FROM p),
s AS (SELECT idx, v, sum(bv) + v AS n, coalesce(sum(CASE WHEN bv = 1 THEN 2 ELSE -2 END) FILTER (WHERE pos BETWEEN 2 AND m // 2), 0) AS vote FROM o GROUP BY idx, v),
t AS (SELECT idx, v, n + CASE WHEN n BETWEEN 0 AND 8 THEN vote ELSE 0 END AS score FROM s) SELECT idx, CASE WHEN score > 4 THEN 1 WHEN score < 4 THEN 0 ELSE v END AS v FROM t""")
def fit(spark, sf_dir):
    g = pic(spark, sf_dir)
    return O.fit(g.map((F.col("v") > 20).cast("int")), g).df.select("idx", "v")


_NEAR9 = "SELECT a.idx, a.x, a.y, CASE WHEN sum(b.v) > 4 THEN 1 WHEN sum(b.v) < 4 THEN 0 ELSE a.v END AS v FROM {w} a JOIN {w} b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.idx, a.x, a.y, a.v"


@REG("morph_recursive_smoothing", f"WITH {IMG_SQL}, s0 AS (SELECT idx, x, y, CAST(v > 18 AS INT) AS v FROM pic), " + ", ".join(f"s{k + 1} AS MATERIALIZED ({_NEAR9.format(w=f's{k}')})" for k in range(8)) + " SELECT idx, v FROM s8")
def recursive_smoothing(spark, sf_dir):
    return O.recursive_smoothing(pic(spark, sf_dir).map((F.col("v") > 18).cast("int")), 8).df.select("idx", "v")


def _clean_sql(t: int) -> str:
    """CTE d (img, x, y, z, idx, v) of pic > t: its largest component and all zeros but their largest component."""
    parts = []
    for name, where in (("a", f"v > {t}"), ("z", f"v <= {t}")):
        c = CC_SQL.removeprefix(IMG_SQL + ", ").replace("WHERE v > 22", f"WHERE {where}")
        for old in ("n", "e", "reach", "cc"):
            c = c.replace(f"{old} AS (", f"{name}{old} AS (")
        c = c.replace("FROM n ", f"FROM {name}n ").replace("FROM n)", f"FROM {name}n)").replace("JOIN n ", f"JOIN {name}n ").replace("FROM n\n", f"FROM {name}n\n").replace("FROM reach", f"FROM {name}reach").replace("SELECT reach.", f"SELECT {name}reach.").replace("= reach.", f"= {name}reach.").replace("JOIN e ON", f"JOIN {name}e ON").replace(" e.", f" {name}e.").replace(" FROM n UNION", f" FROM {name}n UNION")
        parts.append(c + f", {name}top AS (SELECT label FROM {name}cc GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)")
    return ", ".join(parts) + f", d AS (SELECT 0::BIGINT AS img, x, y, z, pic.idx, CAST(CASE WHEN v > {t} THEN coalesce(acc.label = (SELECT label FROM atop), false) ELSE coalesce(zcc.label <> (SELECT label FROM ztop), false) END AS INT) AS v FROM pic LEFT JOIN acc ON acc.idx = pic.idx LEFT JOIN zcc ON zcc.idx = pic.idx)"


@REG("cc_defragment_and_fill_holes", f"WITH RECURSIVE {IMG_SQL}, {_clean_sql(18)} SELECT idx, v FROM d")
def defragment_and_fill_holes(spark, sf_dir):
    return O.defragment_and_fill_holes(pic(spark, sf_dir).map((F.col("v") > 18).cast("int"))).df.select("idx", "v")


@REG("seg_dndnco", f"WITH RECURSIVE {IMG_SQL}, {_clean_sql(16)}, {waves_sql('d', 2, True, 24)}, {waves_sql('w24', 2, False, 24, 'y')} SELECT idx, CAST(v AS INT) AS v FROM y24")
def dndnco(spark, sf_dir):
    return S.dndnco(pic(spark, sf_dir).map((F.col("v") > 16).cast("int"))).df.select("idx", F.col("v").cast("int").alias("v"))


def _win(a: str) -> str:
    return f"(PARTITION BY img, {', '.join(b for b in 'xyz' if b != a)} ORDER BY {a})"


def _diffusion_sql(rounds: int) -> str:
    out = ["v0 AS (SELECT img, x, y, z, idx, v::DOUBLE AS v FROM vol)"]
    for k in range(rounds):
        out.append(f"d{k} AS MATERIALIZED (SELECT *, {', '.join(f'coalesce(v - lag(v) OVER {_win(a)}, 0) AS d{a}' for a in 'xyz')} FROM v{k})")
        out.append(f"k{k} AS (SELECT img, {', '.join(f'sum(d{a} * d{a}) * 1.3862943611198906::DOUBLE / 1344.0::DOUBLE AS k{a}' for a in 'xyz')} FROM d{k} GROUP BY img)")
        out.append(f"f{k} AS MATERIALIZED (SELECT d{k}.*, {', '.join(f'CASE WHEN k{a} > 0 THEN d{a} * pow(2, -d{a} * d{a} / k{a}) ELSE 0 END AS f{a}' for a in 'xyz')} FROM d{k} JOIN k{k} ON k{k}.img = d{k}.img)")
        out.append(f"v{k + 1} AS MATERIALIZED (SELECT img, x, y, z, idx, v + ({' + '.join(f'coalesce(lead(f{a}) OVER {_win(a)}, 0) - f{a}' for a in 'xyz')}) / 8.0::DOUBLE AS v FROM f{k})")
    return ", ".join(out)


@REG("filter_anisotropic_diffusion", f"WITH {VOL_SQL}, {_diffusion_sql(3)} SELECT img, idx, round(v, 6) AS v FROM v3")
def diffusion(spark, sf_dir):
    return W.anisotropic_diffusion(vol(spark, sf_dir), iterations=3).df.select("img", "idx", F.round("v", 6).alias("v"))


# segmentation


@REG("seg_postprocess", f"WITH {VOL_SQL}, c AS (SELECT idx, img + 1 AS ch, v / 1500.0::DOUBLE AS p FROM vol UNION ALL SELECT idx, 0, greatest(1 - sum(v / 1500.0::DOUBLE), 0) FROM vol GROUP BY idx), z AS (SELECT idx, ch, CASE WHEN ch = 2 THEN 0 ELSE least(greatest(p, 0), 1) END AS p FROM c), s AS (SELECT *, exp(p - max(p) OVER (PARTITION BY idx)) AS e FROM z) SELECT idx, CAST(ch AS BIGINT) AS ch, round(e / sum(e) OVER (PARTITION BY idx), 8) AS p FROM s")
def postprocess(spark, sf_dir):
    g = vol(spark, sf_dir)
    channels = g.df.select(F.lit(0).cast("long").alias("img"), "idx", F.col("img").alias("ch"), (F.col("v") / 1500.0).alias("p"))
    return S.postprocess(channels, g, "create_bg+clamp_prob+zero,2+softmax")["channels"].select("idx", F.col("ch").cast("long").alias("ch"), F.round("p", 8).alias("p"))


@REG("seg_take_view", f"WITH {VOL_SQL}, t AS (SELECT i.i AS img, CAST(n.n % 8 AS INT) AS x, CAST((n.n // 8) % 8 AS INT) AS y, CAST(n.n // 64 AS INT) AS z FROM range(4) i(i), range(256) n(n)) SELECT t.img, t.x, t.y, t.z, vol.v FROM t JOIN vol ON vol.img = t.img AND vol.x = t.x + 5 AND vol.y = t.y + 2 AND vol.z = t.z + 3")
def take_view(spark, sf_dir):
    """A view of 8 x 8 x 4 with its upper end on that of the box (4..14, 2..10, 2..7)."""
    g = vol(spark, sf_dir)
    m, shape, vs = views.plan_views(((4, 2, 2), (14, 10, 7)), g.shape, (1.0, 1.0, 1.0), (8, 8, 4), (1.0, 1.0, 1.0), "align_top")
    return _v(views.take_view(g, m[0], shape, vs), None)


@REG("stat_residual", "WITH s AS (SELECT *, l_quantity AS q, l_extendedprice / 1000 AS p FROM lineitem) SELECT l_orderkey, l_linenumber, round(p - (1.5::DOUBLE * q + -0.25::DOUBLE * l_tax), 6) AS residual FROM s")
def residual(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_extendedprice") / 1000)
    return stats.residual(rows, "p", ["l_quantity", "l_tax"], [1.5, -0.25]).select("l_orderkey", "l_linenumber", F.round("residual", 6).alias("residual"))


# files


def _header_files(spark, sf_dir):
    """A header a customer: its fields as tags of several kinds, some missing."""
    rows = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "c_custkey")

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                k = r["c_custkey"]
                tags = {
                    0x00080022: ("DA", f"2024{k % 12 + 1:02d}01"),
                    0x00100010: ("PN", r["c_name"].replace("#", "^")),
                    0x00100040: ("CS", "F" if k % 2 else "M"),
                    0x0008103E: ("LO", f"{r['c_mktsegment']} {k % 4}/x"),
                    0x00200011: ("IS", str(k % 20)),
                    0x00200013: ("IS", str(k)),
                    0x00200032: ("DS", f"{k}\\-{k % 7}\\0.5"),
                    0x00200037: ("DS", "0\\1\\0\\0\\0\\-1" if k % 3 else "1\\0\\0\\0\\1\\0"),
                    0x00201041: ("DS", f"{k % 50}.25"),
                    0x00280008: ("IS", str(k % 5)),
                    0x00280030: ("DS", f"0.{k % 9 + 1}\\2"),
                    0x00180081: ("DS", f"{k % 100}"),
                }
                if k % 4:
                    tags[0x00180050] = ("DS", f"{k % 4}.5")
                    tags[0x00101010] = ("AS", f"{k % 90:03d}Y")
                if k % 5 == 0:
                    tags[0x00189087] = ("FD", float(k % 3 * 1000))
                    tags[0x00189089] = ("DS", "0.6\\0.8\\0")
                if k % 5 == 1:
                    tags[0x00291010] = ("OB", formats.write_csa({"B_value": [str(k % 3 * 500)], "DiffusionGradientDirection": ["0", "0.6", "-0.8"], "NumberOfImagesInMosaic": ["4"]}))
                out.append((str(k), formats.write_dicom(np.arange(8 * 4) % 7, 8, 4, tags)))
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


@REG("src_dicom_headers", """WITH k AS (SELECT c_custkey AS k, c_name, c_mktsegment FROM customer),
b AS (SELECT *, CASE WHEN k % 5 = 0 THEN k % 3 * 1000.0::DOUBLE WHEN k % 5 = 1 THEN k % 3 * 500.0::DOUBLE END AS b FROM k)
SELECT k, '2024' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '01_' || CASE WHEN k % 2 = 1 THEN 'F' ELSE 'M' END || CASE WHEN k % 4 > 0 THEN lpad(CAST(k % 90 AS VARCHAR), 3, '0') || 'Y' ELSE '_' END || '_' || replace(c_name, '#', '_') AS patient,
lpad(CAST(k % 20 AS VARCHAR), 2, '0') || '_' || c_mktsegment || CAST(k % 4 AS VARCHAR) || '_x' AS sequence,
c_mktsegment || CAST(k % 4 AS VARCHAR) || '_x_i' || CAST(k AS VARCHAR) || '.dcm' AS image_name,
k::DOUBLE AS px, -(k % 7)::DOUBLE + 0.0 AS py, 0.5::DOUBLE AS pz,
CASE WHEN k % 3 > 0 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS nx, CASE WHEN k % 3 > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS nz,
2.0::DOUBLE AS sx, ((k % 9) + 1) / 10.0::DOUBLE AS sy, CASE WHEN k % 4 > 0 THEN k % 4 + 0.5::DOUBLE ELSE 1.0::DOUBLE END AS sz,
k % 50 + 0.25::DOUBLE AS location, (k % 100)::DOUBLE AS te, CAST(k % 5 AS INT) AS frames, 8 AS w, 4 AS h, 16 AS bits,
CASE WHEN k % 5 = 1 THEN 4 ELSE 8 END AS dw, CASE WHEN k % 5 = 1 THEN 4 ELSE 1 END AS dd,
b IS NOT NULL AS dwi, b, CASE WHEN b IS NULL THEN NULL WHEN k % 5 = 1 THEN 0.6::DOUBLE WHEN b = 0 THEN 0.0::DOUBLE ELSE 0.8::DOUBLE END AS by FROM b""")
def dicom_headers(spark, sf_dir):
    h = images.dicom_headers(_header_files(spark, sf_dir))
    t, c = F.col("tags"), F.col("csa")
    pos, normal, vs, dim, b = dicom.left_upper_pos(t), dicom.orientation(t), dicom.voxel_size(t), dicom.image_dimension(t, c, F.col("pixel_bytes")), dicom.btable(t, c)
    zero = lambda x: x + 0.0
    return h.select(
        F.col("path").cast("long").alias("k"), dicom.patient(t).alias("patient"), dicom.sequence(t).alias("sequence"), dicom.image_name(t).alias("image_name"),
        F.get(pos, 0).alias("px"), zero(F.get(pos, 1)).alias("py"), F.get(pos, 2).alias("pz"), zero(F.get(normal, 6)).alias("nx"), zero(F.get(normal, 8)).alias("nz"),
        F.get(vs, 0).alias("sx"), F.get(vs, 1).alias("sy"), F.get(vs, 2).alias("sz"), dicom.slice_location(t).alias("location"), dicom.te(t).alias("te"), dicom.frame_num(t).alias("frames"),
        dicom.width(t).alias("w"), dicom.height(t).alias("h"), dicom.bit_count(t).alias("bits"), F.get(dim, 0).alias("dw"), F.get(dim, 2).alias("dd"), dicom.is_dwi(t, c).alias("dwi"), b["b"].alias("b"), b["y"].alias("by"),
    )


@REG("src_dicom_report", "WITH k AS (SELECT c_custkey AS k FROM customer), r AS (SELECT k, CASE WHEN k % 4 > 0 THEN 2 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 2 ELSE 0 END + 17 AS n FROM k) SELECT k, CAST(n AS INT) AS n_lines, '(0020,0013) =' || CAST(k AS VARCHAR) AS line FROM r")
def dicom_report(spark, sf_dir):
    h = images.dicom_headers(_header_files(spark, sf_dir)).select(F.col("path").cast("long").alias("k"), F.split(dicom.report(F.col("tags")), "\n").alias("lines"))
    return h.select("k", F.size("lines").alias("n_lines"), F.get(F.filter("lines", lambda x: x.startswith("(0020,0013)")), 0).alias("line"))


@REG("src_dicom", f"WITH {VOL_SQL} SELECT img, idx, v FROM vol")
def dicom_slices(spark, sf_dir):
    """Volumes written as a file a plane and stacked again in the order of their numbers."""
    images.register(spark)
    g, path = vol(spark, sf_dir), shared_path(spark, "images-dicom")
    planes = g.df.groupBy("img", "z").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("s"))
    at = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0)], F.col("z").cast("double"), *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    rows = planes.select(F.lit(None).cast("string").alias("path"), F.concat(F.lit("v"), F.col("img")).alias("name"), (6 - F.col("z")).cast("int").alias("volume"), F.array(F.lit(16), F.lit(12), F.lit(1)).alias("shape"), F.array(*[F.lit(1.0)] * 3).alias("vs"), at.alias("affine"), F.transform("s", lambda r: r["v"].cast("double")).alias("data"))
    rows.write.format("dicom").mode("append").save(path)
    read = spark.read.format("dicom").load(path).withColumn("name", F.regexp_extract("path", r"v(\d)-", 1))
    # numbers run against z, so the third axis points down and the planes come back in reverse
    back = images.dicom_volume(read).where(F.get("affine", 10) < 0).select(F.col("name").cast("long").alias("img"), F.reverse("data").alias("data"))
    turned = from_arrays(back, g.shape)
    return turned.df.select("img", ((F.col("z") * 12 + (11 - F.col("y"))) * 16 + (15 - F.col("x"))).cast("long").alias("idx"), F.col("v").cast("long").alias("v"))


@REG("src_tiff_tags", "SELECT p_partkey AS k, t.t AS tag, CASE t.t WHEN 256 THEN CAST(p_size AS VARCHAR) WHEN 270 THEN p_name ELSE '8 8 8' END AS value FROM part, (VALUES (256), (258), (270)) t(t)")
def tiff_tags(spark, sf_dir):
    import struct

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                text = r["p_name"].encode() + b"\0"
                at = 8 + 2 + 36 + 4
                fields = struct.pack("<HHIHH", 256, 3, 1, r["p_size"], 0) + struct.pack("<HHII", 258, 3, 3, at) + struct.pack("<HHI", 270, 2, len(text)) + (text.ljust(4, b"\0") if len(text) <= 4 else struct.pack("<I", at + 6))
                out.append((str(r["p_partkey"]), b"II*\0" + struct.pack("<IH", 8, 3) + fields + struct.pack("<I", 0) + struct.pack("<3H", 8, 8, 8) + text))
            if out:
                yield pa.record_batch([pa.array(c) for c in zip(*out, strict=True)], ["path", "content"])

    files = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name"), "p_partkey").mapInArrow(run, "path string, content binary")
    return images.tiff_tags(files).select(F.col("path").cast("long").alias("k"), "tag", "value")


@REG("cmd_save", f"WITH {VOL_SQL} SELECT img, idx, v FROM vol")
def save(spark, sf_dir):
    from ..plans.commands import run

    path = shared_path(spark, "images-saved")
    g = run(vol(spark, sf_dir), f"flip_x+save:{path}+flip_x")
    back = spark.read.format("nifti").load(path).select(F.regexp_extract("path", r"image-(\d+)-", 1).cast("long").alias("img"), "data")
    kept = from_arrays(back, g.shape).df.select("img", ((F.col("z") * 12 + F.col("y")) * 16 + (15 - F.col("x"))).cast("long").alias("idx"), F.col("v").cast("long").alias("v"))
    return kept.join(g.df.select("img", "idx", F.col("v").alias("kept")), ["img", "idx"]).where("v = kept").select("img", "idx", "v")


@REG("src_gzip_planes", f"WITH {VOL_SQL} SELECT img, z, CAST(sum(v * (1 + x + 16 * y)) AS BIGINT) AS total FROM vol WHERE z BETWEEN 2 AND 5 GROUP BY img, z")
def gzip_planes(spark, sf_dir):
    """Volumes as gzipped files, an access point each 2 KB, and four planes of each read by these."""
    path = shared_path(spark, "gzip-planes")
    rows = to_arrays(vol(spark, sf_dir)).select("img", F.transform("data", lambda v: v.cast("double")).alias("data"))

    def run(batches):
        for b in batches:
            for img, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                images.put(f"{path}/v{img}.nii.gz", gzip.compress(formats.write_nifti(np.array(data), (16, 12, 7))))
                yield pa.RecordBatch.from_pydict({"img": pa.array([img], pa.int64())})

    saved(rows.mapInArrow(run, "img long"), "gzip-written")
    index = saved(gzip_ranges.gzip_index(spark, path, 2048), "gzip-index")
    planes = gzip_ranges.read_planes(index, z=(2, 6)).select(F.regexp_extract("path", r"v(\d+)\.nii", 1).cast("long").alias("img"), F.col("z"), F.posexplode("data").alias("i", "v"))
    return planes.groupBy("img", "z").agg(F.sum(F.col("v").cast("long") * (1 + F.col("i"))).alias("total"))


@REG("src_read_text_file", "SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INT) AS pos, p_name AS line FROM part")
def read_text(spark, sf_dir):
    path = shared_path(spark, "lines")
    table(spark, sf_dir, "part").orderBy("p_partkey").select("p_name").coalesce(1).write.text(path)
    return images.read_text_file(spark, path).select("pos", "line")


@REG("src_search_files", "SELECT k.k AS k FROM range(3) k(k)")
def search_files(spark, sf_dir):
    path = shared_path(spark, "found")
    for k in range(4):
        spark.range(1).select(F.lit("x")).coalesce(1).write.text(f"{path}/d{k}/part{k}")
    found = images.search_dirs(spark, path, "d?").select(F.regexp_extract("path", r"d(\d)$", 1).cast("long").alias("k"))
    deep = images.search_files(spark, path, "part-*", recursive=True).where(F.col("size") > 0)
    return found.join(deep.select(F.regexp_extract("path", r"/d(\d)/", 1).cast("long").alias("k")), "k").where("k < 3").distinct()
