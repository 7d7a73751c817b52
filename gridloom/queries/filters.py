"""Filters, gradients, cumulative sums and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import IMG_SQL, VOL_SQL, pic, vol
from ..operators import stencil as W
from .registry import Registry

REG = Registry()


def _win(axis: str) -> str:
    others = ", ".join(a for a in "xyz" if a != axis)
    return f"(PARTITION BY img, {others} ORDER BY {axis})"


def _clamped(kind: str, axis: str, v: str) -> str:
    return f"coalesce({kind}({v}) OVER {_win(axis)}, {v})"


def _smooth(axis: str, v: str) -> str:
    return f"{_clamped('lag', axis, v)} + 2 * {v} + {_clamped('lead', axis, v)}"


def _chain(base: str, steps: list[tuple[str, str]]) -> str:
    """CTEs s1, s2, ...: each replaces v by an expression of the one before; the last is named out."""
    parts, last = [], base
    for k, (value, _) in enumerate(steps):
        name = "out" if k == len(steps) - 1 else f"s{k + 1}"
        parts.append(f"{name} AS (SELECT img, x, y, z, idx, {value} AS v FROM {last})")
        last = name
    return ", ".join(parts)


GAUSS = _chain("vol", [(f"({_smooth(a, 'v')}) / 4.0::DOUBLE", a) for a in "xyz"])
MEAN = _chain("vol", [(f"{_clamped('lag', a, 'v')} + v + {_clamped('lead', a, 'v')}", a) for a in "xyz"])


@REG("filter_gaussian", f"WITH {VOL_SQL}, {GAUSS} SELECT img, idx, v FROM out")
def gaussian(spark, sf_dir):
    return W.gaussian(vol(spark, sf_dir)).df.select("img", "idx", "v")


@REG("filter_gaussian_2d", f"WITH {IMG_SQL}, {_chain('pic', [(f'({_smooth(a, chr(118))}) / 4.0::DOUBLE', a) for a in 'xyxy'])} SELECT img, idx, v FROM out")
def gaussian_2d(spark, sf_dir):
    return W.gaussian(pic(spark, sf_dir), 2).df.select("img", "idx", "v")


@REG("filter_mean", f"WITH {VOL_SQL}, {MEAN} SELECT img, idx, round(v / 27.0::DOUBLE, 9) AS v FROM out")
def mean(spark, sf_dir):
    return W.mean(vol(spark, sf_dir)).df.select("img", "idx", F.round("v", 9).alias("v"))


def _sobel_sql(base: str, axes: str) -> str:
    d = ", ".join(f"{_clamped('lead', a, 'v')} - {_clamped('lag', a, 'v')} AS g{a}" for a in axes)
    parts, last = [f"q0 AS (SELECT img, x, y, z, idx, {d} FROM {base})"], "q0"
    for k, a in enumerate(axes):
        cols = ", ".join((f"{_smooth(a, f'g{b}')} AS g{b}" if b != a else f"g{b}") for b in axes)
        parts.append(f"q{k + 1} AS (SELECT img, x, y, z, idx, {cols} FROM {last})")
        last = f"q{k + 1}"
    return ", ".join(parts)


@REG("filter_sobel", f"WITH {VOL_SQL}, {_sobel_sql('vol', 'xyz')} SELECT img, idx, abs(gx) + abs(gy) + abs(gz) AS v FROM q3")
def sobel(spark, sf_dir):
    return W.sobel(vol(spark, sf_dir)).df.select("img", "idx", "v")


@REG("filter_laplacian", f"WITH {VOL_SQL} SELECT img, idx, " + " + ".join(f"{_clamped('lag', a, 'v')} - 2 * v + {_clamped('lead', a, 'v')}" for a in "xyz") + " AS v FROM vol")
def laplacian(spark, sf_dir):
    return W.laplacian(vol(spark, sf_dir)).df.select("img", "idx", "v")


_D = {a: f"({_clamped('lead', a, 'v')} - {_clamped('lag', a, 'v')})" for a in "xyz"}


@REG("filter_gradient_magnitude", f"WITH {VOL_SQL} SELECT img, idx, round(sqrt({' + '.join(f'{d} * {d}' for d in _D.values())}), 9) AS v FROM vol")
def gradient_magnitude(spark, sf_dir):
    return W.gradient_magnitude(vol(spark, sf_dir)).df.select("img", "idx", F.round("v", 9).alias("v"))


_CANNY = f"""WITH {IMG_SQL}, {_sobel_sql('pic', 'xy')},
m AS (SELECT *, sqrt(gx * gx + gy * gy) AS m, abs(gx) > abs(gy) * 2.414213562373095::DOUBLE AS flat, abs(gy) > abs(gx) * 2.414213562373095::DOUBLE AS steep FROM q2),
o AS (SELECT *, CASE WHEN steep THEN 0 ELSE 1 END AS dx, CASE WHEN flat THEN 0 WHEN steep THEN 1 WHEN (gx > 0) = (gy > 0) THEN 1 ELSE -1 END AS dy FROM m)
SELECT o.img, o.idx, round(CASE WHEN o.m = 0 THEN 0 WHEN p.m IS NULL OR q.m IS NULL THEN o.m WHEN o.m >= p.m AND o.m >= q.m THEN o.m ELSE 0 END, 6) AS v
FROM o LEFT JOIN m p ON p.x = o.x + o.dx AND p.y = o.y + o.dy LEFT JOIN m q ON q.x = o.x - o.dx AND q.y = o.y - o.dy"""


@REG("filter_canny_edge", _CANNY)
def canny(spark, sf_dir):
    return W.canny_edge(pic(spark, sf_dir)).df.select("img", "idx", F.round("v", 6).alias("v"))


@REG("filter_anisotropic_diffusion_once", f"""WITH {VOL_SQL}, d AS (SELECT *, {', '.join(f"coalesce(v - lag(v) OVER {_win(a)}, 0)::DOUBLE AS d{a}" for a in "xyz")} FROM vol),
k AS (SELECT img, {', '.join(f"sum(d{a} * d{a}) * 1.3862943611198906::DOUBLE / 1344.0::DOUBLE AS k{a}" for a in "xyz")} FROM d GROUP BY img),
f AS (SELECT d.*, {', '.join(f"CASE WHEN k{a} > 0 THEN d{a} * pow(2, -d{a} * d{a} / k{a}) ELSE 0 END AS f{a}" for a in "xyz")} FROM d JOIN k ON k.img = d.img)
SELECT img, idx, round(v + ({' + '.join(f"coalesce(lead(f{a}) OVER {_win(a)}, 0) - f{a}" for a in "xyz")}) / 8.0::DOUBLE, 6) AS v FROM f""")
def diffusion_once(spark, sf_dir):
    return W.anisotropic_diffusion(vol(spark, sf_dir), iterations=1).df.select("img", "idx", F.round("v", 6).alias("v"))


@REG("filter_anisotropic_diffusion_inv", f"""WITH {VOL_SQL}, d AS (SELECT *, {', '.join(f"coalesce(v - lag(v) OVER {_win(a)}, 0)::DOUBLE AS d{a}" for a in "xyz")} FROM vol),
k AS (SELECT img, {', '.join(f"sum(d{a} * d{a}) / 1344.0::DOUBLE AS k{a}" for a in "xyz")} FROM d GROUP BY img),
f AS (SELECT d.*, {', '.join(f"CASE WHEN k{a} > 0 THEN d{a} / (1 + d{a} * d{a} / k{a}) ELSE 0 END AS f{a}" for a in "xyz")} FROM d JOIN k ON k.img = d.img)
SELECT img, idx, round(v + ({' + '.join(f"coalesce(lead(f{a}) OVER {_win(a)}, 0) - f{a}" for a in "xyz")}) / 8.0::DOUBLE, 6) AS v FROM f""")
def diffusion_inverse(spark, sf_dir):
    return W.anisotropic_diffusion(vol(spark, sf_dir), iterations=1, inverse=True).df.select("img", "idx", F.round("v", 6).alias("v"))


@REG("grad_forward", f"WITH {VOL_SQL} SELECT img, idx, " + ", ".join(f"coalesce(lead(v) OVER {_win(a)} - v, 0) AS g{a}" for a in "xyz") + " FROM vol")
def gradient(spark, sf_dir):
    return W.gradient(vol(spark, sf_dir)).select("img", "idx", "gx", "gy", "gz")


@REG("grad_central", f"WITH {VOL_SQL} SELECT img, idx, " + ", ".join(f"coalesce(lead(v) OVER {_win(a)} - lag(v) OVER {_win(a)}, 0) AS g{a}" for a in "xyz") + " FROM vol")
def gradient_at(spark, sf_dir):
    return W.gradient_at(vol(spark, sf_dir)).select("img", "idx", "gx", "gy", "gz")


_S = "(PARTITION BY img ORDER BY idx)"


@REG("grad_shift", f"WITH {VOL_SQL} SELECT img, idx, coalesce(lead(v, 16) OVER {_S} - v, 0) AS v FROM vol")
def gradient_shift(spark, sf_dir):
    return W.gradient_shift(vol(spark, sf_dir), 16).df.select("img", "idx", "v")


for _a, _n in (("x", 1), ("y", 16), ("z", 192)):
    REG.add(f"grad_2{_a}", lambda s, d, a=_a: W.gradient_2(vol(s, d), a).df.select("img", "idx", "v"), f"WITH {VOL_SQL} SELECT img, idx, coalesce(lead(v, {_n}) OVER {_S} - lag(v, {_n}) OVER {_S}, 0) AS v FROM vol")


@REG("win_pdf2cdf", f"WITH {VOL_SQL} SELECT img, idx, CAST(sum(v) OVER {_S} AS BIGINT) AS v FROM vol")
def pdf2cdf(spark, sf_dir):
    return W.pdf2cdf(vol(spark, sf_dir)).df.select("img", "idx", "v")


@REG("win_cdf2pdf", f"WITH {VOL_SQL} SELECT img, idx, CAST((CASE WHEN idx % 2 = 0 THEN 1 ELSE -1 END) * sum((CASE WHEN idx % 2 = 0 THEN 1 ELSE -1 END) * v) OVER {_S} AS BIGINT) AS v FROM vol")
def cdf2pdf(spark, sf_dir):
    return W.cdf2pdf(vol(spark, sf_dir)).df.select("img", "idx", "v")


@REG("win_rank", f"WITH {VOL_SQL} SELECT img, idx, row_number() OVER (PARTITION BY img ORDER BY v, idx) - 1 AS v FROM vol")
def rank(spark, sf_dir):
    return W.rank(vol(spark, sf_dir)).df.select("img", "idx", "v")


@REG("win_rank_avg_tie", f"WITH {VOL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v) - 1 AS r FROM vol) SELECT img, idx, avg(r) OVER (PARTITION BY img, v) AS v FROM r")
def rank_avg_tie(spark, sf_dir):
    return W.rank_avg_tie(vol(spark, sf_dir)).df.select("img", "idx", "v")


@REG("win_values", f"WITH {VOL_SQL} SELECT img, idx, CAST(len(list(v) OVER (PARTITION BY img, y, z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS INT) AS n, CAST(list_sum(list(v) OVER (PARTITION BY img, y, z ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS BIGINT) AS s FROM vol")
def window_values(spark, sf_dir):
    return W.window_values(vol(spark, sf_dir), 2).select("img", "idx", F.size("window").alias("n"), F.aggregate("window", F.lit(0).cast("long"), lambda a, b: a + b).alias("s"))


@REG("win_shrink", f"WITH {VOL_SQL} SELECT img, CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST(z // 2 AS INT) AS z, sum(CASE WHEN v > 0 THEN v ELSE 0 END) / 8.0::DOUBLE AS v FROM vol WHERE z // 2 < 3 GROUP BY ALL")
def shrink(spark, sf_dir):
    return W.shrink(vol(spark, sf_dir), 2).df.select("img", "x", "y", "z", "v")


_J = {(b, a): f"(lead(d{b}) OVER {_win(a)} - lag(d{b}) OVER {_win(a)} + {float(a == b)})" for a in "xyz" for b in "xyz"}
_DET = f"{_J['x','x']} * ({_J['y','y']} * {_J['z','z']} - {_J['y','z']} * {_J['z','y']}) - {_J['x','y']} * ({_J['y','x']} * {_J['z','z']} - {_J['y','z']} * {_J['z','x']}) + {_J['x','z']} * ({_J['y','x']} * {_J['z','y']} - {_J['y','y']} * {_J['z','x']})"


@REG("win_jacobian_displacement", f"WITH {VOL_SQL}, d AS (SELECT *, (v % 3) - 1 AS dx, (v % 5) - 2 AS dy, (v % 7) - 3 AS dz FROM vol) SELECT img, idx, CAST(coalesce({_DET}, 1.0) AS DOUBLE) AS v FROM d")
def jacobian(spark, sf_dir):
    g = vol(spark, sf_dir)
    v = F.col("v")
    return W.jacobian_determinant_dis(g.df.withColumns({"dx": v % 3 - 1, "dy": v % 5 - 2, "dz": v % 7 - 3}), g).select("img", "idx", "v")
