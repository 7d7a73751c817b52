"""Element-wise operators, expressions and element-wise commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import PAIR_SQL, VOL_SQL, pair, vol
from ..functions import color
from ..operators import elementwise as E
from ..plans.commands import CALLS, command
from ..plans.expression import evaluate
from .registry import Registry

REG = Registry()
KEYS = ["img", "idx"]


def _one(name: str, column, sql: str) -> None:
    """A query of one element-wise operator over the volumes."""
    REG.add(name, lambda s, d: vol(s, d).df.select(*KEYS, column(F.col("v")).alias("v")), f"WITH {VOL_SQL} SELECT img, idx, {sql} AS v FROM vol")


_one("ew_add_constant", lambda v: v + 7, "v + 7")
_one("ew_minus_constant", lambda v: v - 7, "v - 7")
_one("ew_minus_by_constant", lambda v: F.lit(1000) - v, "1000 - v")
_one("ew_multiply_constant", lambda v: v * 3, "v * 3")
_one("ew_divide_constant", lambda v: E.divide(v, F.lit(4.0)), "v / 4.0::DOUBLE")
_one("ew_divide_constant_integral", lambda v: E.divide(v, F.lit(4), True), "v // 4")
_one("ew_divide_by_constant", lambda v: F.round(E.divide(F.lit(1000.0), v + 1), 9), "round(1000.0::DOUBLE / (v + 1), 9)")
_one("ew_mod_constant", lambda v: E.mod_constant(v, 7), "v % 7")
_one("ew_greater_constant", lambda v: E.greater(v, 300), "CAST(v > 300 AS INT)")
_one("ew_lesser_constant", lambda v: E.lesser(v, 300), "CAST(v < 300 AS INT)")
_one("ew_equal_constant", lambda v: E.equal(v, 300), "CAST(v = 300 AS INT)")
_one("ew_square", lambda v: v * v, "v * v")
_one("ew_square_root", lambda v: F.round(E.square_root(v), 9), "round(sqrt(v), 9)")
_one("ew_log", lambda v: F.round(E.log(v + 1), 9), "round(ln(v + 1), 9)")
_one("ew_exp", lambda v: F.round(F.exp(v / 1000.0), 9), "round(exp(v / 1000.0::DOUBLE), 9)")
_one("ew_neg", lambda v: -v, "-v")
_one("ew_abs", lambda v: F.abs(v - 300), "abs(v - 300)")
_one("ew_multiply_pow_constant", lambda v: E.multiply_pow(v - 300, 2), "(v - 300) * 4")
_one("ew_divide_pow_constant", lambda v: E.divide_pow(v - 300, 2), "CAST(sign(v - 300) AS BIGINT) * (abs(v - 300) // 4)")
_one("ew_upper_threshold", lambda v: E.upper_threshold(v, 300), "least(v, 300)")
_one("ew_lower_threshold", lambda v: E.lower_threshold(v, 300), "greatest(v, 300)")
_one("ew_upper_lower_threshold", lambda v: E.upper_lower_threshold(v, 200, 400), "least(greatest(v, 200), 400)")
_one("ew_threshold", lambda v: E.threshold(v, 300, 255, 1), "CASE WHEN v > 300 THEN 255 ELSE 1 END")
_one("ew_binary", lambda v: E.binary(v, lambda x: x % 2 == 0), "CASE WHEN v % 2 = 0 THEN 1 ELSE 0 END")
_one("ew_invert", lambda v: E.invert(v), "max(v) OVER (PARTITION BY img) - v")
_one("ew_normalize", lambda v: F.round(E.normalize(v, 255.0), 6), "round(v * (255.0::DOUBLE / max(v) OVER (PARTITION BY img)), 6)")
_one("ew_normalize_abs", lambda v: F.round(E.normalize_abs(v - 300, 1.0), 9), "round((v - 300) * (1.0::DOUBLE / greatest(-min(v - 300) OVER (PARTITION BY img), max(v - 300) OVER (PARTITION BY img))), 9)")
_one("ew_normalize_upper_lower", lambda v: F.round(E.normalize_upper_lower(v, 255.0), 6), "round((v - min(v) OVER (PARTITION BY img)) * (255.0::DOUBLE / (max(v) OVER (PARTITION BY img) - min(v) OVER (PARTITION BY img))), 6)")
_one("ew_write_back", lambda v: E.write_back((v - 300) / 2.0, -100, 100), "CAST(least(greatest(sign(v - 300) * floor(abs(v - 300) / 2.0::DOUBLE + 0.5), -100), 100) AS BIGINT)")
_one("ew_masked_assign", lambda v: E.masked(v, v > 300, v * 2), "CASE WHEN v > 300 THEN v * 2 ELSE v END")
_one("color_spectrum_value", lambda v: F.round(color.spectrum_value(64.0, v % 256), 6), "round(CASE WHEN abs(v % 256 - 64) <= 32 THEN 255.0 WHEN abs(v % 256 - 64) >= 96 THEN 0.0 ELSE (96 - abs(v % 256 - 64)) * 255.0::DOUBLE / 64 END, 6)")
_one("color_index", lambda v: color.color_index(v, 0.0, 500.0), "CAST(least(greatest(floor(v * 255.99::DOUBLE / 500), 0), 255) AS BIGINT)")
_one("color_rgb_gray", lambda v: color.to_gray(color.rgb(v % 256, (v * 3) % 256, (v * 7) % 256)), "CAST((v % 256 + (v * 3) % 256 + (v * 7) % 256) // 3 AS BIGINT)")


def _pair(name: str, column, sql: str) -> None:
    REG.add(name, lambda s, d: pair(s, d).select("idx", column(F.col("a"), F.col("b")).alias("v")), f"WITH {PAIR_SQL} SELECT idx, {sql} AS v FROM pair")


_pair("pair_add", lambda a, b: a + b, "a + b")
_pair("pair_minus", lambda a, b: a - b, "a - b")
_pair("pair_multiply", lambda a, b: a * b, "a * b")
_pair("pair_divide", lambda a, b: F.round(E.divide(a, b + 1), 9), "round(a / (b + 1)::DOUBLE, 9)")
_pair("pair_greater", lambda a, b: E.greater(a, b), "CAST(a > b AS INT)")
_pair("pair_lesser", lambda a, b: E.lesser(a, b), "CAST(a < b AS INT)")
_pair("pair_equal", lambda a, b: E.equal(a, b), "CAST(a = b AS INT)")
_pair("pair_multiply_pow", lambda a, b: E.multiply_pow(a - 300, b % 3), "(a - 300) * CAST(pow(2, b % 3) AS BIGINT)")
_pair("pair_divide_pow", lambda a, b: E.divide_pow(a - 300, b % 3), "CAST(sign(a - 300) AS BIGINT) * (abs(a - 300) // CAST(pow(2, b % 3) AS BIGINT))")
_pair("pair_masking", lambda a, b: E.masking(a, (b > 300).cast("int")), "CASE WHEN b > 300 THEN 0 ELSE a END")
_pair("pair_masking_by_value", lambda a, b: E.masking_by_value(a, b, 250), "CASE WHEN b > 250 THEN 0 ELSE a END")
_pair("pair_preserve", lambda a, b: E.preserve(a, (b > 300).cast("int")), "CASE WHEN b > 300 THEN a ELSE 0 END")
_pair("pair_preserve_by_value", lambda a, b: E.preserve_by_value(a, b, 250), "CASE WHEN b < 250 THEN 0 ELSE a END")
_pair("pair_paint", lambda a, b: E.paint((b > 300).cast("int"), a, 9), "CASE WHEN b > 300 THEN 9 ELSE a END")


def _cmd(name: str, sql: str, parameter: str = "", digits: int | None = None) -> None:
    """A query of one element-wise command over the volumes as doubles or integers."""
    v = (lambda: F.round("v", digits)) if digits is not None else (lambda: F.col("v"))
    REG.add(f"cmd_{name}", lambda s, d: command(vol(s, d), name, parameter).df.select(*KEYS, v().alias("v")), f"WITH {VOL_SQL} SELECT img, idx, {sql} AS v FROM vol")


_cmd("select_value", "CAST(v = 300 AS INT)", "300")
_cmd("add_value", "v + 2.5::DOUBLE", "2.5")
_cmd("multiply_value", "v * 2.5::DOUBLE", "2.5")
_cmd("lower_threshold", "greatest(v::DOUBLE, 300)", "300")
_cmd("upper_threshold", "least(v::DOUBLE, 300)", "300")
_cmd("threshold", "CAST(v > 300 AS INT)", "300")
_cmd("normalize", "CAST(least(greatest(floor(v * (255.99::DOUBLE / max(v) OVER (PARTITION BY img))), 0), 255) AS BIGINT)")


def _expr(name: str, text: str, sql: str) -> None:
    REG.add(f"expr_{name}", lambda s, d: evaluate(vol(s, d), text, CALLS).df.select(*KEYS, F.round("v", 9).alias("v")), f"WITH {VOL_SQL} SELECT img, idx, round({sql}, 9) AS v FROM vol")


_expr("precedence", "x+1>300", "CAST(v + 1 > 300 AS DOUBLE)")
_expr("left_associative", "x>300+1", "CAST(v > 300 AS DOUBLE) + 1")
_expr("arithmetic", "x*2/4-1.5", "v * 2.0::DOUBLE / 4 - 1.5")
_expr("parentheses", "2*(x>300)+x*(x<100)", "2 * CAST(v > 300 AS DOUBLE) + v * CAST(v < 100 AS DOUBLE)")
_expr("negative", "-2*x", "-2.0::DOUBLE * v")


@REG("expr_call", f"WITH {VOL_SQL} SELECT p.img, p.idx, 2 * CAST(p.v > 300 AS DOUBLE) + q.v AS v FROM vol p JOIN vol q ON q.img = p.img AND q.x = 15 - p.x AND q.y = p.y AND q.z = p.z")
def expr_call(spark, sf_dir):
    return evaluate(vol(spark, sf_dir), "2*(x>300)+flip_x(x)", CALLS).df.select(*KEYS, "v")


@REG("pred_is_label_image", f"WITH {VOL_SQL}, n AS (SELECT *, lead(v) OVER (PARTITION BY img, y, z ORDER BY x) AS nx FROM vol) SELECT img, max(v) < 12 OR count(*) FILTER (WHERE nx = v) > count(*) FILTER (WHERE nx <> v) AS is_label FROM n GROUP BY img")
def is_label_image(spark, sf_dir):
    return E.is_label_image(vol(spark, sf_dir).df)


@REG("pred_has_mask", f"WITH {VOL_SQL} SELECT img, count(*) FILTER (WHERE v = 0) * 5 > count(*) OR (min(x) FILTER (WHERE v <> 0) > 0 AND max(x) FILTER (WHERE v <> 0) < 15) OR (min(y) FILTER (WHERE v <> 0) > 0 AND max(y) FILTER (WHERE v <> 0) < 11) OR (min(z) FILTER (WHERE v <> 0) > 0 AND max(z) FILTER (WHERE v <> 0) < 6) AS has_mask FROM vol GROUP BY img")
def has_mask(spark, sf_dir):
    g = vol(spark, sf_dir)
    return E.has_mask(g.df, g.shape)


for _name, _fun, _sql in (("multiply_image", None, "a * b"), ("add_image", None, "a + b"), ("minus_image", None, "a - b"), ("max_image", None, "greatest(a, b)"), ("min_image", None, "least(a, b)")):

    def _paired(spark, sf_dir, name=_name):
        g = vol(spark, sf_dir)
        second = g.with_df(g.df.where("img = 1").withColumn("img", F.lit(0).cast("long")))
        return command(g.with_df(g.df.where("img = 0")), name, "", second).df.select("idx", "v")

    REG.add(f"cmd_{_name}", _paired, f"WITH {PAIR_SQL} SELECT idx, {_sql} AS v FROM pair")
