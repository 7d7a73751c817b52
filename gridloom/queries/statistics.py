"""Aggregates, histograms, thresholds, channels, clustering and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import PAIR_SQL, VOL_SQL, pair, table, vol
from ..operators import histogram as H
from ..operators import learners, mixture, ml
from ..operators import registration as R
from ..operators import stats as S
from ..operators.graph import shared_path
from ..plans.commands import command
from ..streaming import running
from .registry import Registry

REG = Registry()
SUMMARY = ["mean", "mean_square", "rms", "variance", "sd", "norm2"]


def _rounded(df, digits: int, *cols: str):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else c for c in df.columns])


@REG("agg_summary", f"WITH {VOL_SQL} SELECT img, CAST(sum(v) AS BIGINT) AS sum, round(avg(v), 6) AS mean, sum(v * v)::DOUBLE AS square_sum, round(avg(v * v), 6) AS mean_square, round(sqrt(avg(v * v)), 6) AS rms, round(var_pop(v), 6) AS variance, round(stddev_pop(v), 6) AS sd, round(sqrt(sum(v * v)), 6) AS norm2, min(v) AS min, max(v) AS max, max(abs(v)) AS max_abs FROM vol GROUP BY img")
def summary(spark, sf_dir):
    return _rounded(S.summary(vol(spark, sf_dir).df, "img"), 6, *SUMMARY)


_MED = "(SELECT img, v AS median FROM (SELECT img, v, row_number() OVER (PARTITION BY img ORDER BY v) AS r, count(*) OVER (PARTITION BY img) AS n FROM {t}) WHERE r = n // 2 + 1)"


@REG("agg_median", f"WITH {VOL_SQL} SELECT * FROM {_MED.format(t='vol')}")
def median(spark, sf_dir):
    return S.median(vol(spark, sf_dir).df.select("img", "v"), "img")


_MAD = f"WITH {VOL_SQL}, m AS {_MED.format(t='vol')}, o AS (SELECT vol.img, abs(v - median) AS v FROM vol JOIN m ON m.img = vol.img), q AS {_MED.format(t='o')}"


@REG("agg_median_absolute_deviation", _MAD + " SELECT m.img, m.median, q.median AS mad FROM m JOIN q ON q.img = m.img")
def mad(spark, sf_dir):
    return S.median_absolute_deviation(vol(spark, sf_dir).df.select("img", "v"), "img")


@REG("agg_outlier_range", _MAD + " SELECT m.img, round(m.median - 3 * 1.4826::DOUBLE * q.median, 6) AS low, round(m.median + 3 * 1.4826::DOUBLE * q.median, 6) AS high FROM m JOIN q ON q.img = m.img")
def outlier_range(spark, sf_dir):
    return _rounded(S.outlier_range(vol(spark, sf_dir).df.select("img", "v"), "img"), 6, "low", "high")


@REG("agg_sum_partial", f"WITH {VOL_SQL} SELECT img, idx % 5 AS j, CAST(sum(v) AS BIGINT) AS v FROM vol GROUP BY ALL")
def sum_partial(spark, sf_dir):
    return S.sum_partial(vol(spark, sf_dir).df, 5)


@REG("agg_pair_statistics", f"WITH {PAIR_SQL} SELECT sum(a * b)::DOUBLE AS inner_product, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse, round(covar_pop(a, b), 4) AS covariance, round(corr(a, b), 6) AS correlation, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 4) AS intercept, round(regr_r2(b, a), 6) AS r2 FROM pair")
def pair_statistics(spark, sf_dir):
    return _rounded(_rounded(S.pair_statistics(pair(spark, sf_dir)), 6, "rmse", "correlation", "slope", "r2"), 4, "covariance", "intercept")


@REG("agg_correlation_positive", f"WITH {PAIR_SQL} SELECT round(corr(a, b - 300), 6) AS correlation FROM pair WHERE b > 300")
def correlation_positive(spark, sf_dir):
    return _rounded(S.correlation_positive(pair(spark, sf_dir).withColumn("b", F.col("b") - 300)), 6, "correlation")


@REG("agg_t_statistics", f"WITH {PAIR_SQL} SELECT round((avg(a) - avg(b)) / (sqrt((var_pop(a) * (count(*) - 1) + var_pop(b) * (count(*) - 1)) / (2 * count(*) - 2)) * sqrt(2.0::DOUBLE / count(*))), 6) AS t_two, round(avg(a) * sqrt((count(*) - 1) / var_pop(a)), 6) AS t_one FROM pair")
def t_statistics(spark, sf_dir):
    return _rounded(S.t_statistics(pair(spark, sf_dir)), 6, "t_two", "t_one")


@REG("agg_center_of_mass", f"WITH {VOL_SQL} SELECT img, " + ", ".join(f"round(sum({a} * v)::DOUBLE / sum(v), 9) AS c{a}" for a in "xyz") + " FROM vol GROUP BY img")
def center_of_mass(spark, sf_dir):
    return _rounded(S.center_of_mass(vol(spark, sf_dir).df), 9, "cx", "cy", "cz")


@REG("agg_center_of_mass_binary", f"WITH {VOL_SQL} SELECT img, " + ", ".join(f"round(avg({a}), 9) AS c{a}" for a in "xyz") + " FROM vol WHERE v > 300 GROUP BY img")
def center_of_mass_binary(spark, sf_dir):
    df = vol(spark, sf_dir).df
    return _rounded(S.center_of_mass_binary(df.withColumn("v", (F.col("v") > 300).cast("int"))), 9, "cx", "cy", "cz")


@REG("agg_bounding_box", f"WITH {VOL_SQL} SELECT img, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, min(z) AS z0, max(z) + 1 AS z1, count(*) AS n FROM vol WHERE v > 400 GROUP BY img")
def bounding_box(spark, sf_dir):
    return S.bounding_box(vol(spark, sf_dir).df, 400)


for _a in "xyz":
    _k = ", ".join(b for b in "xyz" if b != _a)
    REG.add(f"agg_project_{_a}", lambda s, d, a=_a: S.project(vol(s, d).df, a), f"WITH {VOL_SQL} SELECT img, {_k}, CAST(sum(v) AS BIGINT) AS v FROM vol GROUP BY ALL")


@REG("agg_arg_extremes", f"WITH {VOL_SQL} SELECT img, (SELECT idx FROM vol q WHERE q.img = p.img ORDER BY v DESC, idx LIMIT 1) AS arg_max, (SELECT idx FROM vol q WHERE q.img = p.img ORDER BY v, idx LIMIT 1) AS arg_min FROM (SELECT DISTINCT img FROM vol) p")
def arg_extremes(spark, sf_dir):
    return S.arg_extremes(vol(spark, sf_dir).df)


@REG("agg_long_axis", f"WITH {VOL_SQL}, b AS (SELECT img, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz FROM vol WHERE v > 0 GROUP BY img) SELECT img, CASE WHEN dx >= dy AND dx >= dz THEN 0 WHEN dy >= dz THEN 1 ELSE 2 END AS axis FROM b")
def long_axis(spark, sf_dir):
    return S.long_axis(vol(spark, sf_dir))


@REG("agg_symmetric_axis", f"WITH {VOL_SQL}, d AS ({' UNION ALL '.join(f'SELECT p.img, {i} AS axis, sum(abs(p.v - q.v)) AS d FROM vol p JOIN vol q ON q.img = p.img AND ' + ' AND '.join(f'q.{b} = ' + (f'{n - 1} - p.{b}' if b == a else f'p.{b}') for b in 'xyz') + ' GROUP BY p.img' for i, (a, n) in enumerate((('x', 16), ('y', 12), ('z', 7))))}) SELECT img, CAST(axis AS INT) AS axis FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY d, axis) AS r FROM d) WHERE r = 1")
def symmetric_axis(spark, sf_dir):
    return S.symmetric_axis(vol(spark, sf_dir))


@REG("agg_region_boxes", f"WITH {VOL_SQL} SELECT img, v % 5 AS label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, max(x) - min(x) + 1 AS size_x, max(y) - min(y) + 1 AS size_y, count(*) AS n, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy FROM vol WHERE v % 5 > 0 GROUP BY img, v % 5")
def region_boxes(spark, sf_dir):
    return _rounded(S.region_boxes(vol(spark, sf_dir).df.withColumn("v", F.col("v") % 5)), 9, "cx", "cy")


def _channels(spark, sf_dir):
    return vol(spark, sf_dir).df.select("idx", F.col("img").alias("ch"), (F.col("v") / 100.0).alias("p"))


@REG("agg_argmax", f"WITH {VOL_SQL} SELECT idx, img + 1 AS label FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY v DESC, img) AS r FROM vol) WHERE r = 1")
def argmax(spark, sf_dir):
    return S.argmax_channel(_channels(spark, sf_dir))


@REG("agg_softmax", f"WITH {VOL_SQL}, e AS (SELECT idx, img AS ch, exp((v - max(v) OVER (PARTITION BY idx)) / 100.0::DOUBLE) AS e FROM vol) SELECT idx, ch, round(e / sum(e) OVER (PARTITION BY idx), 9) AS p FROM e")
def softmax(spark, sf_dir):
    return _rounded(S.softmax(_channels(spark, sf_dir)), 9, "p")


_HIST = "e AS (SELECT img, min(v) AS low, max(v) AS high FROM vol GROUP BY img), c AS (SELECT vol.img, CAST(least(greatest(floor((v - low)::DOUBLE * 256 / (high - low)::DOUBLE), 0), 255) AS INT) AS bin, count(*) AS n FROM vol JOIN e ON e.img = vol.img WHERE low < high GROUP BY ALL), h AS (SELECT e.img, CAST(b.b AS INT) AS bin, coalesce(c.n, 0) AS n, e.low, e.high FROM e CROSS JOIN range(256) b(b) LEFT JOIN c ON c.img = e.img AND c.bin = b.b WHERE low < high)"
_OTSU = "w AS (SELECT img, bin, low, high, sum(m) OVER (PARTITION BY img ORDER BY bin) AS wb, sum(m * bin) OVER (PARTITION BY img ORDER BY bin) AS sb, sum(m) OVER (PARTITION BY img) AS tw, sum(m * bin) OVER (PARTITION BY img) AS ts FROM (SELECT *, CASE WHEN bin < 1 THEN 0 ELSE n END::DOUBLE AS m FROM h)), s AS (SELECT *, CASE WHEN wb > 0 AND tw - wb > 0 AND bin < 255 THEN (sb * tw - ts * wb) * (sb * tw - ts * wb) / (wb * (tw - wb)) ELSE 0 END AS sig FROM w), o AS (SELECT img, low + bin * (high - low) / 256.0::DOUBLE AS t FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY sig DESC, bin) AS r FROM s) WHERE r = 1)"


@REG("hist_counts", f"WITH {VOL_SQL}, {_HIST} SELECT img, bin, n FROM h")
def histogram(spark, sf_dir):
    return H.histogram(vol(spark, sf_dir).df).select("img", "bin", "n")


@REG("hist_cdf", f"WITH {VOL_SQL}, {_HIST} SELECT img, bin, CAST(sum(n) OVER (PARTITION BY img ORDER BY bin) AS BIGINT) AS c FROM h")
def cdf(spark, sf_dir):
    return H.cdf(H.histogram(vol(spark, sf_dir).df)).select("img", "bin", "c")


@REG("hist_otsu_threshold", f"WITH {VOL_SQL}, {_HIST}, {_OTSU} SELECT img, round(t, 6) AS threshold FROM o")
def otsu_threshold(spark, sf_dir):
    return _rounded(H.otsu_threshold(vol(spark, sf_dir).df), 6, "threshold")


@REG("cmd_otsu_threshold", f"WITH {VOL_SQL}, {_HIST}, {_OTSU} SELECT vol.img, idx, CAST(v > t * 0.8 AS BIGINT) AS v FROM vol JOIN o ON o.img = vol.img")
def otsu(spark, sf_dir):
    return command(vol(spark, sf_dir), "otsu_threshold", "0.8").df.select("img", "idx", "v")


@REG("hist_otsu_count", f"WITH {VOL_SQL}, {_HIST}, {_OTSU} SELECT vol.img, CAST(count(*) FILTER (WHERE v > t * 0.6) AS BIGINT) AS n FROM vol JOIN o ON o.img = vol.img GROUP BY vol.img")
def otsu_count(spark, sf_dir):
    return H.otsu_count(vol(spark, sf_dir).df)


_OM = "om AS (SELECT img, v AS m FROM (SELECT vol.img, v, row_number() OVER (PARTITION BY vol.img ORDER BY v) AS r, count(*) OVER (PARTITION BY vol.img) AS n FROM vol JOIN o ON o.img = vol.img WHERE v > t) WHERE r = n // 2 + 1)"


@REG("hist_otsu_median", f"WITH {VOL_SQL}, {_HIST}, {_OTSU}, {_OM} SELECT img, m::DOUBLE AS m FROM om")
def otsu_median(spark, sf_dir):
    return H.otsu_median(vol(spark, sf_dir).df)


@REG("cmd_normalize_otsu_median", f"WITH {VOL_SQL}, {_HIST}, {_OTSU}, {_OM}, p AS (SELECT img, count(*) FILTER (WHERE v > 0) * 2 > count(*) AS much FROM vol GROUP BY img) SELECT vol.img, idx, round(least(greatest(v * (255.99::DOUBLE * 0.5) / m - CASE WHEN much THEN 255.99::DOUBLE * 0.1 ELSE 0 END, 0), 255.99), 6) AS v FROM vol JOIN om ON om.img = vol.img JOIN p ON p.img = vol.img")
def normalize_otsu_median(spark, sf_dir):
    return _rounded(command(vol(spark, sf_dir), "normalize_otsu_median").df.select("img", "idx", "v"), 6, "v")


@REG("hist_norm", f"""WITH {VOL_SQL}, {_HIST}, q AS (SELECT img, bin, sum(n) OVER (PARTITION BY img ORDER BY bin) AS c, sum(n) OVER (PARTITION BY img) AS top FROM h),
r AS (SELECT vol.*, low, high, floor((v - low)::DOUBLE * 257 / (high - low)::DOUBLE) AS r FROM vol JOIN e ON e.img = vol.img)
SELECT r.img, r.idx, round(CASE WHEN idx = 0 THEN v WHEN r.r <= 0 THEN low ELSE (high - low) * q.c / q.top::DOUBLE + low END, 6) AS v FROM r JOIN q ON q.img = r.img AND q.bin = least(greatest(r.r - 1, 0), 255)""")
def hist_norm(spark, sf_dir):
    return _rounded(H.hist_norm(vol(spark, sf_dir)).df.select("img", "idx", "v"), 6, "v")


@REG("hist_sharpening", f"WITH {VOL_SQL}, {_HIST}, b AS (SELECT *, (coalesce(lag(n) OVER w, n) + 2 * n + coalesce(lead(n) OVER w, n)) / 4.0::DOUBLE AS b FROM h WINDOW w AS (PARTITION BY img ORDER BY bin)) SELECT img, bin, round(coalesce(n * b * b / nullif(b * b + 0.01::DOUBLE * max(b * b) OVER (PARTITION BY img), 0), 0), 6) AS n FROM b")
def sharpening(spark, sf_dir):
    return _rounded(H.histogram_sharpening(vol(spark, sf_dir).df).select("img", "bin", "n"), 6, "n")


_SHARP = "b AS (SELECT *, (coalesce(lag(n) OVER w, n) + 2 * n + coalesce(lead(n) OVER w, n)) / 4.0::DOUBLE AS b FROM h WINDOW w AS (PARTITION BY img ORDER BY bin)), sh AS (SELECT img, bin, low, high, coalesce(n * b * b / nullif(b * b + 0.01::DOUBLE * max(b * b) OVER (PARTITION BY img), 0), 0) AS m FROM b)"


@REG("hist_otsu_threshold_sharpening", f"WITH {VOL_SQL}, {_HIST}, {_SHARP}, " + _OTSU.replace("(SELECT *, CASE WHEN bin < 1 THEN 0 ELSE n END::DOUBLE AS m FROM h)", "sh") + " SELECT img, round(t, 6) AS threshold FROM o")
def otsu_sharpening(spark, sf_dir):
    return _rounded(H.otsu_threshold_sharpening(vol(spark, sf_dir).df), 6, "threshold")


@REG("hist_match_signal", f"WITH {PAIR_SQL}, f AS (SELECT regr_slope(a, b) AS s, regr_intercept(a, b) AS i FROM pair WHERE a > 0 AND b > 0) SELECT idx, round(CASE WHEN b > 0 THEN b * s + i ELSE 0 END, 4) AS v FROM pair, f")
def match_signal(spark, sf_dir):
    return _rounded(H.match_signal(pair(spark, sf_dir)), 4, "v")


_JOINT = f"WITH {PAIR_SQL}, e AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM pair), j AS (SELECT CAST(least(floor((a - a0)::DOUBLE * 256 / (a1 - a0)::DOUBLE), 255) AS INT) AS p, CAST(least(floor((b - b0)::DOUBLE * 256 / (b1 - b0)::DOUBLE), 255) AS INT) AS q, count(*) AS n FROM pair, e GROUP BY ALL)"


@REG("reg_joint_histogram", _JOINT + " SELECT p, q, n FROM j")
def joint_histogram(spark, sf_dir):
    return R.joint_histogram(pair(spark, sf_dir))


@REG("reg_mutual_information", _JOINT + ", pa AS (SELECT p, sum(n) AS np FROM j GROUP BY p), qa AS (SELECT q, sum(n) AS nq FROM j GROUP BY q), t AS (SELECT sum(n) AS t FROM j) SELECT round(sum(n / t::DOUBLE * ln(n * t::DOUBLE / (np * nq))), 6) AS mi FROM j JOIN pa ON pa.p = j.p JOIN qa ON qa.q = j.q, t")
def mutual_information(spark, sf_dir):
    return _rounded(R.mutual_information(pair(spark, sf_dir)), 6, "mi")


@REG("reg_correlation_cost", f"WITH {PAIR_SQL} SELECT round(1 - corr(a, b) * corr(a, b), 9) AS cost FROM pair")
def correlation_cost(spark, sf_dir):
    g = vol(spark, sf_dir)
    one = g.with_df(g.df.where("img = 1").withColumn("img", F.lit(0).cast("long")))
    cost = R.correlation_cost(g.with_df(g.df.where("img = 0")), one, [1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0])
    return spark.createDataFrame([(round(cost, 9),)], "cost double")


def _points(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("f"))


@REG("ml_normalized_attributes", "WITH p AS (SELECT vec_id AS id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS f FROM embeddings), s AS (SELECT stddev_pop(f[1]) AS a, stddev_pop(f[2]) AS b, stddev_pop(f[3]) AS c, stddev_pop(f[4]) AS d FROM p) SELECT id, round(f[1] / a, 6) AS f1, round(f[2] / b, 6) AS f2, round(f[3] / c, 6) AS f3, round(f[4] / d, 6) AS f4 FROM p, s")
def normalized_attributes(spark, sf_dir):
    n = ml.normalized_attributes(_points(spark, sf_dir), 4)
    return n.select("id", *[F.round(F.get("f", i), 6).alias(f"f{i + 1}") for i in range(4)])


def _lloyd(rounds: int, k: int, width: int) -> str:
    """Rounds of Lloyd's algorithm over vectors of width elements as CTEs l0 .. l<rounds> of (id, label)."""
    n = range(1, width + 1)
    out = [
        "p AS (SELECT vec_id AS id, list_transform(embedding[1:" + str(width) + "], lambda x: x::DOUBLE) AS f FROM embeddings), sd AS (SELECT " + ", ".join(f"stddev_pop(f[{i}]) AS s{i}" for i in n) + " FROM p)",
        "q AS (SELECT id, " + ", ".join(f"f[{i}] / s{i} AS f{i}" for i in n) + " FROM p, sd)",
        f"l0 AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) % {k} AS label FROM q)",
    ]
    for r in range(rounds):
        out.append(f"c{r} AS (SELECT label, " + ", ".join(f"avg(f{i}) AS m{i}" for i in n) + f" FROM q JOIN l{r} USING (id) GROUP BY label)")
        d = " + ".join(f"(f{i} - m{i}) * (f{i} - m{i})" for i in n)
        out.append(f"l{r + 1} AS MATERIALIZED (SELECT id, label FROM (SELECT q.id, c{r}.label, row_number() OVER (PARTITION BY q.id ORDER BY round({d}, 12), c{r}.label) AS o FROM q, c{r}) WHERE o = 1)")
    return ", ".join(out)


@REG("ml_k_means", f"WITH {_lloyd(40, 4, 64)} SELECT id, CAST(label AS INT) AS label FROM l40")
def k_means(spark, sf_dir):
    """Whole vectors, until no label changes. The SQL stops after 40 rounds: where labels take longer to settle, it has other ones."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    return ml.k_means(rows, 4, 64)


@REG("ml_expectation_maximization")
def em(spark, sf_dir):
    """Whole vectors, until the labels have settled."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    return mixture.expectation_maximization(rows, 3, 64)


@REG("ml_error_rate", "SELECT avg(CASE WHEN quality <> toxic THEN 1.0::DOUBLE ELSE 0 END) AS error FROM labels")
def error_rate(spark, sf_dir):
    return ml.error_rate(table(spark, sf_dir, "labels"), "quality", "toxic")


@REG("ml_mean_squared_error", "SELECT round(avg((p_size - p_retailprice / 100) * (p_size - p_retailprice / 100)), 6) AS error FROM part")
def squared_error(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("guess", F.col("p_retailprice") / 100)
    return _rounded(ml.error_rate(p, "p_size", "guess", True), 6, "error")


@REG("stream_running_statistics", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(avg(value * value) - avg(value) * avg(value), 4) AS variance FROM events GROUP BY event_type")
def running_statistics(spark, sf_dir):
    r = running.running_statistics(table(spark, sf_dir, "events"), "event_type", "value")
    return r.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


_WIDTH = range(1, 65)
_LABELLED = "p AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings WHERE label IS NOT NULL)"
_FAR = " + ".join(f"(f[{i}] - m{i}) * (f[{i}] - m{i})" for i in _WIDTH)
_ONE_VS_REST = f"""
WITH {_LABELLED}, m AS (SELECT label AS c, {", ".join(f"avg(f[{i}]) AS m{i}" for i in _WIDTH)} FROM p GROUP BY label),
s AS (SELECT id, c, 1 / (1 + {_FAR}) AS s FROM p, m)
SELECT id, arg_max(c, (s, -c)) AS prediction, round(sum(s * c) / sum(c), 9) AS value FROM s GROUP BY id
"""
_LEAVE_OUT = f"""
WITH {_LABELLED}, q AS (SELECT *, (row_number() OVER (ORDER BY id) - 1) // 10 AS block FROM p),
b AS (SELECT block, label AS c, count(*) AS k, {", ".join(f"sum(f[{i}]) AS b{i}" for i in _WIDTH)} FROM q GROUP BY ALL),
t AS (SELECT c, sum(k) AS tk, {", ".join(f"sum(b{i}) AS t{i}" for i in _WIDTH)} FROM b GROUP BY c),
g AS (SELECT block FROM q GROUP BY block HAVING count(*) = 10),
m AS (SELECT g.block, t.c, {", ".join(f"(t{i} - coalesce(b{i}, 0)) / (tk - coalesce(k, 0)) AS m{i}" for i in _WIDTH)}
      FROM g CROSS JOIN t LEFT JOIN b ON b.block = g.block AND b.c = t.c WHERE tk > coalesce(k, 0)),
r AS (SELECT q.block, q.id, q.label, arg_min(m.c, (round({_FAR}, 12), m.c)) AS best FROM q JOIN m USING (block) GROUP BY ALL)
SELECT block, avg(CASE WHEN best <> label THEN 1.0::DOUBLE ELSE 0 END) AS error FROM r GROUP BY block
"""


def _labelled(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"), "label")


@REG("ml_one_vs_rest", _ONE_VS_REST)
def one_vs_rest(spark, sf_dir):
    """A model a label from whole vectors, saved, loaded and applied to every row."""
    rows, path = _labelled(spark, sf_dir), shared_path(spark, "model")
    learners.OneVsRest(learners.MeanScore()).fit(rows).save(path)
    return learners.OneVsRestModel.load(path).transform(rows).select("id", "prediction", F.round("value", 9).alias("value"))


@REG("ml_leave_n_out", _LEAVE_OUT)
def leave_n_out(spark, sf_dir):
    """Blocks of ten rows, each tried by the means of all other rows."""
    return learners.leave_n_out(_labelled(spark, sf_dir), 10, 64)
