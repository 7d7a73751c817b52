"""Segmentation, colours, label commands, file formats and windows of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import IMG_SQL, VOL_SQL, pic, table, vol
from ..functions import color
from ..layout import from_arrays, to_arrays
from ..operators import geometry as G
from ..operators import segmentation as S
from ..operators.graph import shared_path
from ..plans.commands import command
from ..sources import images
from ..streaming import running
from .morphology import waves_sql
from .registry import Registry

REG = Registry()


def _channels(spark, sf_dir):
    return vol(spark, sf_dir).df.select(F.lit(0).cast("long").alias("img"), "idx", F.col("img").alias("ch"), (F.col("v") / 4000.0).alias("p"))


def _mask(spark, sf_dir):
    g = vol(spark, sf_dir)
    return g.with_df(g.df.where("img = 0")).map((F.col("v") > 300).cast("int"))


@REG("seg_create_bg", f"WITH {VOL_SQL} SELECT idx, img + 1 AS ch, round(v / 4000.0::DOUBLE, 9) AS p FROM vol UNION ALL SELECT idx, 0 AS ch, round(greatest(1 - sum(v / 4000.0::DOUBLE), 0), 9) AS p FROM vol GROUP BY idx")
def create_bg(spark, sf_dir):
    return S.create_bg(_channels(spark, sf_dir)).select("idx", "ch", F.round("p", 9).alias("p"))


@REG("seg_clamp_prob", f"WITH {VOL_SQL} SELECT idx, img AS ch, least(greatest(v / 400.0::DOUBLE, 0), 1) AS p FROM vol")
def clamp(spark, sf_dir):
    return S.clamp_prob(_channels(spark, sf_dir).withColumn("p", F.col("p") * 10)).select("idx", "ch", F.round("p", 9).alias("p"))


REG.sql["seg_clamp_prob"] = REG.sql["seg_clamp_prob"].replace("least(greatest(v / 400.0::DOUBLE, 0), 1)", "round(least(greatest(v / 400.0::DOUBLE, 0), 1), 9)")


@REG("seg_renormalize", f"WITH {VOL_SQL} SELECT idx, img AS ch, round(v / nullif(sum(v) OVER (PARTITION BY idx), 0)::DOUBLE, 9) AS p FROM vol")
def renormalize(spark, sf_dir):
    return S.renormalize(_channels(spark, sf_dir)).select("idx", "ch", F.round("p", 9).alias("p"))


@REG("seg_argmax", f"WITH {VOL_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY v DESC, img) AS r FROM vol) SELECT vol.idx, CASE WHEN vol.v > 300 THEN b.img + 1 ELSE 0 END AS v FROM vol JOIN b ON b.idx = vol.idx AND b.r = 1 WHERE vol.img = 0")
def argmax(spark, sf_dir):
    return S.argmax(S.create_bg(_channels(spark, sf_dir)), _mask(spark, sf_dir)).df.select("idx", "v")


@REG("seg_zscore_nonzero", f"WITH {VOL_SQL}, s AS (SELECT img, avg(v) AS m, stddev_pop(v) AS s FROM vol WHERE v <> 0 GROUP BY img) SELECT vol.img, idx, round(CASE WHEN v <> 0 THEN (v - m) / s ELSE 0 END, 6) AS v FROM vol JOIN s ON s.img = vol.img")
def zscore(spark, sf_dir):
    return S.zscore_nonzero(vol(spark, sf_dir)).df.select("img", "idx", F.round("v", 6).alias("v"))


@REG("seg_fill_and_smooth_labels")
def fill_labels(spark, sf_dir):
    g = pic(spark, sf_dir)
    return S.fill_and_smooth_labels(g.map(F.when(F.col("v") > 24, F.col("v") % 3).otherwise(0)), g.map((F.col("v") > 14).cast("int")), 4, 2).df.select("idx", "v")


@REG("color_value_to_color", f"WITH {VOL_SQL}, c AS (SELECT *, CAST(least(greatest(floor(v * 255.99::DOUBLE / 500), 0), 255) AS BIGINT) AS i FROM vol) SELECT img, idx, CAST(floor(10.0::DOUBLE * (255 - i) / 255 + 250.0::DOUBLE * i / 255) AS BIGINT) AS r, CAST(floor(200.0::DOUBLE * (255 - i) / 255) AS BIGINT) AS g, CAST(floor(30.0::DOUBLE * (255 - i) / 255 + 30.0::DOUBLE * i / 255) AS BIGINT) AS b FROM c")
def value_to_color(spark, sf_dir):
    return color.value_to_color(vol(spark, sf_dir).df, color.palette(spark, (10, 200, 30), (250, 0, 30)), 0, 500).select("img", "idx", "r", "g", "b")


@REG("geo_slice_scaled", f"WITH {VOL_SQL} SELECT vol.img, CAST(t.x AS INT) AS x, CAST(u.y AS INT) AS y, v FROM vol, range(32) t(x), range(24) u(y) WHERE vol.z = 3 AND vol.x = floor(least(t.x / 2.0::DOUBLE, 15) + 0.5) AND vol.y = floor(least(u.y / 2.0::DOUBLE, 11) + 0.5)")
def slice_scaled(spark, sf_dir):
    return G.slice_scaled(vol(spark, sf_dir), "z", 3, 2.0).df.select("img", "x", "y", "v")


def _edges(name: str, steps: list[int], both: bool) -> None:
    """An edge command on labels: where a neighbour in storage order differs, the larger of all labels that do and its own."""
    w = "(PARTITION BY img ORDER BY idx)"
    near = [f"lead(v, {n}) OVER {w}" for n in steps] + ([f"lag(v, {n}) OVER {w}" for n in steps] if both else [])
    sql = f"WITH {VOL_SQL}, m AS (SELECT img, idx, v % 3 AS v FROM vol), n AS (SELECT img, idx, v, [{', '.join(near)}] AS near FROM m) SELECT img, idx, coalesce(list_max(list_transform(list_filter(near, lambda x: x <> v), lambda x: greatest(x, v))), 0) AS v FROM n"
    REG.add(f"cmd_{name}", lambda s, d: command(vol(s, d).map(F.col("v") % 3), name).df.select("img", "idx", F.col("v").cast("long").alias("v")), sql)


_edges("morphology_edge", [1, 16, 192], True)
_edges("morphology_edge_xy", [1, 16], False)
_edges("morphology_edge_xz", [1, 192], False)
_DENSE = f"{IMG_SQL}, m AS (SELECT img, x, y, z, idx, CAST(v > 18 AS BIGINT) AS v FROM pic)"
_NINE = "SELECT a.idx, CASE WHEN sum(b.v) > 4 THEN 1 WHEN sum(b.v) < 4 THEN 0 ELSE a.v END AS v FROM m a JOIN m b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.idx, a.v"
for _name, _sql in (("morphology_opening", f"{waves_sql('m', 2, False)} SELECT idx, CAST(v AS BIGINT) AS v FROM w40"), ("morphology_closing", f"{waves_sql('m', 2, True)} SELECT idx, CAST(v AS BIGINT) AS v FROM w40"), ("morphology_smoothing", _NINE)):
    REG.add(f"cmd_{_name}", lambda s, d, n=_name: command(pic(s, d).map((F.col("v") > 18).cast("long")), n).df.select("idx", F.col("v").cast("long").alias("v")), f"WITH {_DENSE}{' ' if _name.endswith('smoothing') else ', '}{_sql}")


@REG("cmd_refine_label")
def refine(spark, sf_dir):
    g = pic(spark, sf_dir)
    return command(g.map(F.col("v") % 3), "refine_label", "", g).df.select("idx", "v")


def _written(kind: str):
    """Volumes written in a format and read again through its data source."""

    def run(spark, sf_dir):
        images.register(spark)
        path = shared_path(spark, f"images-{kind}")
        g = vol(spark, sf_dir)
        eye = F.array(*[F.lit(x) for x in images.EYE])
        rows = to_arrays(g).select(F.lit(None).cast("string").alias("path"), F.concat(F.lit("v"), F.col("img")).alias("name"), F.col("img").cast("int").alias("volume"), F.array(*[F.lit(n) for n in g.shape]).alias("shape"), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("vs"), eye.alias("affine"), F.transform("data", lambda x: x.cast("double")).alias("data"))
        rows.write.format(kind).mode("append").save(path)
        back = spark.read.format(kind).load(path).select(F.regexp_extract("path", r"v(\d)-", 1).cast("long").alias("img"), "data")
        return from_arrays(back, g.shape).df.select("img", "idx", F.col("v").cast("long").alias("v"))

    return run


for _kind in ("nifti", "nrrd", "mat4"):
    REG.add(f"src_{_kind}", _written(_kind), f"WITH {VOL_SQL} SELECT img, idx, v FROM vol")


@REG("src_overwrite", f"WITH {VOL_SQL} SELECT img, idx, v FROM vol")
def overwrite(spark, sf_dir):
    """Other values, then volumes 0 and 1 in their place, then the rest beside them."""
    images.register(spark)
    path = shared_path(spark, "images-overwrite")
    g = vol(spark, sf_dir)
    numbers = lambda c: c.cast("double")
    fixed = [F.array(*[F.lit(n) for n in g.shape]).alias("shape"), F.array(*[F.lit(1.0)] * 3).alias("vs"), F.array(*[F.lit(x) for x in images.EYE]).alias("affine")]
    rows = to_arrays(g).select(F.lit(None).cast("string").alias("path"), F.concat(F.lit("v"), "img").alias("name"), F.col("img").cast("int").alias("volume"), *fixed, F.transform("data", numbers).alias("data"))
    rows.withColumn("data", F.transform("data", lambda c: c + 1)).write.format("nifti").mode("append").save(path)
    rows.where("volume < 2").write.format("nifti").mode("overwrite").save(path)
    rows.where("volume >= 2").write.format("nifti").mode("append").save(path)
    back = spark.read.format("nifti").load(path).select(F.regexp_extract("path", r"v(\d)-", 1).cast("long").alias("img"), "data")
    return from_arrays(back, g.shape).df.select("img", "idx", F.col("v").cast("long").alias("v"))


@REG("src_bmp", f"WITH {IMG_SQL} SELECT idx, v FROM pic")
def bmp(spark, sf_dir):
    images.register(spark)
    path = shared_path(spark, "images-bmp")
    g = pic(spark, sf_dir)
    rows = to_arrays(g).select(F.lit(None).cast("string").alias("path"), F.lit("p").alias("name"), F.lit(0).alias("volume"), F.array(*[F.lit(n) for n in g.shape]).alias("shape"), F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("vs"), F.array(*[F.lit(x) for x in images.EYE]).alias("affine"), F.transform("data", lambda x: x.cast("double")).alias("data"))
    rows.write.format("bmp").mode("append").save(path)
    back = spark.read.format("bmp").load(path).select(F.lit(0).cast("long").alias("img"), "data")
    return from_arrays(back, g.shape).df.select("idx", F.col("v").cast("long").alias("v"))


@REG("stream_windowed_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed(spark, sf_dir):
    w = running.windowed_counts(table(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", "event_type")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@REG("stream_sessions", "WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k")
def sessions(spark, sf_dir):
    s = running.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", "user_id")
    return s.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
