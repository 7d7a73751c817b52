"""Morphology, connected components and label operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import IMG_SQL, VOL_SQL, pic, vol
from ..operators import ml
from ..operators import morphology as M
from ..plans.commands import command
from .registry import Registry

REG = Registry()
MASK_SQL = VOL_SQL + ", m AS (SELECT img, x, y, z, idx, CAST(v > 300 AS INT) AS v FROM vol)"
FACE = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= 1"
CUBE = "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1"


def mask(spark, sf_dir):
    return vol(spark, sf_dir).map((F.col("v") > 300).cast("int"))


def labels(spark, sf_dir):
    return vol(spark, sf_dir).map((F.col("v") % 5).cast("int"))


def _near(value: str, reach: str, base: str = "m") -> str:
    return f"SELECT a.img, a.idx, {value} AS v FROM {base} a JOIN {base} b ON a.img = b.img AND {reach} GROUP BY a.img, a.idx, a.v"


def _q(name: str, run, sql: str | None) -> None:
    REG.add(name, lambda s, d: run(mask(s, d)).df.select("img", "idx", "v"), f"WITH {MASK_SQL} {sql}" if sql else None)


_q("morph_erosion", M.erosion, _near("min(b.v)", FACE))
_q("morph_dilation", M.dilation, _near("max(b.v)", FACE))
_q("morph_erosion_by_radius", lambda g: M.erosion_by_radius(g, 2), _near("CAST(a.v = 1 AND count(*) FILTER (WHERE b.v = 1) = 33 AS INT)", "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 4"))
_q("morph_dilation_by_radius", lambda g: M.dilation_by_radius(g, 2), _near("max(b.v)", "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 4"))
_q("morph_smoothing", M.smoothing, _near("CASE WHEN sum(b.v) > 13 THEN 1 WHEN sum(b.v) < 13 THEN 0 ELSE a.v END", CUBE))
_q("morph_smoothing_fill", lambda g: M.smoothing(g, True), _near("CASE WHEN sum(b.v) > 13 THEN 1 ELSE a.v END", CUBE))
_q("morph_is_edge", M.is_edge, _near("CAST(min(b.v) <> max(b.v) AS INT)", CUBE))
_q("morph_inner_edge", M.inner_edge, _near("CAST(max(b.v) > a.v AS INT)", CUBE))
_q("morph_negate", M.negate, "SELECT img, idx, 1 - v AS v FROM m")


def waves_sql(base: str, dim: int, closes: bool, rounds: int = 40, w: str = "w") -> str:
    """CTEs w0 to w<rounds> (or of another letter) of a mask (img, x, y, z, idx, v): waves at each image's limit; settled waves repeat themselves."""
    half, top = (13, 8) if dim == 3 else (4, 4)
    near = "SELECT a.img, a.x, a.y, a.z, a.idx, a.v, coalesce(b.n, 0) AS n FROM {w} a LEFT JOIN (SELECT img, x + o.dx AS x, y + o.dy AS y, z + o.dz AS z, count(*) AS n FROM {w}, {o} o WHERE v = 1 GROUP BY ALL) b ON a.img = b.img AND a.x = b.x AND a.y = b.y AND a.z = b.z"
    limit = f"least({top}, max(n) FILTER (WHERE v = 0) - {half + 1})" if closes else f"least({top}, {half - 1} - min(n) FILTER (WHERE v = 1))"
    value = f"CASE WHEN t >= 0 AND n > {half} + t THEN 1 ELSE v END" if closes else f"CASE WHEN t >= 0 AND n < {half} - t THEN 0 ELSE v END"
    depth = "range(-1, 2)" if dim == 3 else "range(0, 1)"
    out = [f"o{w} AS MATERIALIZED (SELECT i.i AS dx, j.i AS dy, k.i AS dz FROM range(-1, 2) i(i), range(-1, 2) j(i), {depth} k(i))", f"{w}0 AS MATERIALIZED (SELECT img, x, y, z, idx, v FROM {base})", f"t{w} AS MATERIALIZED (SELECT img, {limit} AS t FROM ({near.format(w=w + '0', o='o' + w)}) GROUP BY img)"]
    out += [f"{w}{k + 1} AS MATERIALIZED (SELECT img, x, y, z, idx, {value} AS v FROM ({near.format(w=f'{w}{k}', o=f'o{w}')}) JOIN t{w} USING (img))" for k in range(rounds)]
    return ", ".join(out)


for _name, _op, _closes in (("opening", M.opening, False), ("closing", M.closing, True)):
    REG.add(f"morph_{_name}", lambda s, d, op=_op: op(mask(s, d)).df.select("img", "idx", "v"), f"WITH {MASK_SQL}, {waves_sql('m', 3, _closes)} SELECT img, idx, CAST(v AS INT) AS v FROM w40")
_S = "(PARTITION BY img ORDER BY idx)"


def _edge(kind: str, steps: list[int], both: bool) -> None:
    hits = [f"coalesce(lead(v, {n}) OVER {_S} <> v, false)" for n in steps] + ([f"coalesce(lag(v, {n}) OVER {_S} <> v, false)" for n in steps] if both else [])
    _q(f"morph_edge_{kind}", lambda g: M.edge(g, kind), f"SELECT img, idx, CAST({' OR '.join(hits)} AS INT) AS v FROM m")


_edge("all", [1, 16, 192], True)
_edge("thin", [1, 16, 192], False)
_edge("xy", [1, 16], False)
_edge("yz", [16, 192], False)
_edge("xz", [1, 192], False)
_q("morph_convex_x", M.convex_x, "SELECT img, idx, CASE WHEN min(CASE WHEN v > 0 THEN x END) OVER w < max(CASE WHEN v > 0 THEN x END) OVER w AND x BETWEEN min(CASE WHEN v > 0 THEN x END) OVER w AND max(CASE WHEN v > 0 THEN x END) OVER w THEN 1 ELSE v END AS v FROM m WINDOW w AS (PARTITION BY img, y, z)")


@REG("morph_neighbor_count", f"WITH {MASK_SQL} SELECT a.img, a.x, a.y, a.z, CAST(sum(b.v) AS BIGINT) AS n FROM m a JOIN m b ON a.img = b.img AND {CUBE} GROUP BY ALL HAVING sum(b.v) > 0")
def neighbor_count(spark, sf_dir):
    g = mask(spark, sf_dir)
    return M.neighbor_count(g).join(g.df.select("img", "x", "y", "z"), ["img", "x", "y", "z"])


@REG("morph_dilation_labels", f"WITH {VOL_SQL}, m AS (SELECT img, x, y, z, idx, CAST(v % 5 AS INT) AS v FROM vol) {_near('bit_or(b.v)', FACE)}")
def dilation_labels(spark, sf_dir):
    return M.dilation(labels(spark, sf_dir)).df.select("img", "idx", "v")


@REG("morph_smoothing_multiple_region", f"WITH {VOL_SQL}, m AS (SELECT img, x, y, z, idx, CAST(v % 5 AS INT) AS v FROM vol), c AS (SELECT a.img, a.idx, a.v AS old, b.v AS u, count(*) AS n FROM m a JOIN m b ON a.img = b.img AND {CUBE} GROUP BY ALL) SELECT img, idx, CASE WHEN n > 13 THEN u ELSE old END AS v FROM (SELECT *, row_number() OVER (PARTITION BY img, idx ORDER BY n DESC, u) AS r FROM c) WHERE r = 1")
def smoothing_regions(spark, sf_dir):
    return M.smoothing_multiple_region(labels(spark, sf_dir)).df.select("img", "idx", "v")


def _threshold(name: str, fun, value: str) -> None:
    def run(spark, sf_dir):
        g = vol(spark, sf_dir)
        return fun(mask(spark, sf_dir), g, 250.0).df.select("img", "idx", "v")

    REG.add(name, run, f"WITH {MASK_SQL}, e AS ({_near(value, FACE)}) SELECT e.img, e.idx, CASE WHEN vol.v > 250 THEN e.v ELSE m.v END AS v FROM e JOIN m ON m.img = e.img AND m.idx = e.idx JOIN vol ON vol.img = e.img AND vol.idx = e.idx")


_threshold("morph_erosion_by_threshold", M.erosion_by_threshold, "min(b.v)")
_threshold("morph_dilation_by_threshold", M.dilation_by_threshold, "max(b.v)")

#: Components of pic > 22 by spreading the smallest index; the DuckDB side repeats until nothing is new.
CC_SQL = IMG_SQL + """, n AS (SELECT idx, x, y FROM pic WHERE v > 22), e AS (SELECT a.idx AS a, b.idx AS b FROM n a JOIN n b ON abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT idx AS root, idx FROM n UNION SELECT reach.root, e.b FROM reach JOIN e ON e.a = reach.idx),
cc AS (SELECT idx, min(root) AS label FROM reach GROUP BY idx)"""
CC = "WITH RECURSIVE " + CC_SQL


def spots(spark, sf_dir):
    return pic(spark, sf_dir).map((F.col("v") > 22).cast("int"))


@REG("cc_components", CC + " SELECT idx, label FROM cc")
def components(spark, sf_dir):
    return M.components(spots(spark, sf_dir)).select("idx", "label")


@REG("cc_labeling", CC + ", o AS (SELECT label, row_number() OVER (ORDER BY label) AS k FROM (SELECT DISTINCT label FROM cc)) SELECT pic.idx, coalesce(o.k, 0) AS v FROM pic LEFT JOIN cc ON cc.idx = pic.idx LEFT JOIN o ON o.label = cc.label")
def labeling(spark, sf_dir):
    return M.connected_component_labeling(spots(spark, sf_dir)).df.select("idx", "v")


@REG("cc_sizes", CC + " SELECT label, count(*) AS n FROM cc GROUP BY label")
def sizes(spark, sf_dir):
    return M.component_sizes(spots(spark, sf_dir)).select("label", "n")


_BIG = ", s AS (SELECT label, count(*) AS n FROM cc GROUP BY label), top AS (SELECT label FROM s ORDER BY n DESC, label LIMIT 1)"


@REG("cmd_morphology_defragment", CC + _BIG + " SELECT pic.idx, CASE WHEN top.label IS NULL THEN 0 ELSE 1 END AS v FROM pic LEFT JOIN cc ON cc.idx = pic.idx LEFT JOIN top ON top.label = cc.label")
def defragment(spark, sf_dir):
    return command(spots(spark, sf_dir), "morphology_defragment").df.select("idx", "v")


@REG("cmd_morphology_defragment_by_size", CC + _BIG + " SELECT pic.idx, CASE WHEN s.n > floor((SELECT max(n) FROM s) * 0.5) THEN 1 ELSE 0 END AS v FROM pic LEFT JOIN cc ON cc.idx = pic.idx LEFT JOIN s ON s.label = cc.label")
def defragment_by_size(spark, sf_dir):
    return command(spots(spark, sf_dir), "morphology_defragment_by_size", "0.5").df.select("idx", "v")


_ZERO = "WITH RECURSIVE " + CC_SQL.replace("WHERE v > 22", "WHERE v <= 18")


def dense(spark, sf_dir):
    return pic(spark, sf_dir).map((F.col("v") > 18).cast("int"))


@REG("cmd_morphology_fill_holes", _ZERO + _BIG + " SELECT pic.idx, CASE WHEN pic.v > 18 OR top.label IS NULL THEN 1 ELSE 0 END AS v FROM pic LEFT JOIN cc ON cc.idx = pic.idx LEFT JOIN top ON top.label = cc.label")
def fill_holes(spark, sf_dir):
    return command(dense(spark, sf_dir), "morphology_fill_holes").df.select("idx", "v")


@REG("cmd_morphology_fill_holes_by_slice", _ZERO + ", t AS (SELECT cc.label, bool_or(x = 0 OR x = 31 OR y = 0 OR y = 23) AS b FROM cc JOIN pic ON pic.idx = cc.idx GROUP BY cc.label) SELECT pic.idx, CASE WHEN pic.v > 18 OR NOT t.b THEN 1 ELSE 0 END AS v FROM pic LEFT JOIN cc ON cc.idx = pic.idx LEFT JOIN t ON t.label = cc.label")
def fill_holes_by_slice(spark, sf_dir):
    return command(dense(spark, sf_dir), "morphology_fill_holes_by_slice").df.select("idx", "v")


@REG("cc_region_growing", "WITH RECURSIVE " + IMG_SQL + ", n AS (SELECT idx, x, y FROM pic WHERE v BETWEEN 20 AND 40), g AS (SELECT idx, x, y FROM n WHERE idx % 50 = 0 UNION SELECT n.idx, n.x, n.y FROM g JOIN n ON abs(g.x - n.x) <= 1 AND abs(g.y - n.y) <= 1) SELECT DISTINCT idx FROM g")
def region_growing(spark, sf_dir):
    g = pic(spark, sf_dir)
    return M.region_growing(g, g.df.where("idx % 50 = 0").select("img", "idx"), 20, 40).select("idx")


@REG("cmd_morphology_dilation", f"WITH {VOL_SQL}, m AS (SELECT img, x, y, z, idx, v % 3 AS v FROM vol) SELECT a.img, a.idx, coalesce(max(b.v), 0) AS v FROM m a JOIN m b ON a.img = b.img AND {FACE} GROUP BY a.img, a.idx")
def dilation_by_label(spark, sf_dir):
    return command(vol(spark, sf_dir).map((F.col("v") % 3)), "morphology_dilation").df.select("img", "idx", F.col("v").cast("long").alias("v"))


@REG("cmd_morphology_erosion", f"WITH {VOL_SQL}, m AS (SELECT img, x, y, z, idx, v % 3 AS v FROM vol) SELECT a.img, a.idx, CASE WHEN min(b.v) = max(b.v) THEN a.v ELSE 0 END AS v FROM m a JOIN m b ON a.img = b.img AND {FACE} GROUP BY a.img, a.idx, a.v")
def erosion_by_label(spark, sf_dir):
    return command(vol(spark, sf_dir).map((F.col("v") % 3)), "morphology_erosion").df.select("img", "idx", F.col("v").cast("long").alias("v"))


@REG("label_refine")
def refine(spark, sf_dir):
    g = vol(spark, sf_dir)
    return ml.refine_label(g.map(F.col("v") % 3), g, 2).df.select("img", "idx", "v")


@REG("cmd_crop_to_fit")
def crop_to_fit(spark, sf_dir):
    return command(vol(spark, sf_dir).map(F.when(F.col("v") > 450, F.col("v")).otherwise(0)), "crop_to_fit", "1").df.select("img", "x", "y", "z", "v")
