"""Geometry: flips, swaps, crops, padding, slices, sparse forms, concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import VOL_SQL, vol
from ..operators import geometry as G
from ..plans.commands import command
from .registry import Registry

REG = Registry()
OUT = ["img", "x", "y", "z", "v"]


def _q(name: str, run, select: str, where: str = "") -> None:
    REG.add(name, lambda s, d: run(vol(s, d)).df.select(OUT), f"WITH {VOL_SQL} SELECT img, {select}, v FROM vol {where}")


def _grid(name: str, run, shape: tuple[int, int, int], source: str) -> None:
    """A result on a whole new grid: each voxel (x, y, z) takes the source voxel that `source` names, 0 where it has none."""
    w, h, d = shape
    REG.add(name, lambda s, dd: run(vol(s, dd)).df.select(OUT), f"WITH {VOL_SQL}, t AS (SELECT i.i AS img, CAST(n.n % {w} AS INT) AS x, CAST((n.n // {w}) % {h} AS INT) AS y, CAST(n.n // {w * h} AS INT) AS z FROM range(4) i(i), range({w * h * d}) n(n)) SELECT t.img, t.x, t.y, t.z, coalesce(vol.v, 0) AS v FROM t LEFT JOIN vol ON vol.img = t.img AND {source}")


_q("cmd_flip_x", lambda g: command(g, "flip_x"), "15 - x AS x, y, z")
_q("cmd_flip_y", lambda g: command(g, "flip_y"), "x, 11 - y AS y, z")
_q("cmd_flip_z", lambda g: command(g, "flip_z"), "x, y, 6 - z AS z")
_q("geo_flip_xy", G.flip_xy, "15 - x AS x, 11 - y AS y, z")
_q("cmd_swap_xy", lambda g: command(g, "swap_xy"), "y AS x, x AS y, z")
_q("cmd_swap_xz", lambda g: command(g, "swap_xz"), "z AS x, y, x AS z")
_q("cmd_swap_yz", lambda g: command(g, "swap_yz"), "x, z AS y, y AS z")
_q("geo_flip_codes", lambda g: G.compose_codes(g, [3, 0, 4]), "11 - y AS x, z AS y, x AS z")
_q("geo_reorder", lambda g: G.reorder(g, (2, 0, 1), (True, False, False)), "6 - z AS x, x AS y, y AS z")
_q("geo_crop", lambda g: G.crop(g, (2, 3, 1), (10, 9, 5)), "x - 2 AS x, y - 3 AS y, z - 1 AS z", "WHERE x >= 2 AND x < 10 AND y >= 3 AND y < 9 AND z >= 1 AND z < 5")
_q("geo_fill_rect", lambda g: G.fill_rect(g, (2, 3, 1), (10, 9, 5), 0), "x, y, z")
REG.sql["geo_fill_rect"] = f"WITH {VOL_SQL} SELECT img, x, y, z, CASE WHEN x BETWEEN 2 AND 9 AND y BETWEEN 3 AND 8 AND z BETWEEN 1 AND 4 THEN 0 ELSE v END AS v FROM vol"
_q("geo_draw_line", lambda g: G.draw_line(g, 1, 2, 13, 8, 9999), "x, y, z")
REG.sql["geo_draw_line"] = f"WITH {VOL_SQL} SELECT img, x, y, z, CASE WHEN x BETWEEN 1 AND 13 AND y = 2 + (2 * (x - 1) * 6 + 12) // 24 THEN 9999 ELSE v END AS v FROM vol"
_grid("geo_crop_padded", lambda g: G.crop(g, (-2, -1, 0), (10, 9, 5)), (12, 10, 5), "vol.x = t.x - 2 AND vol.y = t.y - 1 AND vol.z = t.z")
_grid("geo_move", lambda g: G.move(g, (3, -2, 1)), (16, 12, 7), "vol.x = t.x - 3 AND vol.y = t.y + 2 AND vol.z = t.z - 1")
_grid("cmd_resize", lambda g: command(g, "resize", "20 10 8"), (20, 10, 8), "vol.x = t.x AND vol.y = t.y AND vol.z = t.z")
_grid("cmd_reshape", lambda g: command(g, "reshape", "8 8 8"), (8, 8, 8), "vol.x = t.x AND vol.y = t.y AND vol.z = t.z")
_grid("cmd_resize_at_center", lambda g: command(g, "resize_at_center", "20 8 7"), (20, 8, 7), "vol.x = t.x - 2 AND vol.y = t.y + 2 AND vol.z = t.z")
_grid("cmd_translocate_integer", lambda g: command(g, "translocate", "2 0 -1"), (16, 12, 7), "vol.x = t.x - 2 AND vol.y = t.y AND vol.z = t.z + 1")
_grid("geo_mosaic", lambda g: G.mosaic(g, 3, 2), (48, 24, 1), "vol.z % 2 = 0 AND t.x = vol.x + ((vol.z // 2) % 3) * 16 AND t.y = vol.y + ((vol.z // 2) // 3) * 12")
for _a, _p, _n in (("x", "y AS x, z AS y, 0 AS z", 5), ("y", "x, z AS y, 0 AS z", 4), ("z", "x, y, 0 AS z", 3)):
    _q(f"geo_slice_{_a}", lambda g, a=_a, n=_n: G.slice_of(g, a, n), _p, f"WHERE {_a} = {_n}")


@REG("cmd_concatenate_image", f"WITH {VOL_SQL} SELECT x, y, z, v FROM vol WHERE img = 0 UNION ALL SELECT x, y, z + 7 AS z, v FROM vol WHERE img = 1")
def concatenate(spark, sf_dir):
    g = vol(spark, sf_dir)
    second = g.with_df(g.df.where("img = 1").withColumn("img", F.lit(0).cast("long")))
    return command(g.with_df(g.df.where("img = 0")), "concatenate_image", "", second).df.select("x", "y", "z", "v")


@REG("geo_trim", f"WITH {VOL_SQL}, b AS (SELECT img, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM vol WHERE v > 400 GROUP BY img) SELECT vol.img, x - x0 AS x, y - y0 AS y, z - z0 AS z, CASE WHEN v > 400 THEN v ELSE 0 END AS v FROM vol JOIN b ON b.img = vol.img WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1")
def trim(spark, sf_dir):
    g = vol(spark, sf_dir)
    return G.trim(g.map(F.when(F.col("v") > 400, F.col("v")).otherwise(0))).select(OUT)


@REG("geo_draw_add", f"WITH {VOL_SQL} SELECT p.img, p.x, p.y, p.z, p.v + coalesce(q.v, 0) AS v FROM vol p LEFT JOIN vol q ON q.img = p.img AND q.x = p.x - 2 AND q.y = p.y + 1 AND q.z = p.z")
def draw_add(spark, sf_dir):
    g = vol(spark, sf_dir)
    return G.draw(g, g, (2, -1, 0), add=True).df.select(OUT)


@REG("geo_draw_if", f"WITH {VOL_SQL} SELECT p.img, p.x, p.y, p.z, coalesce(q.v, p.v) AS v FROM vol p LEFT JOIN vol q ON q.img = p.img AND q.x = p.x - 2 AND q.y = p.y AND q.z = p.z AND q.v > 300")
def draw_if(spark, sf_dir):
    g = vol(spark, sf_dir)
    return G.draw(g, g, (2, 0, 0), where=F.col("v") > 300).df.select(OUT)


@REG("geo_points", f"WITH {VOL_SQL} SELECT img, x, y, z, CAST(v > 350 AS INT) AS v FROM vol")
def points(spark, sf_dir):
    g = vol(spark, sf_dir)
    return G.points_to_volume(G.volume_to_points(g.map((F.col("v") > 350).cast("int"))), g).df.select(OUT)


@REG("geo_sparse_index", f"WITH {VOL_SQL} SELECT img, idx, row_number() OVER (PARTITION BY img ORDER BY idx) - 1 AS si FROM vol WHERE v > 350")
def sparse_index(spark, sf_dir):
    return G.sparse_index(vol(spark, sf_dir).map((F.col("v") > 350).cast("int")))


@REG("geo_expand_labels", f"WITH {VOL_SQL} SELECT img, x, y, CAST(z + (k.k - 1) * 7 AS INT) AS z, CAST(v % 4 = k.k AS BIGINT) AS v FROM vol, range(1, 4) k(k)")
def expand_labels(spark, sf_dir):
    return G.expand_labels(vol(spark, sf_dir).map(F.col("v") % 4), 3).df.select(OUT)


@REG("geo_remove_channel", f"WITH {VOL_SQL} SELECT img, x, y, CASE WHEN z >= 4 THEN z - 2 ELSE z END AS z, v FROM vol WHERE z < 2 OR z >= 4")
def remove_channel(spark, sf_dir):
    return G.remove_channel(vol(spark, sf_dir), 1, 2).df.select(OUT)


@REG("sort_arg_sort", f"WITH {VOL_SQL} SELECT img, row_number() OVER (PARTITION BY img ORDER BY v, idx) - 1 AS place, idx FROM vol")
def arg_sort(spark, sf_dir):
    from pyspark.sql import Window

    return vol(spark, sf_dir).df.select("img", (F.row_number().over(Window.partitionBy("img").orderBy("v", "idx")).cast("long") - 1).alias("place"), "idx")


@REG("cmd_header", None)
def header(spark, sf_dir):
    """Affines and voxel sizes after the commands that change nothing but the header."""
    g = vol(spark, sf_dir)
    rows = []
    for name, p in (("set_transformation", "2 0 0 1 0 3 0 2 0 0 4 3 0 0 0 1"), ("set_translocation", "5 6 7"), ("set_mni", "1"), ("header_flip_x", ""), ("header_flip_y", ""), ("header_flip_z", ""), ("header_swap_xy", ""), ("header_swap_xz", ""), ("header_swap_yz", "")):
        r = command(g, name, p)
        rows.append((name, [float(x) for x in r.affine], [float(x) for x in r.vs], r.is_mni))
    return spark.createDataFrame(rows, "name string, affine array<double>, vs array<double>, is_mni boolean")
