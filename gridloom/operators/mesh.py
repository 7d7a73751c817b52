"""Surfaces as indexed meshes: vertices shared by the triangles around them, faces, normals, and drawing orders.

Cells of eight voxels are cut into six tetrahedra around their main diagonal, in the same way everywhere, so neighbouring
cells meet in the same edges and no table of cases is needed. A voxel is inside if its value is at most the level. A vertex
lies where the surface cuts an edge between an inside and an outside voxel; its number is made of the edge, eight times the
storage index of the edge's lower end plus the edge's direction (a bit an axis; 0 for a vertex on a voxel whose value is the
level). So a vertex has one number in all triangles, found without looking at any other, and vertices are merged by it.

Corners come by windows along each axis; cells that the surface doesn't cross are dropped before anything is exploded. No
task holds an image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..layout import AXES, Grid
from .graph import dense_index
from .stencil import planes

#: Six paths from corner 0 to corner 7 that set one bit (x 1, y 2, z 4) at a time.
TETRAHEDRA = [(0, 1 << a, 1 << a | 1 << b, 7) for a in range(3) for b in range(3) if a != b]
#: Triangles of a tetrahedron by the number of its inside corners, as edges (inside, outside) of its corners, inside ones first.
CUTS = {1: [[(0, 1), (0, 2), (0, 3)]], 2: [[(0, 2), (0, 3), (1, 3)], [(0, 2), (1, 3), (1, 2)]], 3: [[(0, 3), (1, 3), (2, 3)]]}


def cells(grid: Grid) -> DataFrame:
    """(img, x, y, z, idx, c0 .. c7): the values at the corners of each cell, in doubles."""
    df = planes(grid.df.select("img", *AXES, "idx", F.col("v").cast("double").alias("c0")), grid.dim)
    for bit, a in enumerate(AXES):
        w = grid.line(a)
        df = df.withColumns({f"c{k | 1 << bit}": F.lead(f"c{k}").over(w) for k in range(1 << bit)})
    return df.where("c7 IS NOT NULL")


def triangles(grid: Grid, level: float) -> DataFrame:
    """(img, face, p): p holds three vertices (number, x, y, z), turned so that they run counterclockwise seen from outside, where
    values are above the level."""
    w, h, _ = grid.shape
    all_, level_ = [f"c{k}" for k in range(8)], F.lit(float(level))
    crossed = cells(grid).where((F.least(*all_) <= level_) & (F.greatest(*all_) > level_))
    corner = [F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("v"), *[(F.col(a) + (k >> i & 1)).cast("double").alias(a) for i, a in enumerate(AXES)]) for k in range(8)]
    parts = F.array(*[F.array(*[corner[k] for k in t]) for t in TETRAHEDRA])
    rows = crossed.select("img", "idx", F.posexplode(parts).alias("tet", "t"))
    inside, outside = F.filter("t", lambda c: c["v"] <= level_), F.filter("t", lambda c: c["v"] > level_)
    rows = rows.withColumn("n", F.size(inside)).where("n BETWEEN 1 AND 3").select("img", "idx", "tet", "n", F.concat(inside, outside).alias("o"))
    o = lambda i: F.get("o", i)

    def vertex(i: int, j: int) -> Column:
        a, b = o(i), o(j)
        on = a["v"] == level_
        t = (level_ - a["v"]) / (b["v"] - a["v"])
        low, both = F.least(a["k"], b["k"]), F.greatest(a["k"], b["k"])
        step = lambda k: k.bitwiseAND(F.lit(1)) + w * F.shiftright(k, 1).bitwiseAND(F.lit(1)) + w * h * F.shiftright(k, 2)
        number = F.when(on, (F.col("idx") + step(a["k"])) * 8).otherwise((F.col("idx") + step(low)) * 8 + (both - low))
        return F.struct(number.cast("long").alias("vertex"), *[(a[c] + F.when(on, F.lit(0.0)).otherwise(t * (b[c] - a[c]))).alias(c) for c in AXES])

    cut = F.lit(None)
    for n, faces_ in CUTS.items():
        cut = F.when(F.col("n") == n, F.array(*[F.array(*[vertex(i, j) for i, j in f]) for f in faces_])).otherwise(cut)
    # the surface's normal goes with the way from the inside corners' mean to the outside corners' mean
    mean = lambda c, begin, size: F.aggregate(F.slice("o", begin, size), F.lit(0.0), lambda s, p: s + p[c]) / size
    out = F.array(*[mean(c, F.col("n") + 1, 4 - F.col("n")) - mean(c, F.lit(1), F.col("n")) for c in AXES])
    rows = rows.select("img", "idx", "tet", out.alias("out"), F.posexplode(cut).alias("k", "p"))
    p = lambda i: F.get("p", i)
    rows = rows.where((p(0)["vertex"] != p(1)["vertex"]) & (p(1)["vertex"] != p(2)["vertex"]) & (p(0)["vertex"] != p(2)["vertex"]))
    with_ = sum((c * F.get("out", i) for i, c in enumerate(cross(p(0), p(1), p(2)))), F.lit(0.0))
    turned = F.when(with_ < 0, F.array(p(0), p(2), p(1))).otherwise(F.col("p"))
    return rows.select("img", ((F.col("idx") * 6 + F.col("tet")) * 2 + F.col("k")).cast("long").alias("face"), turned.alias("p"))


def cross(a: Column, b: Column, c: Column) -> list[Column]:
    """(b - a) x (c - a) of points with x, y, z."""
    u, v = [b[k] - a[k] for k in AXES], [c[k] - a[k] for k in AXES]
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def vertices(tri: DataFrame) -> DataFrame:
    """(img, vertex, x, y, z) of triangles, each once."""
    p = tri.select("img", F.explode("p").alias("p"))
    return p.groupBy("img", F.col("p.vertex").alias("vertex")).agg(*[F.first(f"p.{a}").alias(a) for a in AXES])


def faces(tri: DataFrame) -> DataFrame:
    """(img, face, a, b, c): the numbers of each triangle's vertices."""
    return tri.select("img", "face", *[F.get("p", i)["vertex"].alias(k) for i, k in enumerate("abc")])


def normals(tri: DataFrame) -> DataFrame:
    """(img, vertex, nx, ny, nz): the sum of the unit normals of the triangles around each vertex, of length 1 again; triangles
    without area give none, and where normals cancel out the sum stays 0."""
    p = [F.get("p", i) for i in range(3)]
    rows = tri.select("img", "p", *[c.alias(f"n{a}") for a, c in zip(AXES, cross(*p), strict=True)])
    n = [f"n{a}" for a in AXES]
    length = lambda cols: F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    unit = lambda df: df.withColumn("length", length(n)).withColumns({c: F.coalesce(F.try_divide(F.col(c), F.col("length")), F.lit(0.0)) for c in n})
    each = unit(rows).select("img", F.explode("p").alias("p"), *n)
    return unit(each.groupBy("img", F.col("p.vertex").alias("vertex")).agg(*[F.sum(c).alias(c) for c in n])).select("img", "vertex", *n)


def _placed(df: DataFrame, by: Column, name: str) -> DataFrame:
    """df with each row's place within its image in the order of `by`, by ranges: no task holds an image."""
    rows = dense_index(df.withColumn("__key", by), "__key", "__place")
    first = rows.groupBy("img").agg(F.min("__place").alias("__first"))
    return rows.join(first, "img").withColumn(name, F.col("__place") - F.col("__first")).drop("__key", "__place", "__first")


def numbered(points: DataFrame, tri: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vertices with a place from 0 in each image (in the order of their numbers), and faces by these places."""
    placed = _placed(points, F.struct("img", "vertex"), "place")
    out = faces(tri)
    for k in "abc":
        out = out.join(placed.select("img", F.col("vertex").alias(k), F.col("place").alias(f"p{k}")), ["img", k])
    return placed, out.select("img", "face", *[F.col(f"p{k}").alias(k) for k in "abc"])


def drawing_order(tri: DataFrame, axis: str, backwards: bool = False) -> DataFrame:
    """(img, place, face, a, b, c): triangles by their first vertex' coordinate along an axis, equal ones by face. backwards: the
    same list of vertices from its end."""
    rows = tri.select("img", "face", *[F.get("p", i)["vertex"].alias(k) for i, k in enumerate("abc")], F.get("p", 0)[axis].alias("at"))
    rows = _placed(rows, F.struct("img", "at", "face"), "place")
    if backwards:
        last = rows.groupBy("img").agg(F.max("place").alias("last"))
        rows = rows.join(last, "img").select("img", (F.col("last") - F.col("place")).alias("place"), "face", F.col("c").alias("a"), "b", F.col("a").alias("c"))
    return rows.select("img", "place", "face", "a", "b", "c")
