"""Surfaces of the volumes as indexed meshes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import VOL_SQL, vol
from ..operators import mesh as M
from .registry import Registry

REG = Registry()
LEVEL = 300

_TETS = ", ".join(f"({t}, {p}, {k})" for t, path in enumerate(M.TETRAHEDRA) for p, k in enumerate(path))
_CUTS = ", ".join(f"({n}, {f}, {q}, {i}, {j})" for n, tris in M.CUTS.items() for f, tri in enumerate(tris) for q, (i, j) in enumerate(tri))

#: Triangles with their vertices as columns (v, x, y, z by 0, 1, 2), turned outwards.
MESH_SQL = f"""{VOL_SQL}, tets(tet, pos, k) AS (VALUES {_TETS}), cuts(n, f, q, i, j) AS (VALUES {_CUTS}),
corner AS (SELECT c.img, c.idx AS cell, tet, pos, k, p.idx AS at, p.x, p.y, p.z, p.v::DOUBLE AS v, p.v <= {LEVEL} AS inside
    FROM vol c, tets JOIN vol p ON p.img = c.img AND p.idx = c.idx + (k & 1) + 16 * ((k >> 1) & 1) + 192 * (k >> 2)
    WHERE c.x < 15 AND c.y < 11 AND c.z < 6),
placed AS (SELECT *, row_number() OVER (PARTITION BY img, cell, tet ORDER BY inside DESC, pos) - 1 AS o,
    count(*) FILTER (inside) OVER (PARTITION BY img, cell, tet) AS n FROM corner),
way AS (SELECT img, cell, tet, avg(x) FILTER (NOT inside) - avg(x) FILTER (inside) AS wx, avg(y) FILTER (NOT inside) - avg(y) FILTER (inside) AS wy,
    avg(z) FILTER (NOT inside) - avg(z) FILTER (inside) AS wz FROM placed GROUP BY img, cell, tet HAVING any_value(n) BETWEEN 1 AND 3),
cut AS (SELECT a.img, a.cell, a.tet, f, q, CASE WHEN a.v = {LEVEL} THEN a.at * 8 ELSE least(a.at, b.at) * 8 + abs(b.k - a.k) END AS v,
    a.x + CASE WHEN a.v = {LEVEL} THEN 0 ELSE ({LEVEL} - a.v) / (b.v - a.v) * (b.x - a.x) END AS x,
    a.y + CASE WHEN a.v = {LEVEL} THEN 0 ELSE ({LEVEL} - a.v) / (b.v - a.v) * (b.y - a.y) END AS y,
    a.z + CASE WHEN a.v = {LEVEL} THEN 0 ELSE ({LEVEL} - a.v) / (b.v - a.v) * (b.z - a.z) END AS z
    FROM placed a JOIN cuts ON cuts.n = a.n AND cuts.i = a.o JOIN placed b ON b.img = a.img AND b.cell = a.cell AND b.tet = a.tet AND b.o = cuts.j),
wide AS (SELECT p.img, (p.cell * 6 + p.tet) * 2 + p.f AS face, wx, wy, wz, p.v AS v0, p.x AS x0, p.y AS y0, p.z AS z0,
    q.v AS v1, q.x AS x1, q.y AS y1, q.z AS z1, r.v AS v2, r.x AS x2, r.y AS y2, r.z AS z2
    FROM cut p JOIN cut q ON q.img = p.img AND q.cell = p.cell AND q.tet = p.tet AND q.f = p.f AND p.q = 0 AND q.q = 1
    JOIN cut r ON r.img = p.img AND r.cell = p.cell AND r.tet = p.tet AND r.f = p.f AND r.q = 2
    JOIN way ON way.img = p.img AND way.cell = p.cell AND way.tet = p.tet WHERE p.v <> q.v AND q.v <> r.v AND p.v <> r.v),
crossed AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS nx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ny,
    (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS nz FROM wide),
faced AS (SELECT img, face, nx * wx + ny * wy + nz * wz < 0 AS turn, * EXCLUDE (img, face) FROM crossed)"""


def _triangles(spark, sf_dir):
    return M.triangles(vol(spark, sf_dir), LEVEL)


@REG(
    "mesh_vertices",
    f"""WITH {MESH_SQL}, e AS (SELECT img, v0 AS vertex, x0 AS x, y0 AS y, z0 AS z FROM faced UNION ALL SELECT img, v1, x1, y1, z1 FROM faced
    UNION ALL SELECT img, v2, x2, y2, z2 FROM faced)
SELECT img, CAST(vertex AS BIGINT) AS vertex, round(any_value(x), 6) AS x, round(any_value(y), 6) AS y, round(any_value(z), 6) AS z FROM e GROUP BY img, vertex""",
)
def vertices(spark, sf_dir):
    return M.vertices(_triangles(spark, sf_dir)).select("img", "vertex", *[F.round(a, 6).alias(a) for a in "xyz"])


@REG(
    "mesh_faces",
    f"""WITH {MESH_SQL} SELECT img, CAST(face AS BIGINT) AS face, CAST(v0 AS BIGINT) AS a, CAST(CASE WHEN turn THEN v2 ELSE v1 END AS BIGINT) AS b,
    CAST(CASE WHEN turn THEN v1 ELSE v2 END AS BIGINT) AS c FROM faced""",
)
def faces(spark, sf_dir):
    return M.faces(_triangles(spark, sf_dir))


@REG(
    "mesh_normals",
    f"""WITH {MESH_SQL}, u AS (SELECT *, CASE WHEN turn THEN -1 ELSE 1 END * nullif(sqrt(nx * nx + ny * ny + nz * nz), 0) AS l FROM faced),
e AS (SELECT img, unnest([v0, v1, v2]) AS vertex, coalesce(nx / l, 0) AS nx, coalesce(ny / l, 0) AS ny, coalesce(nz / l, 0) AS nz FROM u),
s AS (SELECT img, vertex, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz, sqrt(sum(nx) ** 2 + sum(ny) ** 2 + sum(nz) ** 2) AS l FROM e GROUP BY img, vertex)
SELECT img, CAST(vertex AS BIGINT) AS vertex, round(nx / l, 6) + 0.0 AS nx, round(ny / l, 6) + 0.0 AS ny, round(nz / l, 6) + 0.0 AS nz FROM s""",
)
def normals(spark, sf_dir):
    return M.normals(_triangles(spark, sf_dir)).select("img", "vertex", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@REG(
    "mesh_drawing_order",
    f"""WITH {MESH_SQL} SELECT img, row_number() OVER (PARTITION BY img ORDER BY y0, face) - 1 AS place, CAST(face AS BIGINT) AS face,
    CAST(v0 AS BIGINT) AS a, CAST(CASE WHEN turn THEN v2 ELSE v1 END AS BIGINT) AS b, CAST(CASE WHEN turn THEN v1 ELSE v2 END AS BIGINT) AS c FROM faced""",
)
def drawing_order(spark, sf_dir):
    return M.drawing_order(_triangles(spark, sf_dir), "y")
