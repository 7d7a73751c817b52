"""Indexed meshes: closed, oriented, shared vertices, normals of a sphere."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.layout import from_arrays
from gridloom.operators import mesh


def grid(spark, images):
    d, h, w = images[0].shape
    return from_arrays(spark.createDataFrame([(k, [float(v) for v in x.ravel()]) for k, x in enumerate(images)], "img long, data array<double>"), (w, h, d))


@pytest.fixture(scope="module")
def ball(spark):
    z, y, x = np.mgrid[:13, :14, :15].astype(float)
    r = np.sqrt((x - 7.2) ** 2 + (y - 6.4) ** 2 + (z - 6.1) ** 2)
    return mesh.triangles(grid(spark, [r, 20 - r]), 4.0 + 0.3).cache()


def test_sphere(ball):
    points = {(r["img"], r["vertex"]): np.array([r["x"], r["y"], r["z"]]) for r in mesh.vertices(ball).collect()}
    normals = {(r["img"], r["vertex"]): np.array([r["nx"], r["ny"], r["nz"]]) for r in mesh.normals(ball).collect()}
    faces = [r for r in mesh.faces(ball).collect() if r["img"] == 0]
    v = [k for k in points if k[0] == 0]
    assert points.keys() == normals.keys() and len(v) > 500
    centre = np.array([7.2, 6.4, 6.1])
    for k in v:
        out = points[k] - centre
        assert abs(np.linalg.norm(out) - 4.3) < 0.1
        assert np.isclose(np.linalg.norm(normals[k]), 1) and normals[k] @ out / np.linalg.norm(out) > 0.9
    edges = [(r[p], r[q]) for r in faces for p, q in ("ab", "bc", "ca")]
    assert len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)  # closed, and turned alike
    assert len(v) - len(edges) // 2 + len(faces) == 2  # a sphere
    volume = sum(np.dot(points[0, r["a"]], np.cross(points[0, r["b"]], points[0, r["c"]])) for r in faces) / 6
    assert abs(volume - 4 / 3 * np.pi * 4.3**3) < 0.05 * volume


def test_level_on_voxels(spark):
    """Vertices on voxels whose value is the level are one vertex, and triangles without area are gone."""
    x = np.full((3, 3, 3), 2.0)
    x[1, 1, 1] = 1.0
    assert mesh.triangles(grid(spark, [x]), 1.0).count() == 0  # a single point
    x[1, 1, 1] = 0.0
    x[1, 1, 2] = 1.0
    tri = mesh.triangles(grid(spark, [x]), 1.0)
    numbers = [r["vertex"] for r in mesh.vertices(tri).collect()]
    assert len(set(numbers)) == len(numbers) and (9 + 3 + 2) * 8 in numbers
    at = {(r["x"], r["y"], r["z"]) for r in mesh.vertices(tri).collect()}
    assert len(at) == len(numbers)


def test_nothing_crosses(spark):
    flat = grid(spark, [np.zeros((3, 4, 5))])
    tri = mesh.triangles(flat, 1.0)
    assert tri.count() == mesh.vertices(tri).count() == mesh.normals(tri).count() == 0
    assert mesh.triangles(grid(spark, [np.arange(12.0).reshape(1, 3, 4)]), 5.0).count() == 0  # a plane has no cells


def test_places_and_orders(ball):
    placed, faces = mesh.numbered(mesh.vertices(ball), ball)
    for img in (0, 1):
        p = placed.where(F.col("img") == img).orderBy("vertex").collect()
        assert [r["place"] for r in p] == list(range(len(p)))
        number = {r["vertex"]: r["place"] for r in p}
        want = sorted((r["face"], *(number[r[k]] for k in "abc")) for r in mesh.faces(ball).where(F.col("img") == img).collect())
        assert sorted(tuple(r[1:]) for r in faces.where(F.col("img") == img).collect()) == want
        x = {r["vertex"]: r["x"] for r in mesh.vertices(ball).where(F.col("img") == img).collect()}
        ahead = mesh.drawing_order(ball, "x").where(F.col("img") == img).orderBy("place").collect()
        assert [(r["a"], r["b"], r["c"]) for r in ahead] == [(r["a"], r["b"], r["c"]) for r in sorted(mesh.faces(ball).where(F.col("img") == img).collect(), key=lambda r: (x[r["a"]], r["face"]))]
        back = mesh.drawing_order(ball, "x", True).where(F.col("img") == img).orderBy("place").collect()
        assert [v for r in back for v in (r["a"], r["b"], r["c"])] == [v for r in ahead for v in (r["a"], r["b"], r["c"])][::-1]
