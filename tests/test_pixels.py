"""Filters that keep the type of their pixels: ties, bounds of every type, colours."""

import pytest
from pyspark.sql import functions as F

from gridloom.layout import Grid, from_arrays
from gridloom.operators import pixels as P
from gridloom.operators import stencil as S


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint"])
def test_bounds_and_ties(spark, kind):
    low, high = P.BOUNDS[kind]
    cases = [(0.5, 1), (-0.5, -1), (1.5, 2), (2.5, 3), (-2.5, -3), (0.49, 0), (-0.49, 0), (float(high), high), (float(high) * 4, high), (float(low), low), (float(low) * 4, low), (1e300, high), (-1e300, low)]
    df = spark.createDataFrame([(float(v),) for v, _ in cases], "v double").select(P.to_pixel(F.col("v"), kind).alias("p"))
    assert df.schema["p"].dataType.simpleString() == kind
    assert [r["p"] for r in df.collect()] == [w for _, w in cases]
    bounded = spark.createDataFrame([(-3.0,), (254.5,), (255.4,), (300.0,)], "v double").select(P.to_pixel(F.col("v"), "smallint", P.BYTE).alias("p"))
    assert [r["p"] for r in bounded.collect()] == [0, 255, 255, 255]
    assert spark.createDataFrame([(0.25,)], "v double").select(P.to_pixel(F.col("v"), "float").alias("p")).first()["p"] == 0.25


def line(spark, values, kind):
    return from_arrays(spark.createDataFrame([(0, values)], f"img long, data array<{kind}>"), (len(values), 1, 1))


def test_ties_and_bounds_in_filters(spark):
    g = line(spark, [0, 2, 0, 0, 127, -128, 127], "tinyint")
    out = [r["v"] for r in P.typed(g, S.gaussian).df.orderBy("idx").collect()]
    # y and z have one place, where [1 2 1] / 4 changes nothing
    assert out == [1, 1, 1, 32, 32, -1, 63]
    assert [r["v"] for r in P.typed(g, S.laplacian).df.orderBy("idx").collect()] == [2, -4, 2, 127, -128, 127, -128]
    assert P.typed(g, S.laplacian).df.schema["v"].dataType.simpleString() == "tinyint"
    f = line(spark, [0.0, 1.0, 0.0], "double")
    assert [r["v"] for r in P.typed(f, S.gaussian).df.orderBy("idx").collect()] == [0.25, 0.5, 0.25]


def test_colours_are_three_images(spark):
    values = [(0, 255, 10), (255, 0, 20), (0, 255, 31), (1, 2, 3)]
    df = spark.createDataFrame([(0, i % 2, i // 2, 0, i, v) for i, v in enumerate(values)], "img long, x int, y int, z int, idx long, v struct<r: smallint, g: smallint, b: smallint>")
    g = Grid(df, (2, 2, 1))
    for colour, one in ((P.gaussian_rgb, S.gaussian), (P.mean_rgb, S.mean), (P.laplacian_rgb, S.laplacian), (P.sobel_rgb, S.sobel)):
        got = [tuple(r["v"]) for r in colour(g).df.orderBy("idx").collect()]
        each = [[r["v"] for r in P.typed(g.map(F.col(f"v.{c}")), one, P.BYTE).df.orderBy("idx").collect()] for c in P.CHANNELS]
        assert got == list(zip(*each, strict=True))
        assert colour(g).df.columns == df.columns
