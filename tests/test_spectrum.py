"""Real transforms by axis against numpy's whole ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.layout import from_arrays
from gridloom.operators import spectrum


@pytest.mark.parametrize("shape", [(3, 4, 6), (4, 3, 5), (1, 5, 8), (1, 1, 7), (2, 1, 1)])
def test_spectrum_and_back(spark, shape):
    d, h, w = shape
    r = np.random.default_rng(w)
    images = [r.normal(size=shape) for _ in range(2)]
    rows = [(k, [float(v) for v in x.ravel()]) for k, x in enumerate(images)]
    g = from_arrays(spark.createDataFrame(rows, "img long, data array<double>"), (w, h, d))
    half = spectrum.forward(g)
    assert half.count() == 2 * (w // 2 + 1) * h * d
    whole, back = spectrum.full(half, g.shape), spectrum.back(half, g.shape)
    assert back.df.columns == ["img", "x", "y", "z", "idx", "v"] and back.shape == g.shape
    for k, x in enumerate(images):
        got = whole.where(F.col("img") == k).orderBy("idx").collect()
        assert [r["idx"] for r in got] == list(range(x.size))
        want = np.fft.ifftn(x) * x.size
        np.testing.assert_allclose([r["re"] + 1j * r["im"] for r in got], want.ravel(), atol=1e-9)
        np.testing.assert_allclose([r["v"] for r in back.df.where(F.col("img") == k).orderBy("idx").collect()], x.ravel(), atol=1e-9)


def test_no_image_in_one_row(spark):
    """Lines are what is gathered: an exchange by the two other axes for each axis."""
    g = from_arrays(spark.createDataFrame([(0, [1.0] * 60)], "img long, data array<double>"), (5, 4, 3))
    plan = spectrum.forward(g)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") >= 3
    for others in (("y", "z"), ("x", "z"), ("x", "y")):
        assert any("Aggregate [img" in line and all(f" {a}#" in line for a in others) for line in plan.splitlines())
