"""Vectors, matrices, Fourier transforms and layers over array columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..fixtures import VOL_SQL, table, vol
from ..functions import matrix as M
from ..layout import from_arrays, to_arrays
from ..operators import network, per_image, spectrum
from .registry import Registry

REG = Registry()
E_SQL = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("f"))


def _parts(spark, sf_dir, n: int):
    f = F.col("f")
    return _vectors(spark, sf_dir).select("vec_id", F.slice(f, 1, n).alias("a"), F.slice(f, n + 1, n).alias("b"))


def _num(name: str, value, sql: str, n: int = 9) -> None:
    """A number of a and b: the first two runs of n elements of a vector."""
    REG.add(name, lambda s, d: _parts(s, d, n).select("vec_id", F.round(value(F.col("a"), F.col("b")), 6).alias("v")), f"WITH {E_SQL}, p AS (SELECT vec_id, f[1:{n}] AS a, f[{n + 1}:{2 * n}] AS b FROM e) SELECT vec_id, round({sql}, 6) AS v FROM p")


def _vec(name: str, value, sql: str, n: int = 9) -> None:
    """A vector of a and b, its elements as rows."""

    def run(spark, sf_dir):
        out = _parts(spark, sf_dir, n).select("vec_id", F.posexplode(value(F.col("a"), F.col("b"))).alias("i", "v"))
        return out.select("vec_id", F.col("i").cast("long").alias("i"), F.round("v", 5).alias("v"))

    REG.add(name, run, f"WITH {E_SQL}, p AS (SELECT vec_id, f[1:{n}] AS a, f[{n + 1}:{2 * n}] AS b FROM e), q AS (SELECT vec_id, {sql} AS r FROM p) SELECT vec_id, CAST(i.i AS BIGINT) AS i, round(r[i.i + 1], 5) AS v FROM q, range({{n}}) i(i) WHERE i.i < len(r)".replace("{n}", "128"))


_dot = "list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2]))"
_num("mat_dot", M.dot, _dot, 32)
_num("mat_norm1", lambda a, b: M.norm1(a), "list_sum(list_transform(a, lambda x: abs(x)))", 32)
_num("mat_norm2", lambda a, b: M.norm2(a), "sqrt(list_sum(list_transform(a, lambda x: x * x)))", 32)
_num("mat_distance", M.distance, "sqrt(list_sum(list_transform(list_zip(a, b), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))", 32)
_num("mat_trace", lambda a, b: M.trace(a, 3), "a[1] + a[5] + a[9]")
_num("mat_determinant_2", lambda a, b: M.determinant(a, 2), "a[1] * a[4] - a[2] * a[3]", 4)
_num("mat_determinant_3", lambda a, b: M.determinant(a, 3), "a[1] * (a[5] * a[9] - a[6] * a[8]) - a[2] * (a[4] * a[9] - a[6] * a[7]) + a[3] * (a[4] * a[8] - a[5] * a[7])")
_num("mat_lu_determinant", lambda a, b: M.lu_determinant(3)(a), "a[1] * (a[5] * a[9] - a[6] * a[8]) - a[2] * (a[4] * a[9] - a[6] * a[7]) + a[3] * (a[4] * a[8] - a[5] * a[7])")
_MIRRORED = lambda a: F.array(*[F.when((F.get(a, 0) > 0) & (F.lit(i) == 3), F.get(a, 1)).otherwise(F.get(a, {6: 2, 7: 5}.get(i, i))) for i in range(9)])
_num("mat_is_symmetric", lambda a, b: M.is_symmetric(_MIRRORED(a), 3).cast("int"), "CAST(a[1] > 0 OR a[2] = a[4] AS INT)")
_vec("mat_scale", lambda a, b: M.scale(a, 2.5), "list_transform(a, lambda x: x * 2.5::DOUBLE)")
_vec("mat_add", M.add, "list_transform(list_zip(a, b), lambda z: z[1] + z[2])")
_vec("mat_minus", M.minus, "list_transform(list_zip(a, b), lambda z: z[1] - z[2])")
_vec("mat_axpy", lambda a, b: M.axpy(2.0, a, b), "list_transform(list_zip(a, b), lambda z: 2.0::DOUBLE * z[1] + z[2])")
_vec("mat_aypx", lambda a, b: M.aypx(2.0, a, b), "list_transform(list_zip(a, b), lambda z: z[1] + 2.0::DOUBLE * z[2])")
_vec("mat_rot", lambda a, b: M.rot(a, b, 0.6, 0.8)[0], "list_transform(list_zip(a, b), lambda z: 0.6::DOUBLE * z[1] + 0.8::DOUBLE * z[2])")
_vec("mat_normalize", lambda a, b: M.normalize(a), "list_transform(a, lambda x: x / sqrt(list_sum(list_transform(a, lambda y: y * y))))")
_vec("mat_project", lambda a, b: M.project(a, b), f"list_transform(b, lambda x: x * {_dot} / list_sum(list_transform(b, lambda y: y * y)))")
_vec("mat_outer", lambda a, b: M.outer(a, b), "[" + ", ".join(f"a[{r}] * b[{c}]" for r in range(1, 4) for c in range(1, 4)) + "]", 3)
_vec("mat_cross_product", M.cross_product, "[a[2] * b[3] - a[3] * b[2], a[3] * b[1] - a[1] * b[3], a[1] * b[2] - a[2] * b[1]]", 3)
_vec("mat_transpose", lambda a, b: M.transpose(a, 3, 3), "[" + ", ".join(f"a[{r * 3 + c + 1}]" for c in range(3) for r in range(3)) + "]")
_mul = lambda x, y: "[" + ", ".join("+".join(f"{x(r, i)} * {y(i, c)}" for i in range(3)) for r in range(3) for c in range(3)) + "]"
_a, _b = (lambda r, c: f"a[{r * 3 + c + 1}]"), (lambda r, c: f"b[{r * 3 + c + 1}]")
_vec("mat_product", lambda a, b: M.product(a, b, 3, 3, 3), _mul(_a, _b))
_vec("mat_product_transpose", lambda a, b: M.product_transpose(a, b, 3, 3, 3), _mul(_a, lambda r, c: _b(c, r)))
_vec("mat_square", lambda a, b: M.square(a, 3, 3), _mul(_a, lambda r, c: _a(c, r)))
_vec("mat_vector_product", lambda a, b: M.vector_product(a, F.slice(b, 1, 3), 3, 3), "[" + ", ".join("+".join(f"{_a(r, i)} * b[{i + 1}]" for i in range(3)) for r in range(3)) + "]")
_vec("mat_left_vector_product", lambda a, b: M.left_vector_product(a, F.slice(b, 1, 3), 3, 3), "[" + ", ".join("+".join(f"{_a(i, c)} * b[{i + 1}]" for i in range(3)) for c in range(3)) + "]")
_vec("mat_vector_transformation", lambda a, b: M.vector_transformation(a, F.slice(b, 1, 3)), "[" + ", ".join("+".join(f"a[{r * 4 + i + 1}] * b[{i + 1}]" for i in range(3)) + f" + a[{r * 4 + 4}]" for r in range(3)) + "]", 12)
_TWO = lambda a: F.zip_with(a, F.array(*[F.lit(x) for x in (2.0, 0.0, 0.0, 2.0)]), lambda p, q: p + q)
_vec("mat_inverse_2", lambda a, b: M.inverse(_TWO(a), 2), "list_transform([a[4] + 2, -a[2], -a[3], a[1] + 2], lambda x: x / ((a[1] + 2) * (a[4] + 2) - a[2] * a[3]))", 4)


@REG("arr_round_trip", f"WITH {VOL_SQL} SELECT img, x, y, z, idx, v FROM vol")
def round_trip(spark, sf_dir):
    g = vol(spark, sf_dir)
    return from_arrays(to_arrays(g), g.shape).df


@REG("arr_layout", f"WITH {VOL_SQL} SELECT img, CAST(list_sum(list(v)) AS BIGINT) AS s, CAST(count(*) AS INT) AS n FROM vol GROUP BY img")
def layout(spark, sf_dir):
    return to_arrays(vol(spark, sf_dir)).select("img", F.aggregate("data", F.lit(0).cast("long"), lambda a, b: a + b).alias("s"), F.size("data").alias("n"))


_ANGLE = "2 * pi() * (x * (k.k % 16) / 16.0::DOUBLE + y * ((k.k // 16) % 12) / 12.0::DOUBLE + z * (k.k // 192) / 7.0::DOUBLE)"


@REG("fft_forward", f"WITH {VOL_SQL} SELECT img, CAST(k.k AS BIGINT) AS k, round(sum(v * cos({_ANGLE})), 2) + 0.0 AS re, round(sum(v * sin({_ANGLE})), 2) + 0.0 AS im FROM vol, range(1344) k(k) GROUP BY ALL")
def fft(spark, sf_dir):
    """The whole spectrum, in storage order of its frequencies."""
    g = vol(spark, sf_dir)
    f = per_image.fftn(to_arrays(g), g.shape).select("img", F.posexplode(F.arrays_zip("re", "im")).alias("k", "c"))
    near = lambda c: F.round(c, 2) + 0.0
    return f.select("img", F.col("k").cast("long").alias("k"), near(F.col("c.re")).alias("re"), near(F.col("c.im")).alias("im"))


@REG("fft_real", f"WITH {VOL_SQL} SELECT img, CAST(k.k AS BIGINT) AS k, round(sum(v * cos({_ANGLE})), 2) + 0.0 AS re, round(sum(v * sin({_ANGLE})), 2) + 0.0 AS im FROM vol, range(1344) k(k) GROUP BY ALL")
def fft_real(spark, sf_dir):
    """By lines along one axis after the other; the half that isn't computed by symmetry."""
    g = vol(spark, sf_dir)
    f = spectrum.full(spectrum.forward(g), g.shape)
    return f.select("img", F.col("idx").alias("k"), *[(F.round(c, 2) + 0.0).alias(c) for c in ("re", "im")])


@REG("fft_real_back", f"WITH {VOL_SQL} SELECT img, idx, v::DOUBLE AS v FROM vol")
def fft_real_back(spark, sf_dir):
    g = vol(spark, sf_dir)
    return spectrum.back(spectrum.forward(g), g.shape).df.select("img", "idx", (F.round("v", 6) + 0.0).alias("v"))


@REG("fft_round_trip", f"WITH {VOL_SQL} SELECT img, idx, v::DOUBLE AS v FROM vol")
def fft_round_trip(spark, sf_dir):
    g = vol(spark, sf_dir)
    back = per_image.fftn(per_image.fftn(to_arrays(g), g.shape), g.shape, True).select("img", F.transform("re", lambda x: F.round(x / g.size, 6)).alias("data"))
    return from_arrays(back, g.shape).df.select("img", "idx", (F.col("v") + 0.0).alias("v"))


@REG("net_forward")
def forward(spark, sf_dir):
    """A small network on each volume: convolution, pooling, upsampling beside the input, one-by-one convolution."""
    g = vol(spark, sf_dir)
    layers = network.parse("split_merge(conv2,ks3,stride1,leaky_relu+max_pool+upsample|conv1,ks1,stride1)+norm+conv1,ks1,stride1,relu")
    rng = np.random.default_rng(0)
    weights = [rng.normal(size=(2, 1, 3, 3, 3)), np.zeros(2), np.ones((1, 1, 1, 1, 1)), np.zeros(1), np.ones(3), np.zeros(3), rng.normal(size=(1, 3, 1, 1, 1)), np.zeros(1)]
    out = per_image.map_images(to_arrays(g), lambda x: network.forward(layers, x[None, :6], list(weights))[0], g.shape)
    return from_arrays(out, (16, 12, 6)).df.select("img", "idx", F.round("v", 5).alias("v"))


@REG("mesh_isosurface")
def isosurface(spark, sf_dir):
    g = vol(spark, sf_dir)
    return per_image.surfaces(to_arrays(g), g.shape, 300.5).select("img", "triangle", "corner", *[F.round(c, 5).alias(c) for c in ("px", "py", "pz")])
