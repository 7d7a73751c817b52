"""Vectors and matrices in ARRAY<DOUBLE> columns (row-major), JVM-side; decompositions by Arrow batches of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)


def norm1(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.abs(x))


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * k)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def axpy(k: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: q + p * k)


def aypx(k: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda p, q: q * k + p)


def rot(x: Column, y: Column, c: float, s: float) -> tuple[Column, Column]:
    """Givens rotation of two vectors."""
    return F.zip_with(x, y, lambda p, q: p * c + q * s), F.zip_with(x, y, lambda p, q: q * c - p * s)


def outer(x: Column, y: Column) -> Column:
    return F.flatten(F.transform(x, lambda p: F.transform(y, lambda q: p * q)))


def vector_product(a: Column, x: Column, rows: int, cols: int) -> Column:
    return F.array(*[dot(F.slice(a, r * cols + 1, cols), x) for r in range(rows)])


def left_vector_product(a: Column, x: Column, rows: int, cols: int) -> Column:
    return vector_product(transpose(a, rows, cols), x, cols, rows)


def transpose(a: Column, rows: int, cols: int) -> Column:
    return F.array(*[F.get(a, r * cols + c) for c in range(cols) for r in range(rows)])


def product(a: Column, b: Column, n: int, k: int, m: int) -> Column:
    """(n x k) times (k x m)."""
    e = lambda r, c: sum((F.get(a, r * k + i) * F.get(b, i * m + c) for i in range(1, k)), F.get(a, r * k) * F.get(b, c))
    return F.array(*[e(r, c) for r in range(n) for c in range(m)])


def product_transpose(a: Column, b: Column, n: int, k: int, m: int) -> Column:
    return product(a, transpose(b, m, k), n, k, m)


def square(a: Column, n: int, k: int) -> Column:
    return product_transpose(a, a, n, k, n)


def trace(a: Column, n: int) -> Column:
    return sum((F.get(a, i * n + i) for i in range(1, n)), F.get(a, 0))


def identity(n: int) -> Column:
    return F.array(*[F.lit(float(i == j)) for i in range(n) for j in range(n)])


def is_symmetric(a: Column, n: int) -> Column:
    out = F.lit(True)
    for i in range(n):
        for j in range(i):
            out = out & (F.get(a, i * n + j) == F.get(a, j * n + i))
    return out


def _minor(m: list[Column], n: int, row: int, col: int) -> list[Column]:
    return [m[r * n + c] for r in range(n) for c in range(n) if r != row and c != col]


def _det(m: list[Column], n: int) -> Column:
    if n == 1:
        return m[0]
    if n == 2:
        return m[0] * m[3] - m[1] * m[2]
    terms = [m[c] * _det(_minor(m, n, 0, c), n - 1) for c in range(n)]
    out = terms[0]
    for c in range(1, n):
        out = out - terms[c] if c % 2 else out + terms[c]
    return out


def determinant(a: Column, n: int) -> Column:
    """By cofactors for n up to 4."""
    return _det([F.get(a, i) for i in range(n * n)], n)


def inverse(a: Column, n: int) -> Column:
    """Adjugate over determinant for n up to 4; null for a singular matrix."""
    m = [F.get(a, i) for i in range(n * n)]
    det = _det(m, n)
    cof = (lambda r, c: (_det(_minor(m, n, c, r), n - 1) if n > 1 else F.lit(1.0)) * (-1.0 if (r + c) % 2 else 1.0))
    return F.when(det != 0, F.array(*[F.try_divide(cof(r, c), det) for r in range(n) for c in range(n)]))


def cross_product(a: Column, b: Column) -> Column:
    g = F.get
    return F.array(g(a, 1) * g(b, 2) - g(a, 2) * g(b, 1), g(a, 2) * g(b, 0) - g(a, 0) * g(b, 2), g(a, 0) * g(b, 1) - g(a, 1) * g(b, 0))


def normalize(a: Column) -> Column:
    n = norm2(a)
    return F.when(n > 0, F.transform(a, lambda x: F.try_divide(x, n))).otherwise(a)


def distance(a: Column, b: Column) -> Column:
    return norm2(minus(a, b))


def project(a: Column, onto: Column) -> Column:
    k = F.try_divide(dot(a, onto), dot(onto, onto))
    return F.transform(onto, lambda x: x * k)


def vector_transformation(m: Column, x: Column, n: int = 3) -> Column:
    """A row-major n x (n + 1) matrix on a vector."""
    return F.array(*[dot(F.slice(m, r * (n + 1) + 1, n), x) + F.get(m, r * (n + 1) + n) for r in range(n)])


def batched(fun: Callable[[np.ndarray], np.ndarray | list], rows: int, cols: int, kind: str = "array<double>"):
    """A pandas UDF that gives fun a stack of rows x cols matrices and returns its results."""

    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=object)
        out = fun(np.stack([np.asarray(x, float).reshape(rows, cols) for x in a]))
        return pd.Series([x.tolist() if isinstance(x, np.ndarray) else x for x in out])

    return run


def svd_values(rows: int, cols: int):
    return batched(lambda m: np.linalg.svd(m, compute_uv=False), rows, cols)


def eigenvalues_symmetric(n: int):
    """Descending."""
    return batched(lambda m: np.linalg.eigvalsh(m)[:, ::-1].copy(), n, n)


def eigenvectors_symmetric(n: int):
    """Rows are unit vectors in the order of descending values; the largest component of each is positive."""

    def run(m):
        v = np.swapaxes(np.linalg.eigh(m)[1][:, :, ::-1], 1, 2)
        top = np.take_along_axis(v, np.abs(v).argmax(2)[:, :, None], 2)
        return list((v * np.sign(top)).reshape(len(m), -1))

    return batched(run, n, n)


def pseudo_inverse(rows: int, cols: int):
    return batched(lambda m: list(np.linalg.pinv(m).reshape(len(m), -1)), rows, cols)


def cholesky(n: int):
    return batched(lambda m: list(np.linalg.cholesky(m).reshape(len(m), -1)), n, n)


def qr_r(rows: int, cols: int):
    """R with a positive diagonal."""

    def run(m):
        r = np.linalg.qr(m, mode="r")
        s = np.sign(np.diagonal(r, axis1=1, axis2=2))
        s[s == 0] = 1
        return list((r * s[:, :, None]).reshape(len(m), -1))

    return batched(run, rows, cols)


def lq_l(rows: int, cols: int):
    """L of LQ with a positive diagonal."""

    def run(m):
        r = np.linalg.qr(np.swapaxes(m, 1, 2), mode="r")
        s = np.sign(np.diagonal(r, axis1=1, axis2=2))
        s[s == 0] = 1
        return list(np.swapaxes(r * s[:, :, None], 1, 2).reshape(len(m), -1))

    return batched(run, rows, cols)


def lu_determinant(n: int):
    return batched(lambda m: [float(x) for x in np.linalg.det(m)], n, n, "double")


def lu_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None


def jacobi_sweep(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """One Jacobi sweep from b; None with a zero on the diagonal."""
    d = np.diag(a)
    return None if (d == 0).any() else (b - (a - np.diag(d)) @ b) / d


def col_rotate(a: Column, i: int, j: int, c: float, s: float, rows: int, cols: int) -> Column:
    """Givens rotation of columns i and j of a matrix: i becomes c * i - s * j, j becomes s * i + c * j."""
    g = lambda r, k: F.get(a, r * cols + k)
    cell = lambda r, k: c * g(r, i) - s * g(r, j) if k == i else s * g(r, i) + c * g(r, j) if k == j else g(r, k)
    return F.array(*[cell(r, k) for r in range(rows) for k in range(cols)])


def col_swap(a: Column, i: int, j: int, rows: int, cols: int) -> Column:
    order = [j if k == i else i if k == j else k for k in range(cols)]
    return F.array(*[F.get(a, r * cols + k) for r in range(rows) for k in order])


def inverse_lower(a: Column, n: int) -> Column:
    """Inverse of the lower triangle, by substitution; null with a zero on the diagonal."""
    g, x = (lambda r, c: F.get(a, r * n + c)), {}
    ok = F.lit(True)
    for r in range(n):
        ok = ok & (g(r, r) != 0)
        for c in range(r + 1):
            rest = sum((g(r, k) * x[k, c] for k in range(c, r)), F.lit(float(r == c)))
            x[r, c] = F.try_divide(F.lit(1.0) if r == c else -(rest), g(r, r))
    return F.when(ok, F.array(*[x.get((r, c), F.lit(0.0)) for r in range(n) for c in range(n)]))


def inverse_upper(a: Column, n: int) -> Column:
    """Inverse of the upper triangle; null with a zero on the diagonal."""
    return transpose(inverse_lower(transpose(a, n, n), n), n, n)


def scaling_matrix(s: Column, n: int = 3) -> Column:
    return F.array(*[F.get(s, r) if r == c else F.lit(0.0) for r in range(n) for c in range(n)])


def to_matrix(t: Column, n: int = 3) -> Column:
    """A transform (n x n matrix, then n shifts) as a homogeneous matrix of n + 1 rows."""
    rows = [F.get(t, r * n + c) if c < n else F.get(t, n * n + r) for r in range(n) for c in range(n + 1)]
    return F.array(*rows, *[F.lit(float(c == n)) for c in range(n + 1)])


def qr_q(rows: int, cols: int):
    """Q of QR with a positive diagonal of R, row-major."""

    def run(m):
        q, r = np.linalg.qr(m)
        s = np.sign(np.diagonal(r, axis1=1, axis2=2))
        s[s == 0] = 1
        return list((q * s[:, None, :]).reshape(len(m), -1))

    return batched(run, rows, cols)


def jacobi_order(a: np.ndarray) -> list[int] | None:
    """For each row, from the last, the unused column of its largest element; None where a row has none left."""
    free, out = set(range(len(a))), [0] * len(a)
    for r in range(len(a) - 1, -1, -1):
        best = max(sorted(free), key=lambda c, r=r: abs(a[r, c]))
        if not a[r, best]:
            return None
        out[r] = best
        free.discard(best)
    return out


def random_matrix(n: int, seed: int = 0, positive: bool = False) -> np.ndarray:
    """A random n x n matrix with values from -1 to 1, or one with only positive eigenvalues."""
    a = np.random.default_rng(seed).uniform(-1, 1, (n, n))
    return a @ a.T + np.eye(n) * 1e-3 if positive else a
