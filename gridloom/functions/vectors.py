"""Vectors of two or three components in ARRAY<DOUBLE> columns, and shapes (w, h, d) as driver-side tuples or columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elem_mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p * q)


def elem_div(a: Column, b: Column) -> Column:
    """Null where b is 0."""
    return F.zip_with(a, b, lambda p, q: F.try_divide(p, q))


def floor(a: Column) -> Column:
    return F.transform(a, lambda x: F.floor(x).cast("double"))


def ceil(a: Column) -> Column:
    return F.transform(a, lambda x: F.ceil(x).cast("double"))


def round_half_away(a: Column) -> Column:
    """Halves go away from zero."""
    return F.transform(a, lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5))


def rotate(v: Column, m: Column, n: int = 3) -> Column:
    """A row-major n x n matrix on a vector, without a shift."""
    cell = lambda r, c: F.get(m, r * n + c) * F.get(v, c)
    return F.array(*[sum((cell(r, c) for c in range(1, n)), cell(r, 0)) for r in range(n)])


def reorient_vector(v: Column, order: tuple[int, int, int]) -> Column:
    """Component k goes to place order[k]."""
    back = [order.index(k) for k in range(3)]
    return F.array(*[F.get(v, k) for k in back])


def reorient_matrix(m: Column, order: tuple[int, int, int], flipped: tuple[bool, bool, bool]) -> Column:
    """Row k of a 3x3 matrix goes to place order[k], negated where flipped[k]."""
    back = [order.index(k) for k in range(3)]
    return F.array(*[F.get(m, 3 * k + c) * (-1.0 if flipped[k] else 1.0) for k in back for c in range(3)])


def is_valid(x: Column, y: Column, z: Column, shape: tuple[int, int, int]) -> Column:
    """Whether a place is inside a shape."""
    return (x >= 0) & (y >= 0) & (z >= 0) & (x < shape[0]) & (y < shape[1]) & (z < shape[2])


def is_border(x: Column, y: Column, z: Column, shape: tuple[int, int, int]) -> Column:
    """Whether a place is in the outermost layer of a shape."""
    return (x == 0) | (y == 0) | (z == 0) | (x + 1 == shape[0]) | (y + 1 == shape[1]) | (z + 1 == shape[2])


def expand(shape: tuple[int, ...], n: int) -> tuple[int, ...]:
    """One more axis of n places."""
    return (*shape, n)


def reduce(shape: tuple[int, ...]) -> tuple[int, ...]:
    """The first two axes."""
    return shape[:2]


def swap_dim(shape: tuple[int, ...], i: int, j: int) -> tuple[int, ...]:
    out = list(shape)
    out[i], out[j] = out[j], out[i]
    return tuple(out)


def round_up(shape: tuple[int, int, int], multiple: tuple[int, int, int]) -> tuple[int, ...]:
    """The next multiple along each axis."""
    return tuple(-(-n // m) * m for n, m in zip(shape, multiple, strict=True))


def slice_corners(axis: int, position: float, shape: tuple[int, int, int]) -> list[tuple[float, float, float]]:
    """The four corners of a slice across an axis, half a voxel beyond its outermost centres."""
    across = [k for k in range(3) if k != axis]
    out = []
    for second in (0, 1):
        for first in (0, 1):
            p = [position] * 3
            p[across[0]] = shape[across[0]] - 0.5 if first else -0.5
            p[across[1]] = shape[across[1]] - 0.5 if second else -0.5
            out.append(tuple(p))
    return out
