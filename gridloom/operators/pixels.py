"""Filters whose result has the type of the pixels: whole numbers of a size, and colours.

Pixels are worked on as doubles. A result is rounded half away from 0 and kept within the type's bounds before it gets the
pixels' type again; doubles and floats stay as they are. Bytes without sign are smallint or wider columns with the bounds
(0, 255). A colour is a struct with r, g and b; all channels go through one window an axis together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..layout import Grid
from .stencil import axes, derivative, passes, planes, sides, smooth

#: Bounds of Spark's whole numbers.
BOUNDS = {"tinyint": (-(2**7), 2**7 - 1), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}
BYTE = (0, 255)
CHANNELS = ("r", "g", "b")


def to_pixel(value: Column, kind: str, bounds: tuple[int, int] | None = None) -> Column:
    """A double as a pixel of a type."""
    if kind not in BOUNDS:
        return value.cast(kind)
    low, high = bounds or BOUNDS[kind]
    whole = F.signum(value) * F.floor(F.abs(value) + 0.5)
    # bounds are compared in doubles; those of the widest type have none that is exact, so they are given as they are
    return F.when(value <= low, F.lit(low).cast(kind)).when(value >= high, F.lit(high).cast(kind)).otherwise(whole.cast(kind))


def typed(grid: Grid, fun: Callable[[Grid], Grid], bounds: tuple[int, int] | None = None) -> Grid:
    """fun, a filter on doubles, with a result of the pixels' own type."""
    kind = grid.df.schema["v"].dataType.simpleString()
    return fun(grid.map(F.col("v").cast("double"))).map(to_pixel(F.col("v"), kind, bounds))


def _on_channels(grid: Grid, fun: Callable[[Grid], Grid]) -> Grid:
    """fun on a grid with columns r, g, b in place of v, and colours of what it makes of them, in bytes."""
    inner = {f.name: f.dataType.simpleString() for f in grid.df.schema["v"].dataType.fields}
    out = fun(grid.with_df(grid.df.withColumns({c: F.col(f"v.{c}").cast("double") for c in CHANNELS})))
    colour = F.struct(*[to_pixel(F.col(c), kind, BYTE).alias(c) for c, kind in inner.items()])
    return out.with_df(out.df.withColumn("v", colour).select(grid.df.columns))


def gaussian_rgb(grid: Grid, bandwidth: int = 1) -> Grid:
    return _on_channels(grid, lambda h: passes(h, lambda g, a: g.with_df(g.df.withColumns({c: smooth(g, a, c) / 4.0 for c in CHANNELS})), bandwidth))


def mean_rgb(grid: Grid) -> Grid:
    def run(h: Grid) -> Grid:
        h = passes(h, lambda g, a: g.with_df(g.df.withColumns({c: reduce(lambda p, q: p + q, sides(g, a, c)) for c in CHANNELS})))
        return h.with_df(h.df.withColumns({c: F.col(c) / float(3**grid.dim) for c in CHANNELS}))

    return _on_channels(grid, run)


def laplacian_rgb(grid: Grid) -> Grid:
    """Sum over axes of before - 2 here + after; what is below 0 is 0."""

    def run(h: Grid) -> Grid:
        df = planes(h.df, h.dim)
        for a in axes(h):
            parts = {c: sides(h, a, c) for c in CHANNELS}
            df = df.withColumns({f"{c}{a}": p + q - 2 * here for c, (p, here, q) in parts.items()})
        return h.with_df(df.withColumns({c: reduce(lambda p, q: p + q, [F.col(f"{c}{a}") for a in axes(h)]) for c in CHANNELS}))

    return _on_channels(grid, run)


def sobel_rgb(grid: Grid) -> Grid:
    """Sum of the absolute Sobel components of each channel."""

    def run(h: Grid) -> Grid:
        df, ax = planes(h.df, h.dim), axes(h)
        for a in ax:
            df = df.withColumns({f"{c}{a}": derivative(h, a, c) for c in CHANNELS})
        for a in ("z", "x", "y") if h.dim == 3 else ax:
            if a == "x":
                df = planes(df, h.dim)
            df = df.withColumns({f"{c}{b}": smooth(h, a, f"{c}{b}") for c in CHANNELS for b in ax if b != a})
        return h.with_df(df.withColumns({c: reduce(lambda p, q: p + q, [F.abs(f"{c}{a}") for a in ax]) for c in CHANNELS}))

    return _on_channels(grid, run)
