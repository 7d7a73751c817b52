"""Fourier transforms of real images, an axis after the other.

The values of a line are brought together along one axis at a time, so an axis is an exchange and no task holds an image. A
batch of lines is transformed at once. Of a real image the half with 0 <= x <= width / 2 is kept: the other half follows
by symmetry, F(-k) = conj F(k), which full() adds in a projection. The exponent is + i forward and - i back, without factor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layout import AXES, Grid, voxel_index


def _lines(df: DataFrame, axis: str, values: tuple[str, ...], transform, parts: tuple[str, ...]) -> DataFrame:
    """transform on the lines along an axis: [lines, n] arrays of each value to arrays of each part, along the axis again."""
    others = [a for a in AXES if a != axis]
    rows = df.groupBy("img", *others).agg(F.array_sort(F.collect_list(F.struct(axis, *values))).alias("line"))
    rows = rows.select("img", *others, *[F.col(f"line.{v}").cast("array<double>").alias(v) for v in values])

    def run(batches):
        for b in batches:
            if b.num_rows:
                got = transform(*[b.column(3 + k).flatten().to_numpy().reshape(b.num_rows, -1) for k in range(len(values))])
                cols = [pa.array(list(np.ascontiguousarray(g)), pa.list_(pa.float64())) for g in got]
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(3)], *cols], ["img", *others, *parts])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3]] + [f"{p} array<double>" for p in parts]
    out = rows.mapInArrow(run, ", ".join(kinds)).select("img", *others, F.posexplode(F.arrays_zip(*parts)).alias(axis, "p"))
    return out.select("img", *AXES, *[F.col(f"p.{p}").alias(p) for p in parts])


def _complex(df: DataFrame, axis: str, inverse: bool) -> DataFrame:
    def transform(re, im):
        z = re + 1j * im
        y = np.fft.fft(z, axis=1) if inverse else np.fft.ifft(z, axis=1) * z.shape[1]
        return y.real, y.imag

    return _lines(df, axis, ("re", "im"), transform, ("re", "im"))


def forward(grid: Grid) -> DataFrame:
    """(img, x, y, z, re, im): the half spectrum of real images, x up to width // 2."""

    def first(v):
        y = np.conj(np.fft.rfft(v, axis=1))
        return y.real, y.imag

    out = _lines(grid.df.select("img", *AXES, "v"), "x", ("v",), first, ("re", "im"))
    for a, n in list(zip(AXES, grid.shape, strict=True))[1:]:
        if n > 1:
            out = _complex(out, a, False)
    return out


def full(half: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(img, x, y, z, idx, re, im): the whole spectrum of a half one."""
    w, h, d = shape
    mirror = half.where((F.col("x") > 0) & (2 * F.col("x") < w))
    mirror = mirror.select("img", (w - F.col("x")).alias("x"), ((h - F.col("y")) % h).alias("y"), ((d - F.col("z")) % d).alias("z"), "re", (-F.col("im")).alias("im"))
    whole = half.unionByName(mirror)
    return whole.select("img", *[F.col(a).cast("int").alias(a) for a in AXES], voxel_index("x", "y", "z", shape).alias("idx"), "re", "im")


def back(half: DataFrame, shape: tuple[int, int, int]) -> Grid:
    """The real images of a half spectrum, divided by their number of voxels."""
    w, h, d = shape
    out = half
    for a, n in (("z", d), ("y", h)):
        if n > 1:
            out = _complex(out, a, True)

    def last(re, im):
        return (np.fft.irfft(np.conj(re + 1j * im), w, axis=1) * w / (w * h * d),)

    out = _lines(out, "x", ("re", "im"), last, ("v",))
    return Grid(out.select("img", *[F.col(a).cast("int").alias(a) for a in AXES], voxel_index("x", "y", "z", shape).alias("idx"), "v"), shape)
