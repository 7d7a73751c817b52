"""Fields of view: where a model's fixed-size volume looks at an image, and how views are put together again.

A view is a 3x4 matrix from its voxels to the image's. Matrices are a handful of numbers on the driver; voxels stay tables.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from ..functions.vectors import round_up
from ..layout import Grid
from .resample import resample_affine

STRATEGIES = ("align_center", "align_top", "image", "sliding_window")


def view_matrix(shift, shape, vs, image_shape, image_vs) -> list[float]:
    """View voxels to image voxels: centres meet but for a shift in physical units; whole voxels where the sizes agree."""
    shape, vs, image_shape, image_vs = (np.asarray(v, float) for v in (shape, vs, image_shape, image_vs))
    step = vs / image_vs
    move = (np.asarray(shift, float) - shape * vs / 2) / image_vs + image_shape / 2
    if (vs == image_vs).all():
        move = np.sign(move) * np.floor(np.abs(move) + 0.5)
    return np.hstack([np.diag(step), move[:, None]]).ravel().tolist()


def plan_views(box: tuple, shape, vs, model_shape, model_vs, strategy: str = "align_center", multiple=(1, 1, 1)) -> tuple[list[list[float]], tuple[int, ...], tuple[float, ...]]:
    """(matrices, shape of a view, its voxel size) for an image whose content fills box (low, high), half open.

    align_center: one view on the box's centre. align_top: its upper end on the box's. image: one view as large as the box,
    rounded up to a multiple, at the image's resolution. sliding_window: two views along each axis that is longer than a view
    (at most two views' worth of the box counts), and one more on the centre; else as align_center.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    low, high = (np.asarray(v, float) for v in box)
    image, ivs, view, mvs = (np.asarray(v, float) for v in (shape, vs, model_shape, model_vs))
    centre = (low + high) / 2 * ivs - image / 2 * ivs
    size, patch = (high - low) * ivs, view * mvs
    shifts = [centre]
    if strategy == "image":
        mvs = np.full(3, (ivs[0] + ivs[2]) / 2)
        view = np.array(round_up(tuple(int(n) for n in size / mvs), multiple), float)
    elif strategy == "align_top":
        top = centre.copy()
        top[2] = high[2] * ivs[2] - patch[2] / 2 - image[2] / 2 * ivs[2]
        shifts = [top]
    elif strategy == "sliding_window":
        reach = np.minimum(size, 2 * patch)
        sides = [(-(r - p) / 2, (r - p) / 2) if r > p else (0.0,) for r, p in zip(reach, patch, strict=True)]
        around = [np.array([x, y, z]) for z in sides[2] for y in sides[1] for x in sides[0]]
        if len(around) > 1:
            shifts = [centre + a for a in [*around, np.zeros(3)]]
    shape_out, vs_out = tuple(int(n) for n in view), tuple(float(v) for v in mvs)
    return [view_matrix(s, shape_out, vs_out, shape, vs) for s in shifts], shape_out, vs_out


def take_view(grid: Grid, matrix: list[float], shape: tuple[int, int, int], vs: tuple[float, float, float], interpolation: str = "linear") -> Grid:
    return replace(resample_affine(grid, shape, matrix, interpolation), vs=vs)


def back_matrix(matrix: list[float]) -> list[float]:
    """Image voxels to view voxels."""
    m = np.vstack([np.array(matrix).reshape(3, 4), [0, 0, 0, 1]])
    return np.linalg.inv(m)[:3].ravel().tolist()


def view_weights(view: Grid) -> Grid:
    """Gaussian weights around a view's centre, deviation an eighth of each side, at least 1e-6 of the largest."""
    d2 = F.lit(0.0)
    largest = 0.0
    for a, n in zip("xyz", view.shape, strict=True):
        c, s = n * 0.5, n / 8.0
        d2 = d2 + (F.col(a) - c) * (F.col(a) - c) / (s * s)
        largest += min((k - c) ** 2 for k in range(n)) / (s * s)
    return view.map(F.greatest(F.exp(-0.5 * (d2 - largest)), F.lit(1e-6)))


def blend_views(views: list[Grid], matrices: list[list[float]], like: Grid) -> Grid:
    """Views laid back on the image's grid, each weighed by view_weights(); 0 where none reaches. One view isn't weighed."""
    if len(views) == 1:
        return like.with_df(resample_affine(views[0], like.shape, back_matrix(matrices[0])).df)
    total = None
    for view, m in zip(views, matrices, strict=True):
        w = view_weights(view)
        both = view.df.join(w.df.select("img", "idx", F.col("v").alias("w")), ["img", "idx"])
        value = view.with_df(both.withColumn("v", F.col("v") * F.col("w")).select(view.df.columns))
        parts = [resample_affine(g, like.shape, back_matrix(m)).df.select("img", "idx", F.col("v").alias(c)) for g, c in ((value, "s"), (w, "w"))]
        rows = parts[0].join(parts[1], ["img", "idx"])
        total = rows if total is None else total.unionByName(rows)
    sums = total.groupBy("img", "idx").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    df = like.df.join(sums, ["img", "idx"], "left")
    v = F.when(F.col("w") > 1e-6, F.col("s") / F.col("w")).otherwise(F.coalesce("s", F.lit(0.0)))
    return like.with_df(df.withColumn("v", v).select(like.df.columns))
