"""Operators that need a whole image at once, in numpy, a group an image: Fourier transforms, thumbnails, surfaces, layers.

Images are rows (img, data) of to_arrays(). A batch holds as many as fit Arrow's size; they are worked on one after the
other as views of its buffer, and each result leaves before the next is made.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def views(column: pa.Array):
    """The arrays of a list column as numpy views."""
    for k in range(len(column)):
        yield column[k].values.to_numpy(zero_copy_only=False)


def map_images(arr: DataFrame, fun: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int, int], extra: str = "") -> DataFrame:
    """fun on each image as an array [z, y, x]; (img, data) again, flattened."""
    w, h, d = shape

    def run(batches):
        for b in batches:
            for k, x in enumerate(views(b.column(1))):
                out = np.asarray(fun(x.astype(float).reshape(d, h, w)), float).ravel()
                yield pa.record_batch([b.column(0).slice(k, 1), pa.array([out], pa.list_(pa.float64()))], ["img", "data"])

    return arr.select("img", "data").mapInArrow(run, "img long, data array<double>")


def fftn(arr: DataFrame, shape: tuple[int, int, int], inverse: bool = False) -> DataFrame:
    """(img, re, im): exponent +i forward and -i inverse, no factor in either direction; inverse takes columns re and im."""
    w, h, d = shape

    def run(batches):
        for b in batches:
            imaginary = views(b.column("im")) if inverse else None
            for k, x in enumerate(views(b.column("re" if inverse else "data"))):
                x = x.astype(complex).reshape(d, h, w)
                if inverse:
                    x = x + 1j * next(imaginary).reshape(d, h, w)
                y = np.fft.fftn(x) if inverse else np.fft.ifftn(x) * x.size
                parts = [pa.array([p.ravel()], pa.list_(pa.float64())) for p in (y.real, y.imag)]
                yield pa.record_batch([b.column("img").slice(k, 1), *parts], ["img", "re", "im"])

    return arr.mapInArrow(run, "img long, re array<double>, im array<double>")


def fft_shift(x: np.ndarray) -> np.ndarray:
    """Each half of every axis reversed."""
    for a in range(x.ndim):
        n = x.shape[a] // 2
        x = np.concatenate([np.flip(np.take(x, range(n), a), a), np.flip(np.take(x, range(n, x.shape[a]), a), a)], a) if x.shape[a] > 1 else x
    return x


def fft_round_up(x: np.ndarray) -> np.ndarray:
    """Padded to powers of two, centred."""
    pads = []
    for n in x.shape:
        m = 1 << (n - 1).bit_length()
        pads.append(((m - n) // 2, m - n - (m - n) // 2))
    return np.pad(x, pads)


def fft_round_down(x: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    return x[tuple(slice((m - n) // 2, (m - n) // 2 + n) for m, n in zip(x.shape, shape, strict=True))]


def convolve(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Circular convolution."""
    return np.fft.ifftn(np.fft.fftn(x) * np.fft.fftn(kernel, x.shape)).real


def homogenize(a: np.ndarray, b: np.ndarray, block: int = 8) -> np.ndarray:
    """b mapped to a by least-squares lines of overlapping blocks, blended with weights that fall off from their centres."""
    total, weight = np.zeros(b.shape), np.zeros(b.shape)
    step = max(1, block // 2)
    for z in range(0, b.shape[0], step):
        for y in range(0, b.shape[1], step):
            for x in range(0, b.shape[2], step):
                at = tuple(slice(p, p + block) for p in (z, y, x))
                p, q = a[at].ravel(), b[at].ravel()
                v = q.var()
                k = ((p * q).mean() - p.mean() * q.mean()) / v if v > 0 else 0.0
                fit = b[at] * k + p.mean() - k * q.mean()
                axes = [1 - np.abs((np.arange(n) + 0.5) / n * 2 - 1) + 1e-3 for n in b[at].shape]
                w = axes[0][:, None, None] * axes[1][None, :, None] * axes[2][None, None, :]
                total[at] += fit * w
                weight[at] += w
    return total / weight


def thumb(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area-weighted 2D thumbnail."""
    h, w = x.shape[-2:]

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.arange(m + 1) * n / m
        lo, hi = np.arange(n)[None, :], np.arange(n)[None, :] + 1
        return np.clip(np.minimum(edge[1:, None], hi) - np.maximum(edge[:-1, None], lo), 0, 1) * m / n

    return weights(h, height) @ x.reshape(h, w) @ weights(w, width).T


#: Six tetrahedra around a cell's main diagonal: paths from corner 0 to corner 7 that set one bit at a time.
TETRAHEDRA = [(0, 1 << a, (1 << a) | (1 << b), 7) for a in range(3) for b in range(3) if a != b]


def isosurface(x: np.ndarray, level: float) -> np.ndarray:
    """Triangles (n, 3, 3) of points (x, y, z) where values cross the level; at most the level is inside.

    Cells are cut into six tetrahedra by rule, so no table of cases is needed and neighbouring cells fit together.
    """
    d, h, w = x.shape
    cells = np.stack(np.meshgrid(np.arange(d - 1), np.arange(h - 1), np.arange(w - 1), indexing="ij"), -1).reshape(-1, 3)
    corner = [cells + [(k >> 2) & 1, (k >> 1) & 1, k & 1] for k in range(8)]
    value = [x[c[:, 0], c[:, 1], c[:, 2]] for c in corner]
    out = []
    for tet in TETRAHEDRA:
        p = np.stack([corner[k][:, ::-1] for k in tet], 1).astype(float)
        v = np.stack([value[k] for k in tet], 1)
        inside = v <= level
        n = inside.sum(1)
        order = np.argsort(~inside, 1, kind="stable")  # inside corners first

        def cut(rows, i, j, p=p, v=v, order=order):
            a, b = order[rows, i], order[rows, j]
            va, vb = v[rows, a], v[rows, b]
            t = ((level - va) / (vb - va))[:, None]
            return p[rows, a] + t * (p[rows, b] - p[rows, a])

        one, three, two = (np.flatnonzero(n == k) for k in (1, 3, 2))
        out.append(np.stack([cut(one, 0, j) for j in (1, 2, 3)], 1))
        out.append(np.stack([cut(three, j, 3) for j in (0, 1, 2)], 1))
        quad = [cut(two, i, j) for i, j in ((0, 2), (0, 3), (1, 3), (1, 2))]
        out += [np.stack([quad[0], quad[1], quad[2]], 1), np.stack([quad[0], quad[2], quad[3]], 1)]
    t = np.concatenate(out) if out else np.zeros((0, 3, 3))
    return t[np.linalg.norm(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), axis=1) > 0]


def surfaces(arr: DataFrame, shape: tuple[int, int, int], level: float) -> DataFrame:
    """(img, triangle, corner, px, py, pz) for each image."""
    w, h, d = shape

    def run(batches):
        for b in batches:
            for img, data in zip(b.column(0).to_pylist(), views(b.column(1)), strict=True):
                t = isosurface(data.astype(float).reshape(d, h, w), level)
                n = len(t)
                yield pa.record_batch([pa.array([img] * (3 * n), pa.int64()), pa.array(np.repeat(np.arange(n), 3)), pa.array(np.tile(np.arange(3), n)), *[pa.array(np.ascontiguousarray(t[:, :, k]).ravel()) for k in range(3)]], ["img", "triangle", "corner", "px", "py", "pz"])

    return arr.select("img", "data").mapInArrow(run, "img long, triangle long, corner long, px double, py double, pz double")
