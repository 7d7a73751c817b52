"""String commands on images: command(grid, name, parameter) returns a new Grid, lazily planned."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import functions as F

from ..layout import AXES, Grid
from ..operators import elementwise as E
from ..operators import geometry as G
from ..operators import histogram as H
from ..operators import morphology as M
from ..operators import resample as R
from ..operators import stats as S
from ..operators import stencil as W
from .expression import evaluate


class CommandError(ValueError):
    pass


def _numbers(text: str, kind=float) -> list:
    return [kind(t) for t in text.replace(",", " ").split()]


def _three(text: str, kind=float) -> tuple:
    n = _numbers(text, kind)
    if len(n) not in (1, 3):
        raise CommandError(f"one or three numbers are needed, not {text!r}")
    return tuple(n * 3 if len(n) == 1 else n)


def _integral(grid: Grid) -> bool:
    return grid.df.schema["v"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")


def _normalize(grid: Grid, _: str) -> Grid:
    if _integral(grid):
        return grid.map(E.upper_lower_threshold(F.floor(E.normalize(F.col("v"), 255.99)), 0, 255).cast("long"))
    return grid.map(E.normalize(F.col("v"), 1.0))


def _header_flip(axis: str):
    def run(grid: Grid, _: str) -> Grid:
        a, k = list(grid.affine), AXES.index(axis)
        for r in range(3):
            a[4 * r + 3] += a[4 * r + k] * (grid.shape[k] - 1)
            a[4 * r + k] = -a[4 * r + k]
        return replace(grid, affine=tuple(a))

    return run


def _header_swap(p: str, q: str):
    def run(grid: Grid, _: str) -> Grid:
        a, vs, i, j = list(grid.affine), list(grid.vs), AXES.index(p), AXES.index(q)
        a[4 * i : 4 * i + 4], a[4 * j : 4 * j + 4] = a[4 * j : 4 * j + 4], a[4 * i : 4 * i + 4]
        vs[i], vs[j] = vs[j], vs[i]
        return replace(grid, affine=tuple(a), vs=tuple(vs))

    return run


def _set_transformation(grid: Grid, text: str) -> Grid:
    a = tuple(_numbers(text))
    if len(a) != 16:
        raise CommandError("sixteen numbers are needed")
    return replace(grid, affine=a, vs=tuple(sum(a[4 * r + c] ** 2 for r in range(3)) ** 0.5 for c in range(3)))


def _set_translocation(grid: Grid, text: str) -> Grid:
    a = list(grid.affine)
    a[3], a[7], a[11] = _three(text)
    return replace(grid, affine=tuple(a))


def _crop_to_fit(grid: Grid, text: str) -> Grid:
    """The box of the largest component over all images, plus a margin. Six numbers come to the driver: they are the new shape."""
    margin = _three(text or "0", int)
    b = S.bounding_box(M.defragment(grid.map((F.col("v") > 0).cast("int"))).df).agg(*[F.min(f"{a}0") for a in AXES], *[F.max(f"{a}1") for a in AXES]).first()
    if b[0] is None:
        return grid
    low = tuple(max(0, b[i] - m) for i, m in enumerate(margin))
    high = tuple(min(n, b[3 + i] + m) for i, (n, m) in enumerate(zip(grid.shape, margin, strict=True)))
    a = list(grid.affine)
    for r in range(3):
        a[4 * r + 3] += sum(a[4 * r + c] * low[c] for c in range(3))
    return replace(G.crop(grid, low, high), affine=tuple(a))


def _transform(grid: Grid, text: str) -> Grid:
    """Resampled onto another affine of the same shape."""
    import numpy as np

    u = tuple(_numbers(text))
    if len(u) != 16:
        raise CommandError("sixteen numbers are needed")
    m = np.linalg.inv(np.array(grid.affine).reshape(4, 4)) @ np.array(u).reshape(4, 4)
    return replace(R.resample_affine(grid, grid.shape, m[:3].ravel().tolist()), affine=u, vs=tuple(float(x) for x in np.linalg.norm(np.array(u).reshape(4, 4)[:3, :3], axis=0)))


def _refine_label(grid: Grid, text: str, other: Grid | None) -> Grid:
    from ..operators.ml import refine_label

    return refine_label(grid, _other(other))


def _other(other: Grid | None) -> Grid:
    if other is None:
        raise CommandError("this command needs a second image")
    return other


def _pair(fun):
    return lambda grid, text, other: grid.with_df(E.pairwise(grid.df, _other(other).df, fun))


def _plain(fun) -> Callable[[Grid, str], Grid]:
    return lambda grid, _: fun(grid)


def _labels(op):
    return lambda grid, _: M.for_each_label(grid, op)


V = F.col
#: name -> function of (grid, parameter)
COMMANDS: dict[str, Callable[[Grid, str], Grid]] = {
    "morphology_defragment": _plain(M.defragment),
    "morphology_fill_holes": _plain(M.fill_holes),
    "morphology_fill_holes_by_slice": _plain(M.fill_holes_by_slice),
    "morphology_defragment_by_size": lambda g, p: M.defragment_by_size_ratio(g, float(p or 0.05)),
    "morphology_dilation": _labels(M.mask_dilation),
    "morphology_erosion": _labels(M.mask_erosion),
    "morphology_opening": _labels(M.mask_opening),
    "morphology_closing": _labels(M.mask_closing),
    "morphology_edge": _labels(M.mask_edge),
    "morphology_edge_xy": _labels(lambda m: M.mask_edge(m, "xy")),
    "morphology_edge_xz": _labels(lambda m: M.mask_edge(m, "xz")),
    "morphology_smoothing": _plain(M.smoothing_by_kind),
    "sobel_filter": _plain(W.sobel),
    "gaussian_filter": _plain(W.gaussian),
    "mean_filter": _plain(W.mean),
    "smoothing_filter": _plain(W.anisotropic_diffusion),
    "normalize": _normalize,
    "normalize_otsu_median": _plain(H.normalize_otsu_median),
    "flip_x": lambda g, _: G.flip(g, "x"),
    "flip_y": lambda g, _: G.flip(g, "y"),
    "flip_z": lambda g, _: G.flip(g, "z"),
    "select_value": lambda g, p: g.map(E.equal(V("v"), float(p))),
    "add_value": lambda g, p: g.map(V("v") + float(p)),
    "multiply_value": lambda g, p: g.map(V("v") * float(p)),
    "lower_threshold": lambda g, p: g.map(E.lower_threshold(V("v").cast("double"), float(p))),
    "upper_threshold": lambda g, p: g.map(E.upper_threshold(V("v").cast("double"), float(p))),
    "threshold": lambda g, p: g.map(E.threshold(V("v"), float(p))),
    "otsu_threshold": lambda g, p: H.otsu(g, float(p or 1)),
    "equation": lambda g, p: evaluate(g, p, CALLS),
    "set_transformation": _set_transformation,
    "set_translocation": _set_translocation,
    "set_mni": lambda g, p: replace(g, is_mni=p[:1] == "1"),
    "upsampling": lambda g, _: replace(R.upsample(g), affine=_scaled(g, 0.5)),
    "downsampling": lambda g, _: replace(R.downsample_with_padding(g), affine=_scaled(g, 2.0)),
    "header_flip_x": _header_flip("x"),
    "header_flip_y": _header_flip("y"),
    "header_flip_z": _header_flip("z"),
    "header_swap_xy": _header_swap("x", "y"),
    "header_swap_xz": _header_swap("x", "z"),
    "header_swap_yz": _header_swap("y", "z"),
    "swap_xy": lambda g, _: G.swap(g, "x", "y"),
    "swap_xz": lambda g, _: G.swap(g, "x", "z"),
    "swap_yz": lambda g, _: G.swap(g, "y", "z"),
    "crop_to_fit": _crop_to_fit,
    "transform": _transform,
    "translocate": lambda g, p: R.translocate(g, _three(p)),
    "resize": lambda g, p: G.reshape(g, _three(p, int)),
    "resize_at_center": lambda g, p: G.resize_at_center(g, _three(p, int)),
    "reshape": lambda g, p: G.reshape(g, _three(p, int)),
    "regrid": lambda g, p: R.regrid(g, _three(p)),
}

#: name -> function of (grid, parameter, other grid)
PAIRED: dict[str, Callable[[Grid, str, Grid | None], Grid]] = {
    "concatenate_image": lambda g, _, o: G.concatenate(g, _other(o)),
    "multiply_image": _pair(lambda a, b: a * b),
    "add_image": _pair(lambda a, b: a + b),
    "minus_image": _pair(lambda a, b: a - b),
    "max_image": _pair(F.greatest),
    "min_image": _pair(F.least),
    "load_image": lambda g, _, o: _other(o),
    "refine_label": _refine_label,
}

#: Commands that an expression may call.
CALLS = {n: (lambda g, n=n: COMMANDS[n](g, "")) for n in ("gaussian_filter", "mean_filter", "sobel_filter", "smoothing_filter", "normalize", "otsu_threshold", "morphology_defragment", "morphology_erosion", "morphology_dilation", "morphology_fill_holes", "flip_x", "flip_y", "flip_z")}


def _scaled(grid: Grid, by: float) -> tuple[float, ...]:
    a = list(grid.affine)
    for r in range(3):
        for c in range(grid.dim):
            a[4 * r + c] *= by
    return tuple(a)


def command(grid: Grid, name: str, parameter: str = "", other: Grid | None = None) -> Grid:
    """Run one command. morphology commands on float images work on v > 0 and keep the values inside the result."""
    if name in PAIRED:
        return PAIRED[name](grid, parameter, other)
    if name not in COMMANDS:
        raise CommandError(f"unknown command {name!r}")
    if name.startswith("morphology") and not _integral(grid):
        m = COMMANDS[name](grid.map((V("v") > 0).cast("int")), parameter)
        return grid.with_df(E.pairwise(grid.df, m.df, E.preserve))
    return COMMANDS[name](grid, parameter)


def save(grid: Grid, path: str, kind: str = "nifti", name: str = "image") -> Grid:
    """Every image of the grid written as a file of a format into a folder; the grid comes back for further commands."""
    from ..layout import to_arrays
    from ..sources import images

    spark = grid.df.sparkSession
    images.register(spark)
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    rows = to_arrays(grid).select(F.lit(None).cast("string").alias("path"), F.lit(name).alias("name"), F.col("img").cast("int").alias("volume"), F.array(*[F.lit(int(n)) for n in grid.shape]).alias("shape"), numbers(grid.vs).alias("vs"), numbers(grid.affine).alias("affine"), F.transform("data", lambda x: x.cast("double")).alias("data"))
    rows.write.format(kind).mode("append").save(path)
    return grid


def run(grid: Grid, script: str, others: dict[str, Grid] | None = None) -> Grid:
    """Commands joined by +, each name:parameter; a parameter may name an image of others."""
    for step in filter(None, script.split("+")):
        name, _, parameter = step.partition(":")
        if name.strip() == "save":
            grid = save(grid, parameter)
            continue
        grid = command(grid, name.strip(), parameter, (others or {}).get(parameter))
    return grid
