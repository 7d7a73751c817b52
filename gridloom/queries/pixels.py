"""Filters on bytes and colours made of the volumes' values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import VOL_SQL, vol
from ..operators import pixels as P
from ..operators import stencil as S
from .registry import Registry

REG = Registry()
LINES = {"x": "img, y, z", "y": "img, x, z", "z": "img, x, y"}
#: A pixel's columns and what they are of v.
BYTE = {"v": "v % 256"}
COLOUR = {"r": "v % 256", "g": "v * 3 % 256", "b": "v * 7 % 256"}


def _side(way: str, c: str, a: str) -> str:
    return f"coalesce({way}({c}) OVER (PARTITION BY {LINES[a]} ORDER BY {a}), {c})"


def _pixel(value: str) -> str:
    return f"CAST(least(greatest(sign({value}) * floor(abs({value}) + 0.5), 0), 255) AS BIGINT)"


def _first(cols: dict) -> str:
    return f"{VOL_SQL}, p AS (SELECT img, x, y, z, idx, {', '.join(f'({e})::DOUBLE AS {c}' for c, e in cols.items())} FROM vol)"


def _line(cols, weights: tuple[int, int, int]) -> str:
    """Sums with weights along the three axes, s3 in the end."""
    out, last = [], "p"
    for k, a in enumerate("xyz"):
        each = [f"{weights[0]} * {_side('lag', c, a)} + {weights[1]} * {c} + {weights[2]} * {_side('lead', c, a)} AS {c}" for c in cols]
        out.append(f"s{k + 1} AS (SELECT img, x, y, z, idx, {', '.join(each)} FROM {last})")
        last = f"s{k + 1}"
    return ", ".join(out)


def _laplacian(c: str) -> str:
    return " + ".join(f"{_side('lag', c, a)} - 2 * {c} + {_side('lead', c, a)}" for a in "xyz")


def _sobel(cols) -> str:
    first = [f"{_side('lead', c, a)} - {_side('lag', c, a)} AS {c}_{a}" for c in cols for a in "xyz"]
    out, last = [f"q0 AS (SELECT img, x, y, z, idx, {', '.join(first)} FROM p)"], "q0"
    for a in "xyz":
        smooth = lambda n, a=a: f"{_side('lag', n, a)} + 2 * {n} + {_side('lead', n, a)} AS {n}"
        each = [smooth(f"{c}_{b}") if a != b else f"{c}_{b}" for c in cols for b in "xyz"]
        out.append(f"q_{a} AS (SELECT img, x, y, z, idx, {', '.join(each)} FROM {last})")
        last = f"q_{a}"
    return ", ".join(out)


def _sql(cols: dict, steps: str, table: str, value) -> str:
    inner = ", ".join(f"{value(c)} AS {c}" for c in cols)
    pixel = ", ".join(f"{_pixel(c)} AS {c}" for c in cols)
    return f"WITH {_first(cols)}{', ' + steps if steps else ''}, o AS (SELECT img, idx, {inner} FROM {table}) SELECT img, idx, {pixel} FROM o"


def _bytes(spark, sf_dir):
    return vol(spark, sf_dir).map((F.col("v") % 256).cast("smallint"))


def _colours(spark, sf_dir):
    return vol(spark, sf_dir).map(F.struct(*[(F.col("v") * k % 256).cast("smallint").alias(c) for c, k in zip("rgb", (1, 3, 7), strict=True)]))


def _add(name: str, byte, colour, steps, table: str, value) -> None:
    REG.add(f"{name}_int", lambda s, d: P.typed(_bytes(s, d), byte, P.BYTE).df.select("img", "idx", F.col("v").cast("long").alias("v")), _sql(BYTE, steps(BYTE), table, value))
    out = lambda s, d: colour(_colours(s, d)).df.select("img", "idx", *[F.col(f"v.{c}").cast("long").alias(c) for c in "rgb"])
    REG.add(f"{name}_rgb", out, _sql(COLOUR, steps(COLOUR), table, value))


_add("filter_gaussian", S.gaussian, P.gaussian_rgb, lambda cols: _line(cols, (1, 2, 1)), "s3", lambda c: f"{c} / 64")
_add("filter_mean", S.mean, P.mean_rgb, lambda cols: _line(cols, (1, 1, 1)), "s3", lambda c: f"{c} / 27")
_add("filter_laplacian", S.laplacian, P.laplacian_rgb, lambda cols: "", "p", _laplacian)
_add("filter_sobel", S.sobel, P.sobel_rgb, _sobel, "q_z", lambda c: f"abs({c}_x) + abs({c}_y) + abs({c}_z)")
