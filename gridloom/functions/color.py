"""Colour functions on packed BGRA pixels (INT: b, g, r, a from the low byte) and palettes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(r: Column, g: Column, b: Column, a=0) -> Column:
    return (b.cast("long") + g.cast("long") * 256 + r.cast("long") * 65536 + F.lit(a).cast("long") * 16777216).alias("rgb")


def red(p: Column) -> Column:
    return F.shiftright(p, 16).bitwiseAND(F.lit(255))


def green(p: Column) -> Column:
    return F.shiftright(p, 8).bitwiseAND(F.lit(255))


def blue(p: Column) -> Column:
    return p.bitwiseAND(F.lit(255))


def to_gray(p: Column) -> Column:
    return F.floor((red(p) + green(p) + blue(p)) / 3).cast("long")


def intensity(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / 3.0


def saturation(r: Column, g: Column, b: Column) -> Column:
    total = r + g + b
    return F.when(total == 0, F.lit(0.0)).otherwise(1.0 - F.try_divide(3.0 * F.least(r, g, b), total))


def hue(r: Column, g: Column, b: Column) -> Column:
    """Angle in radians, 0 to 2 pi; 0 for grey."""
    num = 0.5 * ((r - g) + (r - b))
    den = F.sqrt((r - g) * (r - g) + (r - b) * (g - b))
    h = F.acos(F.greatest(F.least(F.try_divide(num, den), F.lit(1.0)), F.lit(-1.0)))
    return F.when(den == 0, F.lit(0.0)).when(b > g, 2 * math.pi - h).otherwise(h)


def spectrum_value(center: float, v: Column) -> Column:
    """255 within 32 of the centre, 0 from 96 on, a straight ramp between."""
    d = F.abs(v - center)
    return F.when(d <= 32, F.lit(255.0)).when(d >= 96, F.lit(0.0)).otherwise((96 - d) * 255.0 / 64)


def two_color(i: Column, first: tuple[int, int, int], second: tuple[int, int, int], n: int = 256) -> list[Column]:
    """Palette channels blended from first to second."""
    return [F.floor(F.lit(float(a)) * (n - 1 - i) / (n - 1) + F.lit(float(b)) * i / (n - 1)).cast("long") for a, b in zip(first, second, strict=True)]


def color_index(v: Column, low: float, high: float) -> Column:
    """Palette entry of a value, 0 to 255."""
    span = high - low if high > low else 1.0
    return F.least(F.greatest(F.floor((v - low) * 255.99 / span), F.lit(0)), F.lit(255)).cast("long")


def palette(spark, first: tuple[int, int, int], second: tuple[int, int, int], n: int = 256):
    """(i, r, g, b) of a blend, n rows."""
    r, g, b = two_color(F.col("id"), first, second, n)
    return spark.range(n).select(F.col("id").alias("i"), r.alias("r"), g.alias("g"), b.alias("b"))


def value_to_color(df, colors, low: float, high: float):
    """df with r, g, b of its values; the palette has a few hundred rows, so it is broadcast."""
    return df.withColumn("i", color_index(F.col("v"), low, high)).join(F.broadcast(colors), "i").drop("i")


def _channel(v: Column, top: float) -> Column:
    return F.floor(F.least(F.greatest(v * top, F.lit(0.0)), F.lit(255.0))).cast("long")


def from_hsi(h: Column, s: Column, i: Column) -> Column:
    """STRUCT<r, g, b> of hue (radians), saturation and intensity (0 to 1): a third of the circle has one channel at its least."""
    third = 2 * math.pi / 3
    part = F.least(F.greatest(F.floor(h / third), F.lit(0)), F.lit(2))
    t = h - part * third
    low = i * (1.0 - s)
    high = i * (1.0 + s * F.cos(t) / F.cos(math.pi / 3 - t))
    rest = 3.0 * i - low - high
    pick = lambda a, b, c: F.when(part == 0, a).when(part == 1, b).otherwise(c)
    return F.struct(_channel(pick(high, low, rest), 255.0).alias("r"), _channel(pick(rest, high, low), 255.0).alias("g"), _channel(pick(low, rest, high), 255.0).alias("b"))


def from_hsl(h: Column, s: Column, light: Column) -> Column:
    """STRUCT<r, g, b> of hue (radians), saturation and lightness (0 to 1), by the six parts of the circle."""
    t = h / (math.pi / 3)
    c = (1.0 - F.abs(2.0 * light - 1.0)) * s
    x = c * (1.0 - F.abs(F.pmod(t, F.lit(2.0)) - 1.0))
    m, part, zero = light - c * 0.5, F.pmod(F.floor(t), F.lit(6)), F.lit(0.0)
    pick = lambda *six: F.element_at(F.array(*six), (part + 1).cast("int"))
    return F.struct(_channel(pick(c, x, zero, zero, x, c) + m, 256.0).alias("r"), _channel(pick(x, c, c, x, zero, zero) + m, 256.0).alias("g"), _channel(pick(zero, zero, x, c, c, x) + m, 256.0).alias("b"))


#: The golden ratio's fraction, and lightness steps of generated colours.
GOLDEN, LIGHT_STEPS = 0.618033988749895, [0.0, -0.2, 0.1, -0.15, 0.05, -0.2, 0.1, -0.15]


def _golden_hue(k: Column) -> Column:
    return F.pmod(k * GOLDEN, F.lit(2.0)) * math.pi


def generate(k: Column) -> Column:
    """A colour for a number: hues by the golden ratio, saturation and lightness change every 13."""
    turn = F.floor(k / 13)
    light = F.element_at(F.array(*[F.lit(x) for x in LIGHT_STEPS]), (F.pmod(turn, F.lit(8)) + 1).cast("int")) + 0.7
    return from_hsl(_golden_hue(k), F.when(turn % 2 == 1, F.lit(0.75)).otherwise(F.lit(0.95)), light)


def generate_hue(k: Column) -> Column:
    """A colour for a number: hues by the golden ratio alone."""
    return from_hsl(_golden_hue(k), F.lit(0.85), F.lit(0.7))


def color_bar(spark, first: tuple[int, int, int], second: tuple[int, int, int], width: int = 20, height: int = 257):
    """(x, y, r, g, b): a bar from second (top) to first (bottom) with a black frame of one pixel."""
    x, y = (F.col("id") % width).cast("int"), F.floor(F.col("id") / width).cast("int")
    inside = x.between(1, width - 2) & y.between(1, height - 2)
    t = y / float(height)
    mix = [F.when(inside, F.floor(t * float(a) + (1.0 - t) * float(b))).otherwise(F.lit(0)).cast("long") for a, b in zip(first, second, strict=True)]
    return spark.range(width * height).select(x.alias("x"), y.alias("y"), *[m.alias(n) for m, n in zip(mix, "rgb", strict=True)])


def spectrum_bar(spark, width: int = 20, height: int = 257):
    """(x, y, r, g, b): the spectrum from top to bottom with a black frame of one pixel; steps as in spectrum tables of bytes."""
    x, y = (F.col("id") % width).cast("int"), F.floor(F.col("id") / width).cast("int")
    inside = x.between(1, width - 2) & y.between(1, height - 2)
    v = F.floor(y * 255.0 / height)

    def at(center: int) -> Column:
        d = F.abs(v - center) - 32
        return F.when(~inside, F.lit(0)).when(d < 0, F.lit(255)).when(d >= 64, F.lit(0)).otherwise(255 - d * 4).cast("long")

    return spark.range(width * height).select(x.alias("x"), y.alias("y"), at(64).alias("r"), at(128).alias("g"), at(192).alias("b"))


def map_values(v: Column, low: float, high: float, n: int) -> Column:
    """Entry of a map of n colours for a value between low and high, clamped at the ends."""
    step = n / (high - low) if high != low else 1.0
    return F.least(F.greatest(F.floor((v - low) * step), F.lit(0)), F.lit(n - 1)).cast("long")
