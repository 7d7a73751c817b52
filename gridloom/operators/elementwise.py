"""Element-wise operators: each is a Column, so chains of them are one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def divide(a: Column, b: Column, integral: bool = False) -> Column:
    """a / b; a float zero gives inf or NaN, an integer zero null."""
    if integral:
        return F.when(b != 0, (F.signum(a.cast("double")) * F.signum(b.cast("double"))).cast("long") * F.floor(F.abs(a) / F.abs(b)).cast("long"))
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).otherwise(F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF)).otherwise(F.lit(NAN)))


def mod_constant(v: Column, c) -> Column:
    return v % F.lit(c)


def greater(a: Column, b) -> Column:
    return (a > b).cast("int")


def lesser(a: Column, b) -> Column:
    return (a < b).cast("int")


def equal(a: Column, b) -> Column:
    return (a == b).cast("int")


def square_root(v: Column) -> Column:
    return F.sqrt(v.cast("double"))


def log(v: Column) -> Column:
    """Natural logarithm: -inf at 0, NaN below."""
    v = v.cast("double")
    return F.when(v > 0, F.ln(v)).when(v == 0, F.lit(-INF)).when(v < 0, F.lit(NAN))


def multiply_pow(v: Column, b) -> Column:
    """v * 2^b for integers that keeps the sign and truncates; b may be a column or a number."""
    b = (b if isinstance(b, Column) else F.lit(b)).cast("int")
    size = F.when(b >= 0, F.call_function("shiftleft", F.abs(v), b)).otherwise(F.call_function("shiftright", F.abs(v), -b))
    return F.when((v == 0) | (b == 0), v).otherwise(F.signum(v.cast("double")).cast("long") * size)


def divide_pow(v: Column, b) -> Column:
    return multiply_pow(v, -(b if isinstance(b, Column) else F.lit(b)))


def masking(v: Column, mask: Column) -> Column:
    """0 where the mask is set."""
    return F.when(mask != 0, F.lit(0)).otherwise(v)


def masking_by_value(v: Column, mask: Column, c) -> Column:
    return F.when(mask > c, F.lit(0)).otherwise(v)


def preserve(v: Column, mask: Column) -> Column:
    """0 where the mask isn't set."""
    return F.when(mask == 0, F.lit(0)).otherwise(v)


def preserve_by_value(v: Column, mask: Column, c) -> Column:
    return F.when(mask < c, F.lit(0)).otherwise(v)


def paint(mask: Column, v: Column, value) -> Column:
    return F.when(mask != 0, F.lit(value)).otherwise(v)


def masked(v: Column, mask: Column, expr: Column) -> Column:
    """Assignment under a mask: expr where it is set, v elsewhere."""
    return F.when(mask, expr).otherwise(v)


def upper_threshold(v: Column, upper) -> Column:
    return F.least(v, F.lit(upper))


def lower_threshold(v: Column, lower) -> Column:
    return F.greatest(v, F.lit(lower))


def upper_lower_threshold(v: Column, lower, upper) -> Column:
    return F.least(F.greatest(v, F.lit(lower)), F.lit(upper))


def threshold(v: Column, t, fg=1, bg=0) -> Column:
    return F.when(v > t, F.lit(fg)).otherwise(F.lit(bg))


def binary(v: Column, fun) -> Column:
    return F.when(fun(v), F.lit(1)).otherwise(F.lit(0))


def over_image(*by: str):
    return Window.partitionBy(*(by or ("img",)))


def normalize(v: Column, upper=255.0, by=("img",)) -> Column:
    """Scaled so that the image's maximum is upper; unchanged where the maximum is 0."""
    top = F.max(v).over(over_image(*by))
    return F.when(top != 0, v * F.try_divide(F.lit(float(upper)), top.cast("double"))).otherwise(v.cast("double"))


def normalize_abs(v: Column, upper=1.0, by=("img",)) -> Column:
    w = over_image(*by)
    top = F.greatest(-F.min(v).over(w), F.max(v).over(w))
    return F.when(top != 0, v * F.try_divide(F.lit(float(upper)), top.cast("double"))).otherwise(v.cast("double"))


def normalize_upper_lower(v: Column, upper=255.0, by=("img",)) -> Column:
    w = over_image(*by)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(high > low, (v - low) * F.try_divide(F.lit(float(upper)), (high - low).cast("double"))).otherwise(v.cast("double"))


def invert(v: Column, by=("img",)) -> Column:
    return F.max(v).over(over_image(*by)) - v


def write_back(v: Column, low: int, high: int) -> Column:
    """Round half away from zero, saturate."""
    v = v.cast("double")
    return F.least(F.greatest(F.signum(v) * F.floor(F.abs(v) + 0.5), F.lit(float(low))), F.lit(float(high))).cast("long")


def array_map(data: Column, fun) -> Column:
    """A unary operator over an array column."""
    return F.transform(data, fun)


def array_zip(a: Column, b: Column, fun) -> Column:
    return F.zip_with(a, b, fun)


def pairwise(a: DataFrame, b: DataFrame, fun, on=("img", "idx"), name: str = "v") -> DataFrame:
    """fun(value of a, value of b) for equal positions; the other columns are a's."""
    other = b.select(*on, F.col("v").alias("__other"))
    return a.join(other, list(on)).withColumn(name, fun(F.col("v"), F.col("__other"))).drop("__other")


def is_label_image(df: DataFrame) -> DataFrame:
    """(img, is_label): integral values, and a maximum under 12 or more equal than different neighbours along x."""
    w = Window.partitionBy("img", "y", "z").orderBy("x")
    n = F.lead("v").over(w)
    rows = df.withColumn("same", (n == F.col("v")).cast("int")).withColumn("differs", (n != F.col("v")).cast("int"))
    return rows.groupBy("img").agg((F.bool_and(F.col("v") == F.floor("v")) & ((F.max("v") < 12) | (F.sum("same") > F.sum("differs")))).alias("is_label"))


def has_mask(df: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(img, has_mask): over a fifth of the voxels are 0, or the box of the others lies strictly inside along an axis."""
    on = F.col("v") != 0
    inside = [(F.min(F.when(on, F.col(a))) > 0) & (F.max(F.when(on, F.col(a))) < n - 1) for a, n in zip("xyz", shape, strict=True)]
    return df.groupBy("img").agg((F.coalesce((F.sum((~on).cast("int")) * 5 > F.count("*")) | inside[0] | inside[1] | inside[2], F.lit(True))).alias("has_mask"))
