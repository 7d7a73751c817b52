"""Layouts of images: one row a voxel (vox), or one row an image with an array (arr).

vox: img, x, y, z, idx, v with idx = (z * h + y) * w + x. A Grid is a vox DataFrame whose images share one shape.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
COLUMNS = ["img", "x", "y", "z", "idx", "v"]


def voxel_index(x, y, z, shape: tuple[int, int, int]) -> Column:
    w, h, _ = shape
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return ((as_col(z).cast("long") * h + as_col(y)) * w + as_col(x)).cast("long")


@dataclass(frozen=True)
class Grid:
    """Dense images of one shape, with voxel size, affine (row-major 4x4) and whether they are in template space."""

    df: DataFrame
    shape: tuple[int, int, int]
    vs: tuple[float, float, float] = (1.0, 1.0, 1.0)
    affine: tuple[float, ...] = (1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0)
    is_mni: bool = False
    meta: dict = field(default_factory=dict)

    @property
    def dim(self) -> int:
        return 3 if self.shape[2] > 1 else 2

    @property
    def size(self) -> int:
        w, h, d = self.shape
        return w * h * d

    def map(self, value: Column) -> Grid:
        """A new value for each voxel, in one projection."""
        return replace(self, df=self.df.withColumn("v", value))

    def with_df(self, df: DataFrame, shape: tuple[int, int, int] | None = None, **meta) -> Grid:
        return replace(self, df=df, shape=shape or self.shape, **meta)

    def line(self, axis: str) -> WindowSpec:
        """The window of a voxel's line along an axis, in order."""
        return Window.partitionBy("img", *[a for a in AXES if a != axis]).orderBy(axis)

    def scan(self) -> WindowSpec:
        """The window of the whole image in storage order; a task an image."""
        return Window.partitionBy("img").orderBy("idx")


def reindex(df: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Columns in order, idx anew for a shape."""
    return df.select("img", *[F.col(a).cast("int").alias(a) for a in AXES], voxel_index("x", "y", "z", shape).alias("idx"), "v")


def empty_grid(spark: SparkSession, images: DataFrame | list[int], shape: tuple[int, int, int]) -> DataFrame:
    """Every position of every image (img, x, y, z, idx), made by the executors. images: a table with img, or ids."""
    w, h, d = shape
    if isinstance(images, list):
        ids = F.array(*[F.lit(int(i)).cast("long") for i in images])
        base = spark.range(w * h * d).withColumnRenamed("id", "idx").select(F.explode(ids).alias("img"), "idx")
    else:
        base = images.select("img").distinct().select("img", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(w * h * d - 1).cast("long"))).alias("idx"))
    return base.select("img", (F.col("idx") % w).cast("int").alias("x"), (F.floor(F.col("idx") / w) % h).cast("int").alias("y"), F.floor(F.col("idx") / (w * h)).cast("int").alias("z"), "idx")


def fill(grid: Grid, shape: tuple[int, int, int], background=0) -> Grid:
    """The grid's voxels on a new shape, zero where it has none."""
    kind = grid.df.schema["v"].dataType.simpleString()
    at = empty_grid(grid.df.sparkSession, grid.df, shape)
    out = at.join(grid.df.select("img", "x", "y", "z", "v"), ["img", "x", "y", "z"], "left")
    return grid.with_df(out.select("img", "x", "y", "z", "idx", F.coalesce("v", F.lit(background)).cast(kind).alias("v")), shape)


def to_arrays(grid: Grid) -> DataFrame:
    """One row an image: img and its values in storage order."""
    rows = grid.df.groupBy("img").agg(F.array_sort(F.collect_list(F.struct("idx", "v"))).alias("a"))
    return rows.select("img", F.transform("a", lambda s: s["v"]).alias("data"))


def from_arrays(arr: DataFrame, shape: tuple[int, int, int], **meta) -> Grid:
    w, h, _ = shape
    df = arr.select("img", F.posexplode("data").alias("i", "v"))
    df = df.select("img", (F.col("i") % w).cast("int").alias("x"), (F.floor(F.col("i") / w) % h).cast("int").alias("y"), F.floor(F.col("i") / (w * h)).cast("int").alias("z"), F.col("i").cast("long").alias("idx"), "v")
    return Grid(df, shape, **meta)
