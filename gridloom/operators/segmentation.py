"""Label and probability operators around a segmentation model.

Probabilities are a table (img, idx, ch, p); channel 0 is the background. Loops over neighbours write each round to the
shared folder and stop on a count, so lineage stays short and any executor may be lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..layout import AXES, Grid
from . import morphology as M
from .geometry import flip, swap
from .graph import saved
from .histogram import normalize_otsu_median
from .stencil import gaussian


def create_bg(channels: DataFrame) -> DataFrame:
    """Channels from 1 on, and channel 0 = max(0, 1 - their sum)."""
    rest = channels.select("img", "idx", (F.col("ch") + 1).alias("ch"), "p")
    bg = channels.groupBy("img", "idx").agg(F.greatest(1.0 - F.sum("p"), F.lit(0.0)).alias("p")).select("img", "idx", F.lit(0).cast(channels.schema["ch"].dataType).alias("ch"), "p")
    return rest.unionByName(bg)


def clamp_prob(channels: DataFrame) -> DataFrame:
    return channels.withColumn("p", F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)))


def zero_channel(channels: DataFrame, ch: int) -> DataFrame:
    return channels.withColumn("p", F.when(F.col("ch") == ch, F.lit(0.0)).otherwise(F.col("p")))


def renormalize(channels: DataFrame) -> DataFrame:
    """Channels of a voxel add up to 1; voxels whose channels are all 0 stay."""
    total = F.sum("p").over(Window.partitionBy("img", "idx"))
    return channels.withColumn("p", F.when(total > 0, F.try_divide(F.col("p"), total)).otherwise(F.col("p")))


def smooth_channels(channels: DataFrame, like: Grid, bandwidth: int = 1) -> DataFrame:
    """Gaussian of each channel; (img, ch) counts as an image."""
    vox = channels.join(like.df.select("img", "idx", *AXES), ["img", "idx"]).select(F.struct("img", "ch").alias("img"), *AXES, "idx", F.col("p").alias("v"))
    out = gaussian(like.with_df(vox), bandwidth).df
    return out.select(F.col("img.img").alias("img"), "idx", F.col("img.ch").alias("ch"), F.col("v").alias("p"))


def dndnco(grid: Grid) -> Grid:
    """Largest component, holes filled, closed, opened."""
    return M.opening(M.closing(M.defragment_and_fill_holes(grid)))


def create_mask(channels: DataFrame, like: Grid, prob: float = 0.5) -> Grid:
    """Where the smoothed background is under 1 - prob, cleaned up."""
    bg = channels.where("ch = 0").select("img", "idx", F.col("p").alias("v"))
    g = like.with_df(like.df.drop("v").join(bg, ["img", "idx"]).select(like.df.columns))
    return dndnco(gaussian(g, 2).map((F.col("v") < 1.0 - prob).cast("int")))


def argmax(channels: DataFrame, mask: Grid) -> Grid:
    """The channel (from 1) with the highest p inside the mask, the lowest of equals; 0 outside."""
    best = channels.where("ch >= 1").groupBy("img", "idx").agg(F.max_by("ch", F.struct("p", -F.col("ch"))).alias("label"))
    df = mask.df.join(best, ["img", "idx"], "left")
    return mask.with_df(df.withColumn("v", F.when(F.col("v") != 0, F.coalesce("label", F.lit(0))).otherwise(F.lit(0))).select(mask.df.columns))


def zscore_nonzero(grid: Grid) -> Grid:
    """(v - mean) / population deviation of the voxels that aren't 0, which alone are changed."""
    s = grid.df.where("v <> 0").groupBy("img").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    df = grid.df.join(s, "img", "left")
    return grid.with_df(df.withColumn("v", F.when((F.col("v") != 0) & (F.col("s") > 0), (F.col("v") - F.col("m")) / F.col("s")).otherwise(F.col("v").cast("double"))).select(grid.df.columns))


def handle_orientation(grid: Grid, steps: str, reverse: bool = False) -> Grid:
    """flip_* and swap_* steps joined by +, in order; reversed they undo themselves."""
    names = [s for s in steps.split("+") if s]
    for s in reversed(names) if reverse else names:
        kind, _, axes = s.partition("_")
        grid = flip(grid, axes) if kind == "flip" else swap(grid, axes[0], axes[1])
    return grid


def softmax(channels: DataFrame) -> DataFrame:
    """p of a voxel's channels as shares of their exponentials."""
    w = Window.partitionBy("img", "idx")
    e = channels.withColumn("e", F.exp(F.col("p") - F.max("p").over(w)))
    return e.select("img", "idx", "ch", (F.col("e") / F.sum("e").over(w)).alias("p"))


def preprocess(kinds: list[Grid], commands: str = "", mask: Grid | None = None) -> tuple[list[Grid], Grid]:
    """(kinds, mask): the mask from the first kind's positive voxels unless given, every kind scaled by its median, then
    commands joined by +: zscore_nonzero. Each image is on its own."""
    if mask is None:
        mask = dndnco(kinds[0].map((F.col("v") > 0).cast("int")))
    kinds = [normalize_otsu_median(g.map(F.col("v").cast("double"))) for g in kinds]
    for name in filter(None, commands.split("+")):
        if name.split(",")[0] != "zscore_nonzero":
            raise ValueError(f"unknown command {name!r}")
        kinds = [zscore_nonzero(g) for g in kinds]
    return kinds, mask


def postprocess(channels: DataFrame, like: Grid, commands: str, mask: Grid | None = None) -> dict:
    """{"channels", "mask", "labels"} after commands joined by +: create_bg, softmax, clamp_prob, smoothing, zero,<channel>,
    create_mask, argmax. argmax needs a mask: that given or made before."""
    out = {"channels": channels, "mask": mask, "labels": None}
    for step in filter(None, commands.split("+")):
        name, *args = step.split(",")
        if name == "create_bg":
            out["channels"] = create_bg(out["channels"])
        elif name == "softmax":
            out["channels"] = softmax(out["channels"])
        elif name == "clamp_prob":
            out["channels"] = clamp_prob(out["channels"])
        elif name == "smoothing":
            out["channels"] = smooth_channels(out["channels"], like)
        elif name == "zero" and len(args) == 1:
            out["channels"] = zero_channel(out["channels"], int(args[0]))
        elif name == "create_mask":
            out["mask"] = create_mask(out["channels"], like)
        elif name == "argmax" and out["mask"] is not None:
            out["labels"] = argmax(out["channels"], out["mask"])
        else:
            raise ValueError(f"{step!r} isn't known or lacks a mask")
    return out


def _majority(grid: Grid) -> DataFrame:
    """(img, x, y, z, u, n, of): the most frequent label over 0 of the 3^dim window, the smallest of equals, its count, all labels' count."""
    each = M.spread(grid.df.where("v > 0"), M.offsets(grid.dim, True, True), "v").groupBy("img", *AXES, "v").agg(F.count("*").alias("n"))
    return each.groupBy("img", *AXES).agg(F.max(F.struct("n", (-F.col("v")).alias("u"))).alias("t"), F.sum("n").alias("of")).select("img", *AXES, (-F.col("t.u")).alias("u"), F.col("t.n").alias("n"), "of")


def fill_and_smooth_labels(labels: Grid, mask: Grid, grow: int = 64, smooth: int = 12) -> Grid:
    """Labels grow into the rest of the mask by their neighbours' majority, then take the label that over half of the labelled neighbours have."""
    inside = mask.df.select("img", "idx", (F.col("v") != 0).alias("inside"))
    now = labels.with_df(saved(labels.df.join(inside, ["img", "idx"]).withColumn("v", F.when(F.col("inside"), F.col("v")).otherwise(F.lit(0))).drop("inside").select(labels.df.columns), "fill"))
    for k in range(grow + smooth):
        near = _majority(now)
        if k < grow:
            value = F.when((F.col("v") == 0) & F.col("inside"), F.coalesce("u", F.lit(0))).otherwise(F.col("v"))
        else:
            value = F.when((F.col("v") > 0) & (F.col("n") * 2 > F.col("of")), F.col("u")).otherwise(F.col("v"))
        df = now.df.join(inside, ["img", "idx"]).join(near, ["img", *AXES], "left").withColumn("next", value)
        new = saved(df.select(*labels.df.columns, "next"), "fill")
        moved = new.where("next <> v").limit(1).count()
        now = now.with_df(new.drop("v").withColumnRenamed("next", "v").select(labels.df.columns))
        if not moved and k >= grow:
            break
    return now
