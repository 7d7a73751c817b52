"""Histograms, thresholds and equalisation: bins are a small table an image, joined back by bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..layout import Grid

BINS = 256


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    b = F.floor(F.try_divide((v - low).cast("double") * bins, (high - low).cast("double")))
    return F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, bins: int = BINS) -> DataFrame:
    """(img, bin, n, low, high) with every bin, of images whose values differ."""
    ends = df.groupBy("img").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low < high")
    counts = df.join(ends, "img").groupBy("img", bin_of(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("img", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, ["img", "bin"], "left").select("img", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "low", "high")


def cdf(hist: DataFrame) -> DataFrame:
    return hist.withColumn("c", F.sum("n").over(Window.partitionBy("img").orderBy("bin")))


def otsu_from_histogram(hist: DataFrame, bins: int = BINS) -> DataFrame:
    """(img, threshold): the left edge of the first bin with the largest between-class variance, in doubles."""
    w, all_ = Window.partitionBy("img").orderBy("bin"), Window.partitionBy("img")
    n, k = F.col("n").cast("double"), F.col("bin")
    rows = hist.withColumns({"wb": F.sum(n).over(w), "sb": F.sum(n * k).over(w), "tw": F.sum(n).over(all_), "ts": F.sum(n * k).over(all_)})
    d = F.col("sb") * F.col("tw") - F.col("ts") * F.col("wb")
    wf = F.col("tw") - F.col("wb")
    sig = F.when((F.col("wb") > 0) & (wf > 0) & (k < bins - 1), F.try_divide(d * d, F.col("wb") * wf)).otherwise(F.lit(0.0))
    best = rows.groupBy("img", "low", "high").agg(F.max_by("bin", F.struct(sig.alias("s"), (-k).alias("k"))).alias("bin"))
    return best.select("img", (F.col("low") + F.col("bin") * (F.col("high") - F.col("low")) / float(bins)).alias("threshold"))


def otsu_threshold(df: DataFrame, skip: int = 1, bins: int = BINS) -> DataFrame:
    """(img, threshold), the first skip bins left out; the value itself for a constant image."""
    hist = histogram(df, bins)
    found = otsu_from_histogram(hist.withColumn("n", F.when(F.col("bin") < skip, 0).otherwise(F.col("n"))), bins)
    return df.groupBy("img").agg(F.min("v").cast("double").alias("low")).join(found, "img", "left").select("img", F.coalesce("threshold", "low").alias("threshold"))


def otsu(grid: Grid, ratio: float = 1.0) -> Grid:
    """1 where the value is over ratio times the threshold."""
    t = otsu_threshold(grid.df)
    return grid.with_df(grid.df.join(t, "img").withColumn("v", (F.col("v") > F.col("threshold") * ratio).cast("long")).drop("threshold"))


def otsu_count(df: DataFrame, level: float = 0.6) -> DataFrame:
    t = otsu_threshold(df)
    return df.join(t, "img").groupBy("img").agg(F.sum((F.col("v") > F.col("threshold") * level).cast("long")).alias("n"))


def otsu_median(df: DataFrame) -> DataFrame:
    """(img, m): the upper median of what is over the threshold, the threshold itself if nothing is."""
    from .stats import median

    t = otsu_threshold(df)
    m = median(df.join(t, "img").where("v > threshold").select("img", "v"), "img")
    return t.join(m, "img", "left").select("img", F.coalesce(F.col("median").cast("double"), "threshold").alias("m"))


def normalize_otsu_median(grid: Grid, upper: float | None = None) -> Grid:
    """v * upper * 0.5 / m, less a tenth of upper where over half of the voxels are positive, clamped to 0..upper.

    upper is 255.99 for integers and 1 for others unless given. Images with a median m of 0 stay as they are.
    """
    if upper is None:
        upper = 1.0 if grid.df.schema["v"].dataType.simpleString() in ("double", "float") else 255.99
    m = otsu_median(grid.df)
    share = grid.df.groupBy("img").agg((F.sum((F.col("v") > 0).cast("long")) * 2 > F.count("*")).alias("much"))
    df = grid.df.join(m, "img").join(share, "img")
    v = F.try_divide(F.col("v") * F.lit(upper * 0.5), F.col("m")) - F.when(F.col("much"), F.lit(upper * 0.1)).otherwise(F.lit(0.0))
    scaled = F.least(F.greatest(v, F.lit(0.0)), F.lit(upper))
    return grid.with_df(df.withColumn("v", F.when(F.col("m") == 0, F.col("v").cast("double")).otherwise(scaled)).select(grid.df.columns))


def hist_norm(grid: Grid, bins: int = BINS) -> Grid:
    """Equalised by the cumulative histogram; the first voxel stays."""
    h = cdf(histogram(grid.df, bins)).select("img", F.col("bin").alias("rank"), "c", "low", "high", F.max("c").over(Window.partitionBy("img")).alias("top"))
    ends = grid.df.groupBy("img").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    df = grid.df.join(ends, "img").withColumn("r", F.floor(F.try_divide((F.col("v") - F.col("lo")).cast("double") * (bins + 1), (F.col("hi") - F.col("lo")).cast("double"))))
    df = df.withColumn("rank", F.least(F.greatest(F.col("r") - 1, F.lit(0)), F.lit(bins - 1)).cast("int")).join(h, ["img", "rank"], "left")
    even = (F.col("hi") - F.col("lo")) * F.col("c") / F.col("top") + F.col("lo")
    v = F.when((F.col("idx") == 0) | F.col("c").isNull(), F.col("v").cast("double")).when(F.col("r") <= 0, F.col("lo").cast("double")).otherwise(even)
    return grid.with_df(df.withColumn("v", v).select(grid.df.columns))


def histogram_sharpening(df: DataFrame, bins: int = BINS, noise: float = 0.01) -> DataFrame:
    """(img, bin, n): bins weighted by H^2 / (H^2 + noise * max H^2) of the [1 2 1]-blurred histogram H."""
    w = Window.partitionBy("img").orderBy("bin")
    n = F.col("n").cast("double")
    h = histogram(df, bins).withColumn("b", (F.coalesce(F.lag(n).over(w), n) + 2 * n + F.coalesce(F.lead(n).over(w), n)) / 4.0)
    top = F.max(F.col("b") * F.col("b")).over(Window.partitionBy("img"))
    b2 = F.col("b") * F.col("b")
    return h.select("img", "bin", F.coalesce(F.try_divide(n * b2, b2 + noise * top), F.lit(0.0)).alias("n"), "low", "high")


def otsu_threshold_sharpening(df: DataFrame, bins: int = BINS) -> DataFrame:
    return otsu_from_histogram(histogram_sharpening(df, bins), bins)


def match_signal(pair: DataFrame, bins: int = BINS) -> DataFrame:
    """(idx, v): b mapped to a's scale by the least-squares line over rows where both are positive."""
    from .stats import pair_statistics

    s = pair_statistics(pair.where("a > 0 and b > 0"), "b", "a").select("slope", "intercept")
    return pair.crossJoin(F.broadcast(s)).select("idx", F.when(F.col("b") > 0, F.col("b") * F.col("slope") + F.col("intercept")).otherwise(F.lit(0.0)).alias("v"))
