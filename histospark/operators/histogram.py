"""Histograms of 256 bins and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import OBJECT, PIXEL

BINS = 256


def image_histogram(px: DataFrame, mask: DataFrame | None = None, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(image_id, bin, cnt) of v; within a mask (v > 0) and a rectangle (y, x, height, width) if given."""
    if roi:
        y, x, h, w = roi
        px = px.where(F.col("y").between(y, y + h - 1) & F.col("x").between(x, x + w - 1))
    if mask is not None:
        px = px.join(mask.where("v > 0").select(*PIXEL), PIXEL, "left_semi")
    return px.groupBy("image_id", F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def masked_histogram(px: DataFrame, mask: DataFrame) -> DataFrame:
    """(image_id, bin, cnt) of the bits that v and the mask have in common, where pixels with mask 0 are taken out of bin 0 again."""
    both = px.join(mask.select(*PIXEL, F.col("v").alias("_m")), PIXEL)
    one = F.when(F.col("_m") == 0, 0).otherwise(1)
    counts = both.groupBy("image_id", F.col("v").bitwiseAND(F.col("_m")).alias("bin")).agg(F.sum(one).cast("long").alias("cnt"))
    return counts.where("cnt > 0")


def object_histogram(labels: DataFrame, gray: DataFrame) -> DataFrame:
    """(image_id, label, bin, cnt): labels may overlap, as cytoplasm rings do."""
    both = labels.join(gray.select(*PIXEL, "v"), PIXEL)
    return both.groupBy(*OBJECT, F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def statistics(hist: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per ``keys``: n, nonzero, mean, std, minimum, maximum, median, first_quartile, third_quartile, entropy, energy, skewness, kurtosis.

    Moments are populations', from integer power sums; kurtosis is not excess; both are 0 where they are undefined. Quantiles are the first bin
    at which the running count reaches n div 2, n div 4, 3n div 4, and 0 where that is 0.
    """
    keys = keys or OBJECT
    h, i = F.col("cnt"), F.col("bin").cast("long")
    running = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = hist.withColumns({"_c": F.sum("cnt").over(running), "_n": F.sum("cnt").over(Window.partitionBy(*keys))})
    reach = lambda target: F.min(F.when(F.col("_c") >= target, F.col("bin")))
    n_ = F.col("_n")
    half, quarter, three = (F.floor(n_ / 2), F.floor(n_ / 4), F.floor(3 * n_ / 4))
    s = placed.groupBy(*keys).agg(
        F.sum(h).alias("n"),
        F.sum(F.when(i >= 1, h).otherwise(F.lit(0))).alias("nonzero"),
        *[F.sum(h * p).alias(f"s{e}") for e, p in ((1, i), (2, i * i), (3, i * i * i), (4, i * i * i * i))],
        F.min(F.when(h > 0, F.col("bin"))).alias("minimum"), F.max(F.when(h > 0, F.col("bin"))).alias("maximum"),
        *[F.when(F.max(t) == 0, F.lit(0)).otherwise(reach(t)).cast("int").alias(name) for name, t in (("median", half), ("first_quartile", quarter), ("third_quartile", three))],
        F.sum(h * h).alias("_hh"), F.sum(F.when(h > 0, h * F.log2(h)).otherwise(0.0)).alias("_hlogh"),
    )
    n = F.col("n").cast("double")
    m, e2, e3, e4 = (F.col(f"s{e}") / n for e in (1, 2, 3, 4))
    # The variance from integers, so that equal values have exactly none.
    var = (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")) / (n * n)
    m3 = e3 - 3 * m * e2 + 2 * m * m * m
    m4 = e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m
    flat = var == 0
    return s.select(
        *keys, "n", "nonzero", m.alias("mean"), F.sqrt(var).alias("std"),
        "minimum", "maximum", "median", "first_quartile", "third_quartile",
        (F.log2(n) - F.col("_hlogh") / n).alias("entropy"), (F.col("_hh") / (n * n)).alias("energy"),
        F.when(flat, F.lit(0.0)).otherwise(m3 / (var * F.sqrt(var))).alias("skewness"),
        F.when(flat, F.lit(0.0)).otherwise(m4 / (var * var)).alias("kurtosis"),
    )


def with_empty(stats: DataFrame, objects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of what ``statistics`` gives, a row for each of ``objects`` (``keys``): those without any pixel have 0 throughout, but for the minimum, which is
    the number of bins."""
    keys = keys or OBJECT
    whole = objects.select(*keys).distinct().join(stats, keys, "left")
    rest = [c for c in stats.columns if c not in keys]
    return whole.select(*keys, *[F.coalesce(c, F.lit(BINS if c == "minimum" else 0).cast(stats.schema[c].dataType)).alias(c) for c in rest])
