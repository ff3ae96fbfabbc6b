"""Operators that place pixels: borders, crops, channels, repetition, label normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import PIXEL


def sizes(px: DataFrame) -> DataFrame:
    """(image_id, h, w) of images whose pixels start at 0."""
    return px.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def make_border(px: DataFrame, top: int, bottom: int, left: int, right: int, value, column: str = "v") -> DataFrame:
    """The image moved by (top, left) within a frame of ``value``. Only frame pixels are made anew."""
    moved = px.select("image_id", (F.col("y") + top).alias("y"), (F.col("x") + left).alias("x"), column)
    size = sizes(px)
    rows = size.select("image_id", "h", "w", F.explode(F.sequence(F.lit(0), F.col("h") + top + bottom - 1)).alias("y"))
    inner = (F.col("y") >= top) & (F.col("y") < F.col("h") + top)
    span = lambda a, n: F.when(F.lit(n) > 0, F.sequence(a, a + F.lit(n - 1))).otherwise(F.array().cast("array<int>"))
    sides = F.concat(span(F.lit(0), left), span(F.col("w") + left, right))
    whole = F.sequence(F.lit(0), F.col("w") + left + right - 1)
    frame = rows.select("image_id", "y", F.explode(F.when(inner, sides).otherwise(whole)).alias("x"), F.lit(value).alias(column))
    return moved.unionByName(frame)


def crop(px: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    """A rectangle, its corner at 0."""
    inside = px.where(F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1))
    return inside.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def remove_border(px: DataFrame, width: int) -> DataFrame:
    """The image without its outermost rows and columns, its new corner at 0."""
    inner = px.join(sizes(px), "image_id").where((F.col("y") >= width) & (F.col("x") >= width) & (F.col("y") < F.col("h") - width) & (F.col("x") < F.col("w") - width))
    return inner.withColumns({"y": F.col("y") - width, "x": F.col("x") - width}).drop("h", "w")


def split_channels(px: DataFrame) -> dict[str, DataFrame]:
    """The planes of a colour image."""
    return {c: px.select(*PIXEL, F.col(c).alias("v")) for c in ("b", "g", "r")}


def repeat(px: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """The image k times downwards and to the right."""
    times = F.sequence(F.lit(0), F.lit(k - 1))
    down = px.withColumn("_i", F.explode(times)).withColumn("_j", F.explode(times))
    return down.withColumns({"y": F.col("y") + F.col("_i") * height, "x": F.col("x") + F.col("_j") * width}).drop("_i", "_j")


def normalize_labels(labels: DataFrame) -> DataFrame:
    """Labels as gray values: the k-th label in order of first appearance becomes k * max(1, 255 div number of labels)."""
    first = labels.groupBy("image_id", "label").agg(F.min(F.struct("y", "x")).alias("_first"))
    ranked = first.withColumns(
        {"_k": F.row_number().over(Window.partitionBy("image_id").orderBy("_first")) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("image_id"))}
    )
    gray = ranked.select("image_id", "label", (F.col("_k") * F.greatest(F.lit(1), F.floor(F.lit(255) / F.col("_n")))).cast("int").alias("v"))
    return labels.join(gray, ["image_id", "label"]).select(*PIXEL, "v")
