"""Comparisons of images and label images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PIXEL


def label_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(image_id, a, b, pixels): labels that meet, with how many pixels."""
    both = first.select(*PIXEL, F.col("label").alias("a")).join(second.select(*PIXEL, F.col("label").alias("b")), PIXEL)
    return both.groupBy("image_id", "a", "b").agg(F.count(F.lit(1)).alias("pixels"))


def same_up_to_names(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per image: whether each label of either image meets exactly one label of the other; and how many labels each has."""
    pairs = label_pairs(first, second)
    partners = pairs.groupBy("image_id", "a").agg(F.count(F.lit(1)).alias("n")).groupBy("image_id").agg(F.count(F.lit(1)).alias("labels_a"), F.max("n").alias("most_a"))
    others = pairs.groupBy("image_id", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("image_id").agg(F.count(F.lit(1)).alias("labels_b"), F.max("n").alias("most_b"))
    both = partners.join(others, "image_id")
    return both.select("image_id", "labels_a", "labels_b", ((F.col("most_a") == 1) & (F.col("most_b") == 1)).alias("same"))


def pixel_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per image: how many pixels are in both, only in the first, only in the second."""
    both = first.select(*PIXEL, F.lit(1).alias("a")).distinct().join(second.select(*PIXEL, F.lit(1).alias("b")).distinct(), PIXEL, "full")
    count = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0)))
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.groupBy("image_id").agg(count(a & b).alias("common"), count(a & ~b).alias("only_first"), count(~a & b).alias("only_second"))


def mismatches(first: DataFrame, second: DataFrame, column: str = "v") -> DataFrame:
    """Per image: pixels whose values differ."""
    both = first.select(*PIXEL, F.col(column).alias("a")).join(second.select(*PIXEL, F.col(column).alias("b")), PIXEL)
    return both.groupBy("image_id").agg(F.sum(F.when(~F.col("a").eqNullSafe(F.col("b")), F.lit(1)).otherwise(F.lit(0))).alias("mismatches"))


def compact(px: DataFrame, column: str = "v") -> DataFrame:
    """Stream compaction: positive values only."""
    return px.where(F.col(column) > 0)
