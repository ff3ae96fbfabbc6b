"""Segmentation of nuclei in colour tiles of tissue."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as s
from ..functions import pixels as p
from ..operators import components as c
from ..operators import geodesic as g
from ..operators.neighbors import CROSS, DISK19, dilate, opening
from ..operators.watershed import watershed
from ..schema import PIXEL
from .storage import table
from .tiles import TILE


@dataclass(frozen=True)
class Thresholds:
    """The defaults of the pipeline."""

    red_green_strong: float = 5
    red_green_weak: float = 4
    red_blue: float = 1
    background: int = 220
    background_ratio: float = 0.99
    background_likely: float = 0.9
    candidate: int = 80
    support: int = 45
    candidate_area: tuple[int, int] = (11, 1000)
    separate_area: int = 30
    final_area: tuple[int, int] = (21, 1000)
    h: float = 1.0


Stage = Callable[[str, DataFrame], None]


def red_cells(px: DataFrame, cols: int, t: Thresholds = Thresholds(), tile: int = TILE) -> DataFrame:
    """(image_id, y, x) of red blood cells: pixels much redder than green, grown into what is redder than green, and redder than blue."""
    ratio = lambda c: F.col("r").cast("double") / (F.col(c) + p.FLOAT_EPSILON)
    own = px.select(*PIXEL, ratio("g").alias("rg"), ratio("b").alias("rb"))
    seeds = own.where(F.col("rg") > t.red_green_strong)
    weak = own.where(F.col("rg") > t.red_green_weak).select(*PIXEL, F.lit(255).alias("v"))
    grown = g.select(weak, seeds, cols, 8, tile)
    return grown.join(own.where(F.col("rb") > t.red_blue).select(*PIXEL), PIXEL, "left_semi")


def background_status(px: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(image_id, ratio, status): images that are background for the most part need no segmentation."""
    white = F.when(p.is_background(F.col("b"), F.col("g"), F.col("r"), t.background), F.lit(1)).otherwise(F.lit(0))
    ratio = px.groupBy("image_id").agg((F.sum(white) / F.count(F.lit(1))).alias("ratio"))
    code = F.when(F.col("ratio") >= t.background_ratio, s.BACKGROUND).when(F.col("ratio") >= t.background_likely, s.BACKGROUND_LIKELY).otherwise(s.CONTINUE)
    return ratio.select("image_id", "ratio", code.alias("status"))


def _dense(px: DataFrame, foreground: DataFrame) -> DataFrame:
    """A whole image, 255 on the foreground, else 0."""
    on = foreground.select(*PIXEL).distinct().withColumn("_on", F.lit(255))
    return px.select(*PIXEL).join(on, PIXEL, "left").select(*PIXEL, F.coalesce("_on", F.lit(0)).alias("v"))


def candidates(px: DataFrame, cols: int, t: Thresholds = Thresholds(), tile: int = TILE, on_stage: Stage = lambda *_: None) -> DataFrame:
    """A binary image (v 0 or 255) of nucleus candidates."""
    rbc = table(red_cells(px, cols, t, tile), "rbc")
    on_stage("rbc", rbc)
    rc = table(px.select(*PIXEL, p.invert(F.col("r")).alias("v")), "rc")
    opened = opening(rc, DISK19).select(*PIXEL, F.col("v").alias("marker"))
    on_stage("opened", opened)
    recon = g.reconstruct(opened.join(rc.select(*PIXEL, F.col("v").alias("mask")), PIXEL), 8, tile).select(*PIXEL, F.col("v").cast("int").alias("_r"))
    diff = table(rc.join(recon, PIXEL).select(*PIXEL, p.saturating_subtract(F.col("v"), F.col("_r")).alias("v")), "diff")
    on_stage("difference", diff)
    strong = g.fill_holes(diff.select(*PIXEL, p.above(F.col("v"), t.candidate).alias("v")), cols, 4, tile)
    big = c.area_threshold(strong.where("v > 0"), cols, *t.candidate_area, 8, tile)
    on_stage("large", big)
    support = diff.where(F.col("v") > t.support).select(*PIXEL, F.lit(255).alias("v"))
    grown = g.select(support, big, cols, 8, tile)
    return g.fill_holes(_dense(px, grown.join(rbc, PIXEL, "left_anti")), cols, 4, tile)


def separate(px: DataFrame, found: DataFrame, cols: int, t: Thresholds = Thresholds(), tile: int = TILE, on_stage: Stage = lambda *_: None) -> DataFrame:
    """Foreground (image_id, y, x) of single nuclei: candidates cut along watershed ridges."""
    solid = c.area_threshold(opening(found, CROSS).where("v > 0"), cols, t.separate_area, None, 8, tile)
    big = table(dilate(_dense(px, solid), CROSS), "big")
    on_stage("solid", big)
    far = g.distance(big)
    relief = far.select(*PIXEL, F.when(F.col("v") == 0, F.lit(-1e30)).otherwise(-F.col("v")).alias("v"))
    smooth = g.h_minima(relief, t.h, 8, eight_bit=False, tile=tile)
    on_stage("relief", smooth)
    colours = px.join(big.select(*PIXEL, F.col("v").alias("_in")), PIXEL).select(*PIXEL, *[F.when(F.col("_in") > 0, F.col(k)).otherwise(F.lit(0)).alias(k) for k in "bgr"])
    basins = watershed(colours.join(smooth, PIXEL), 8)
    on_stage("basins", basins)
    inside = big.where("v > 0").select(*PIXEL)
    return basins.where("label >= 0").join(inside, PIXEL, "left_semi").select(*PIXEL)


def segment_nuclei(px: DataFrame, cols: int, t: Thresholds = Thresholds(), tile: int = TILE, on_stage: Stage = lambda *_: None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels (1..n per image), boxes, and status of each image (image_id, b, g, r by pixel). Images that are background are dropped before anything
    dear; those without objects get status 3. ``on_stage`` is called with the name and table of each intermediate result."""
    px = table(px.select(*PIXEL, "b", "g", "r"), "pixels")
    state = table(background_status(px, t), "status")
    go = px.join(state.where(F.col("status") == s.CONTINUE).select("image_id"), "image_id", "left_semi")
    found = table(candidates(go, cols, t, tile, on_stage), "candidates")
    on_stage("candidates", found)
    single = separate(go, found, cols, t, tile, on_stage)
    kept = c.area_threshold(single.select(*PIXEL, F.lit(255).alias("v")), cols, *t.final_area, 4, tile)
    filled = g.fill_holes(_dense(go, kept), cols, 8, tile)
    labels = table(c.relabel(c.label(filled.where("v > 0"), cols, 8, tile=tile)), "nuclei")
    on_stage("labels", labels)
    some = labels.select("image_id").distinct().withColumn("_some", F.lit(True))
    done = F.when(F.col("status") != s.CONTINUE, F.col("status")).when(F.col("_some"), s.SUCCESS).otherwise(s.NO_CANDIDATES_LEFT)
    status = state.join(some, "image_id", "left").select("image_id", done.alias("status"))
    return labels, c.bounding_boxes(labels), status


def segment_files(spark: SparkSession, path: str, out: str, t: Thresholds = Thresholds(), tile: int = TILE) -> DataFrame:
    """Segment the image files below ``path``; labels and boxes of those that succeed are written below ``out``. (image_id, path, status) of every file; files
    that are no image have status -1."""
    from ..sources.images import read_images, read_status

    files = table(read_status(spark, path), "files")
    px = table(read_images(spark, path), "image-pixels")
    cols = px.agg(F.max("x")).first()[0]
    if cols is None:
        return files
    labels, boxes, status = segment_nuclei(px, cols + 1, t, tile)
    labels.write.mode("overwrite").parquet(f"{out}/labels")
    boxes.write.mode("overwrite").parquet(f"{out}/boxes")
    done = status.withColumnRenamed("status", "_done")
    return files.join(done, "image_id", "left").select("image_id", "path", F.coalesce("_done", "status").alias("status"))
