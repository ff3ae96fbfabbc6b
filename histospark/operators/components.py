"""Connected components: labels, sizes, boxes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import arrays as k
from ..plans.fixpoint import least_reachable
from ..plans.storage import by_shuffle, table
from ..plans.tiles import TILE, arrays, tiled
from ..schema import OBJECT, PIXEL


def label(px: DataFrame, cols: int, connectivity: int, column: str = "v", tile: int = TILE) -> DataFrame:
    """(image_id, y, x, label): the smallest linear index y * cols + x of each component of adjacent pixels with equal non-zero
    values. Zeros are left out before anything is grouped.

    Tiles are labelled on their own; pixels along seams give the edges between tiles' components, and only those few
    are brought to a fixpoint. What is shuffled besides is one row per pixel.
    """
    own = tiled(px.where(F.col(column) != 0).select(*PIXEL, F.col(column).cast("double").alias("v")), tile)

    def local(t: pa.Table) -> pa.Table:
        y0, x0, present, dense = arrays(t, ["v"])
        roots = k.label(np.where(present, dense["v"], 0), connectivity)
        y, x = np.nonzero(present)
        w = present.shape[1]
        root = roots[y, x]
        linear = (root // w + y0).astype(np.int64) * cols + root % w + x0
        n = len(y)
        return pa.table({"image_id": pa.array(np.full(n, t.column("image_id")[0].as_py()), pa.int64()), "y": pa.array(y + y0, pa.int32()), "x": pa.array(x + x0, pa.int32()), "v": pa.array(dense["v"][y, x]), "label": pa.array(linear, pa.int64())})

    # The smallest local index is not always that of the smallest linear one, but it is within a tile: rows first.
    labelled = by_shuffle(table(own.groupBy("image_id", "ty", "tx").applyInArrow(local, "image_id long, y int, x int, v double, label long"), "tile-labels"))
    on_seam = (F.col("y") % tile == 0) | (F.col("x") % tile == 0) | (F.col("y") % tile == tile - 1) | (F.col("x") % tile == tile - 1)
    seam = labelled.where(on_seam)
    ahead = [o for o in k.near(connectivity) if o > (0, 0)]
    moved = seam.withColumn("o", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ahead])))
    moved = moved.select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "v", F.col("label").alias("a"))
    edges = moved.join(seam.select(*PIXEL, "v", F.col("label").alias("b")), [*PIXEL, "v"]).where("a != b").select("image_id", "a", "b").distinct()
    edges = table(edges, "seams")
    if edges.isEmpty():
        return labelled.select(*PIXEL, "label")
    roots = least_reachable(edges).withColumnRenamed("node", "label")
    return labelled.join(roots, OBJECT, "left").select(*PIXEL, F.coalesce("root", "label").alias("label"))


def relabel(labels: DataFrame) -> DataFrame:
    """Labels 1..n of each image, in the order of the labels, which is raster order of their first pixels. Ranks are taken over objects,
    not pixels."""
    objects = labels.select(*OBJECT).distinct()
    ranked = objects.withColumn("_rank", F.row_number().over(Window.partitionBy("image_id").orderBy("label")).cast("long"))
    return labels.join(ranked, OBJECT).select(*PIXEL, F.col("_rank").alias("label"))


def area(labels: DataFrame) -> DataFrame:
    """(image_id, label, area) in pixels."""
    return labels.groupBy(*OBJECT).agg(F.count(F.lit(1)).alias("area"))


def area_filter(labels: DataFrame, lower: int, upper: int | None = None) -> DataFrame:
    """Pixels of objects with lower <= area < upper."""
    fits = F.col("area") >= lower
    return labels.join(by_shuffle(area(labels).where(fits & (F.col("area") < upper) if upper is not None else fits)), OBJECT, "left_semi")


def area_threshold(px: DataFrame, cols: int, lower: int, upper: int | None, connectivity: int, tile: int = TILE) -> DataFrame:
    """Label, then filter by area. Labels are a table, as both sides of the filter read them."""
    return area_filter(table(label(px, cols, connectivity, tile=tile), "labels"), lower, upper)


def area_open(px: DataFrame, cols: int, lower: int, upper: int | None, connectivity: int, labeled: bool = False, tile: int = TILE) -> DataFrame:
    """The foreground of objects with lower <= area < upper: as labels, or flat as 255."""
    kept = area_threshold(px, cols, lower, upper, connectivity, tile)
    return kept if labeled else kept.select(*PIXEL, F.lit(255).alias("v"))


def bounding_boxes(labels: DataFrame) -> DataFrame:
    """Inclusive boxes."""
    return labels.groupBy(*OBJECT).agg(F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"))


def objects(labels: DataFrame) -> DataFrame:
    """(image_id, label, area, minx, maxx, miny, maxy): areas and boxes in one aggregation."""
    return labels.groupBy(*OBJECT).agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy")
    )


def renumbered(found: DataFrame) -> DataFrame:
    """Objects with labels 1..n per image, in the order of their labels."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy("label")).cast("long")
    return found.withColumn("label", rank)


def label_filtered(px: DataFrame, cols: int, connectivity: int, keep: Callable[[DataFrame], DataFrame] | Column, binary: bool = False, tile: int = TILE) -> DataFrame:
    """Labels of the objects that a predicate keeps: a column over (area, minx, maxx, miny, maxy), or a function from that table of
    objects to the objects to keep."""
    labels = by_shuffle(table(label(px, cols, connectivity, tile=tile), "labels"))
    kept = keep(objects(labels)) if callable(keep) else objects(labels).where(keep)
    out = labels.join(kept.select(*OBJECT), OBJECT, "left_semi")
    return out.select(*PIXEL, F.lit(255).alias("v")) if binary else out


def contours(labels: DataFrame) -> DataFrame:
    """(image_id, label, area, filled, polygon, points, net) of objects that are single components: pixels; pixels with those of holes; the area
    within the closed line through the centres of the outer boundary's pixels and the number of its points; and that area, rounded, with half
    of the points and one, less the same of each hole. A task has the box of one object at a time."""

    def measured(t: pa.Table) -> pa.Table:
        _, _, present, _ = arrays(t, [])
        values = k.contour_measures(present)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        own = {c: pa.array([t.column(c)[0].as_py()], pa.int64()) for c in OBJECT}
        return pa.table(own | {c: pa.array([v], kind) for c, v, kind in zip(("area", "filled", "polygon", "points", "net"), values, kinds, strict=True)})

    rows = labels.select(*PIXEL, F.col("label").cast("long").alias("label"))
    return rows.groupBy(*OBJECT).applyInArrow(measured, "image_id long, label long, area long, filled long, polygon double, points long, net long")


def contour_area(labels: DataFrame) -> DataFrame:
    """(image_id, label, area) within the outer contour: rows of the filled object, end to end."""
    return contours(labels).select(*OBJECT, F.col("filled").alias("area"))


def contour_area_filter(labels: DataFrame, lower: int, upper: int, measure: str = "net") -> DataFrame:
    """Pixels of objects with lower <= measure < upper, of what ``contours`` has: net or filled."""
    kept = contours(labels).where((F.col(measure) >= lower) & (F.col(measure) < upper))
    return labels.join(kept.select(*OBJECT), OBJECT, "left_semi")


def label_contours(px: DataFrame, cols: int, connectivity: int, tile: int = TILE) -> DataFrame:
    """Labels 1..n of the outer contours, each filled: what lies in an object's holes has its label, islands in them included."""
    own = relabel(label(px, cols, connectivity, tile=tile))

    def filled(t: pa.Table) -> pa.Table:
        y0, x0, present, _ = arrays(t, [])
        inside = k.outer_filled(present)
        label_ = t.column("label")[0].as_py()
        n = int(inside.sum())
        y, x = np.nonzero(inside)
        first = pa.array(np.full(n, t.column("image_id")[0].as_py()), pa.int64())
        return pa.table({"image_id": first, "y": pa.array(y + y0, pa.int32()), "x": pa.array(x + x0, pa.int32()), "label": pa.array(np.full(n, label_), pa.int64()), "size": pa.array(np.full(n, n), pa.int64())})

    every = own.groupBy(*OBJECT).applyInArrow(filled, "image_id long, y int, x int, label long, size long")
    # A place within several contours has the label of the outermost, which is the largest.
    outer = every.groupBy(*PIXEL).agg(F.max(F.struct("size", F.col("label").alias("outer"))).alias("o")).select(*PIXEL, F.col("o.outer").alias("label"))
    dense = Window.partitionBy("image_id").orderBy("label")
    ranks = outer.select(*OBJECT).distinct().withColumn("_rank", F.row_number().over(dense).cast("long"))
    return outer.join(ranks, OBJECT).select(*PIXEL, F.col("_rank").alias("label"))
