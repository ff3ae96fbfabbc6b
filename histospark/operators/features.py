"""Features of objects: shape, intensity, gradient, edges; of nuclei and of the rings around them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import arrays as k
from ..plans.storage import table
from ..plans.tiles import arrays
from ..schema import OBJECT, PIXEL
from .histogram import object_histogram, statistics
from .layout import sizes
from .neighbors import DISK17, gradient
from .watershed import canny

#: Pi as features use it, and half the diagonal of a pixel.
PI, CORNER, DIAGONAL = 3.14159265359, 0.70710678118, 1.41421356237


def perimeter(labels: DataFrame) -> DataFrame:
    """(image_id, label, perimeter): every 2 x 2 quad that an object touches adds by how many of its pixels it has: one or three a corner, two
    beside each other 1, two across a diagonal, four nothing. Each pixel tells its four quads which corner it is."""
    corners = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(bit).alias("bit")) for dy, dx, bit in ((0, 0, 1), (0, -1, 2), (-1, -1, 4), (-1, 0, 8))])
    told = labels.select(*OBJECT, "y", "x", F.explode(corners).alias("c"))
    quads = told.groupBy(*OBJECT, (F.col("y") + F.col("c.dy")).alias("qy"), (F.col("x") + F.col("c.dx")).alias("qx")).agg(F.sum("c.bit").alias("bits"))
    length = F.when(F.col("bits").isin(5, 10), F.lit(DIAGONAL)).when(F.col("bits").isin(3, 6, 9, 12), F.lit(1.0)).when(F.col("bits") == 15, F.lit(0.0)).otherwise(F.lit(CORNER))
    return quads.groupBy(*OBJECT).agg(F.sum(length).alias("perimeter"))


def shape_features(labels: DataFrame) -> DataFrame:
    """Area, box, ellipse axes, eccentricity, extent ratios, perimeter, circularity per object: two aggregations, joined by object.

    extent_ratio divides by (width - 1) * (height - 1) and is infinite for objects one pixel wide; extent_ratio_inclusive divides by the box.
    """
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    sums = labels.groupBy(*OBJECT).agg(
        F.count(F.lit(1)).alias("area"), F.min("x").alias("minx"), F.max("x").alias("maxx"), F.min("y").alias("miny"), F.max("y").alias("maxy"),
        F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    n = F.col("area")
    central = lambda a, b, c: (n * F.col(a) - F.col(b) * F.col(c)) / (n.cast("double") * n)
    s = sums.withColumns({"_xx": central("sxx", "sx", "sx") + 1 / 12, "_yy": central("syy", "sy", "sy") + 1 / 12, "_xy": central("sxy", "sx", "sy")})
    s = s.withColumn("_d", F.sqrt((F.col("_xx") - F.col("_yy")) * (F.col("_xx") - F.col("_yy")) + 4 * F.col("_xy") * F.col("_xy")))
    axis = lambda sign: F.sqrt(F.lit(8.0)) * F.sqrt(F.greatest(F.col("_xx") + F.col("_yy") + sign * F.col("_d"), F.lit(0.0)))
    s = s.withColumns({"major_axis": axis(1), "minor_axis": axis(-1), "_w": F.col("maxx") - F.col("minx"), "_h": F.col("maxy") - F.col("miny")})
    a, b = F.col("major_axis"), F.col("minor_axis")
    outer = F.col("_w") * F.col("_h")
    s = s.withColumns({
        "eccentricity": 2 * F.sqrt(F.greatest((a * a - b * b) / 4, F.lit(0.0))) / a,
        "extent_ratio": F.when(outer == 0, F.lit(float("inf"))).otherwise(F.try_divide(n.cast("double"), outer)),
        "extent_ratio_inclusive": n / ((F.col("_w") + 1) * (F.col("_h") + 1)),
    })
    out = s.join(perimeter(labels), OBJECT)
    round_ = 4 * F.lit(PI) * n / (F.col("perimeter") * F.col("perimeter"))
    return out.select(*OBJECT, "area", "minx", "maxx", "miny", "maxy", "major_axis", "minor_axis", "eccentricity", "extent_ratio", "extent_ratio_inclusive", "perimeter", round_.alias("circularity"))


def _named(stats: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    return stats.select(*OBJECT, *[F.col(n).alias(f"{prefix}{n}") for n in names])


def intensity_features(labels: DataFrame, gray: DataFrame, prefix: str = "") -> DataFrame:
    return _named(statistics(object_histogram(labels, gray)), prefix, ["mean", "maximum", "minimum", "std", "entropy", "energy", "skewness", "kurtosis"])


def gradient_features(labels: DataFrame, gray: DataFrame, prefix: str = "gradient_") -> DataFrame:
    return _named(statistics(object_histogram(labels, gradient(gray))), prefix, ["mean", "std", "entropy", "energy", "skewness", "kurtosis"])


def canny_features(labels: DataFrame, gray: DataFrame, prefix: str = "canny_") -> DataFrame:
    return _named(statistics(object_histogram(labels, canny(gray))), prefix, ["nonzero", "mean"])


def cytoplasm(labels: DataFrame, px: DataFrame) -> DataFrame:
    """(image_id, y, x, label) of each object's ring: what the disk of radius 8 reaches around it within the image, without the object itself. Rings
    may overlap each other and other objects. A task has the box of one object at a time."""
    margin = max(dy for dy, _ in DISK17)

    def ring(t: pa.Table) -> pa.Table:
        y0, x0, present, _ = arrays(t, [])
        wide = np.pad(present, margin)
        y, x = np.nonzero(k.widened(wide, DISK17) & ~wide)
        y, x = y + y0 - margin, x + x0 - margin
        inside = (y >= 0) & (x >= 0) & (y < t.column("h")[0].as_py()) & (x < t.column("w")[0].as_py())
        y, x = y[inside], x[inside]
        own = {c: pa.array(np.full(len(y), t.column(c)[0].as_py()), pa.int64()) for c in OBJECT}
        return pa.table({"image_id": own["image_id"], "y": pa.array(y, pa.int32()), "x": pa.array(x, pa.int32()), "label": own["label"]})

    sized = labels.select(*PIXEL, F.col("label").cast("long").alias("label")).join(sizes(px), "image_id")
    return sized.groupBy(*OBJECT).applyInArrow(ring, "image_id long, y int, x int, label long")


def all_features(labels: DataFrame, gray: DataFrame) -> DataFrame:
    """Every feature set of objects and of their rings in one row per object; null where a ring has no pixel. Slopes and edges of the image are made
    once, and all six histograms are one aggregation."""
    slopes = gradient(gray).select(*PIXEL, F.col("v").alias("gradient"))
    edges = canny(gray).select(*PIXEL, F.col("v").alias("canny"))
    planes = table(gray.select(*PIXEL, F.col("v").alias("intensity")).join(slopes, PIXEL).join(edges, PIXEL), "planes")
    both = labels.select(*PIXEL, "label", F.lit("").alias("part")).unionByName(cytoplasm(labels, gray).withColumn("part", F.lit("cyto_")))
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("int").alias("bin")) for c in ("intensity", "gradient", "canny")])
    counted = both.join(planes, PIXEL).select(*OBJECT, "part", F.explode(kinds).alias("h")).groupBy(*OBJECT, "part", "h.kind", "h.bin").agg(F.count(F.lit(1)).alias("cnt"))
    found = table(statistics(counted, [*OBJECT, "part", "kind"]), "feature-statistics")
    names = {
        "intensity": ["mean", "maximum", "minimum", "std", "entropy", "energy", "skewness", "kurtosis"],
        "gradient": ["mean", "std", "entropy", "energy", "skewness", "kurtosis"], "canny": ["nonzero", "mean"],
    }
    only = lambda part, kind, c: F.max(F.when((F.col("part") == part) & (F.col("kind") == kind), F.col(c)))
    wide = found.groupBy(*OBJECT).agg(*[only(part, kind, c).alias(f"{part}{kind}_{c}") for part in ("", "cyto_") for kind, own in names.items() for c in own])
    return shape_features(labels).join(wide, OBJECT, "left")
