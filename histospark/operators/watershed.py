"""Watersheds: marker flooding of the colour image, drop of water, and cheapest paths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import arrays as k
from ..plans.storage import by_shuffle, table
from ..plans.tiles import arrays, per_image, rows, with_halo
from ..schema import PIXEL
from .geodesic import reconstruct_binary
from .neighbors import clean_outside, cut_borders, repair_ridges

#: Columns of an image for linear indexes, where no image's own number is known.
WIDEST = 1 << 31


def watershed(px: DataFrame, connectivity: int = 8) -> DataFrame:
    """(image_id, y, x, label) from pixels with b, g, r and v (a height, lowest in the basins): the regional minima of v are markers, from which
    the colour image is flooded; -1 are ridges, with diagonal gaps closed. Every basin has one marker."""

    def kernel(_, a):
        minima = k.regional_maxima(-a["v"], connectivity)
        roots = k.label(minima.astype(int), connectivity)
        ranks = np.where(minima, np.unique(roots, return_inverse=True)[1].reshape(roots.shape) + (0 if (roots < 0).any() else 1), 0)
        return {"label": k.flood(np.stack([a["b"], a["g"], a["r"]], 2), ranks)}

    flooded = per_image(px, ["b", "g", "r", "v"], kernel, {"label": "int"})
    return repair_ridges(flooded)


def drop_of_water(px: DataFrame, connectivity: int = 8, inside: DataFrame | None = None) -> DataFrame:
    """Labels by steepest descent on v; what lies at the edge of ``inside`` (v) becomes background, then borders between labels are cut."""
    labels = per_image(px, ["v"], lambda _, a: {"label": k.drop_of_water(a["v"], connectivity)}, {"label": "int"})
    if inside is not None:
        labels = clean_outside(labels, inside, 0, connectivity)
    return cut_borders(labels, 0, connectivity)


def cheapest_paths(px: DataFrame, connectivity: int = 8) -> DataFrame:
    """Labels by relaxation of path costs from the regional minima of v."""
    return per_image(px, ["v"], lambda _, a: {"label": k.cheapest_paths(a["v"], connectivity)}, {"label": "int"})


def canny(px: DataFrame, low: float = 70, high: float = 90, tile: int | None = None) -> DataFrame:
    """Edges (255) of v, else 0. With ``tile``, marks are found tile by tile with a halo of three pixels and weak ones are kept by the labels of their
    components, so that no task has a whole image."""
    if tile is None:
        return per_image(px, ["v"], lambda _, a: {"v": k.canny(a["v"], low, high)}, {"v": "int"}).select(*PIXEL, F.col("v"))

    def marks(t: pa.Table) -> pa.Table:
        y0, x0, present, dense = arrays(t, ["v"])
        weak, strong = k.canny_marks(dense["v"], low, high)
        ty, tx = t.column("ty")[0].as_py(), t.column("tx")[0].as_py()
        y, x = np.mgrid[y0 : y0 + present.shape[0], x0 : x0 + present.shape[1]]
        own = present & (y // tile == ty) & (x // tile == tx)
        return rows(t.column("image_id")[0].as_py(), y0, x0, own, {"marker": strong.astype(int), "mask": weak.astype(int)}, {"marker": pa.int32(), "mask": pa.int32()})

    found = with_halo(px.select(*PIXEL, "v"), tile, 3).groupBy("image_id", "ty", "tx").applyInArrow(marks, "image_id long, y int, x int, marker int, mask int")
    found = by_shuffle(table(found, "canny-marks"))
    edges = reconstruct_binary(found, WIDEST, 8, tile).select(*PIXEL, F.col("v").alias("_on"))
    return found.select(*PIXEL).join(edges, PIXEL, "left").select(*PIXEL, F.coalesce("_on", F.lit(0)).alias("v"))
