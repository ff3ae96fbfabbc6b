"""Reconstruction and what follows from it: hole filling, selection, extended minima, regional extrema, distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import arrays as k
from ..plans.storage import by_shuffle, discard, table
from ..plans.tiles import TILE, arrays, per_image, rows, tiled
from ..schema import OBJECT, PIXEL
from .components import label

BLOB = "image_id long, ty int, tx int, y0 int, x0 int, h int, w int, present binary, marker binary, mask binary, changed boolean"


def _blob(t: pa.Table) -> dict:
    row = {c: t.column(c)[0].as_py() for c in t.column_names}
    shape = (row["h"], row["w"])
    return row | {c: np.frombuffer(row[c], d).reshape(shape).copy() for c, d in (("present", bool), ("marker", float), ("mask", float))}


def _as_table(row: dict) -> pa.Table:
    kinds = {"image_id": pa.int64(), "ty": pa.int32(), "tx": pa.int32(), "y0": pa.int32(), "x0": pa.int32(), "h": pa.int32(), "w": pa.int32(), "present": pa.binary(), "marker": pa.binary(), "mask": pa.binary(), "changed": pa.bool_()}
    return pa.table({c: pa.array([row[c].tobytes() if isinstance(row[c], np.ndarray) else row[c]], t) for c, t in kinds.items()})


TILE_KEY = ["image_id", "ty", "tx"]
#: After so many rounds the versions of all tiles are written into one table.
COMPACT = 16


def _by_rounds(tiles: DataFrame, seams, go_on) -> DataFrame:
    """Tiles (BLOB) after rounds of ``go_on`` for those that ``seams`` of the tiles changed before address, until none changes."""
    versions = [tiles.withColumn("round", F.lit(0))]
    latest, fresh, number = table(versions[0].select(*TILE_KEY, "round"), "tile-versions"), tiles, 0
    while True:
        number += 1
        halos = table(seams(fresh), "halos")
        wanted = halos.select(*TILE_KEY).distinct().join(latest, TILE_KEY)
        active = _latest(versions, wanted).drop("round")
        after = active.groupBy(*TILE_KEY).cogroup(halos.groupBy(*TILE_KEY)).applyInArrow(go_on, BLOB).where("changed")
        fresh = table(after, "tiles")
        discard(halos)
        if fresh.isEmpty():
            return _latest(versions, latest).drop("round")
        before = latest
        moved = fresh.select(*TILE_KEY, F.lit(number).alias("_new"))
        latest = table(latest.join(moved, TILE_KEY, "left").select(*TILE_KEY, F.coalesce("_new", "round").alias("round")), "tile-versions")
        discard(before)
        versions.append(fresh.withColumn("round", F.lit(number)))
        if len(versions) > COMPACT:
            versions = [table(_latest(versions, latest), "tiles")]


def _latest(versions: list[DataFrame], keys: DataFrame) -> DataFrame:
    """The rows of all versions with a key and round of ``keys``."""
    every = versions[0]
    for more in versions[1:]:
        every = every.unionByName(more)
    return every.join(keys, [*TILE_KEY, "round"], "left_semi")


def reconstruct(px: DataFrame, connectivity: int, tile: int = TILE) -> DataFrame:
    """(image_id, y, x, v) from pixels with marker and mask: the fixpoint of ``min(dilate(marker), mask)``.

    Each tile is brought to its own fixpoint; then tiles that changed send their outermost pixels to their neighbours, which go on
    from there, until no tile changes. A round shuffles seams and the tiles that are sent some, and writes only tiles that changed; a small table
    tells each tile's latest version.
    """

    def start(t: pa.Table) -> pa.Table:
        y0, x0, present, dense = arrays(t, ["marker", "mask"], -np.inf)
        v = k.reconstruct(dense["marker"], dense["mask"], connectivity)
        head = {c: t.column(c)[0].as_py() for c in ("image_id", "ty", "tx")}
        return _as_table(head | {"y0": y0, "x0": x0, "h": v.shape[0], "w": v.shape[1], "present": present, "marker": v, "mask": dense["mask"], "changed": True})

    own = tiled(px.select(*PIXEL, F.col("marker").cast("double").alias("marker"), F.col("mask").cast("double").alias("mask")), tile)
    tiles = table(own.groupBy("image_id", "ty", "tx").applyInArrow(start, BLOB), "tiles")

    def seams(batches):
        """Outermost pixels of changed tiles, addressed to the tiles that they touch."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = _blob(pa.Table.from_batches([batch.slice(i, 1)]))
                ys, xs = np.nonzero(row["present"])
                ys, xs, v = ys + row["y0"], xs + row["x0"], row["marker"][ys, xs]
                for dy, dx in k.near(8):
                    inside = np.ones(len(ys), bool)
                    for d, at, t in ((dy, ys, row["ty"]), (dx, xs, row["tx"])):
                        if d:
                            inside &= at == (t * tile if d < 0 else t * tile + tile - 1)
                    if inside.any():
                        n = int(inside.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["image_id"]] * n, pa.int64()), pa.array([row["ty"] + dy] * n, pa.int32()), pa.array([row["tx"] + dx] * n, pa.int32()), pa.array(ys[inside], pa.int32()), pa.array(xs[inside], pa.int32()), pa.array(v[inside], pa.float64())],
                            ["image_id", "ty", "tx", "y", "x", "v"],
                        )

    def go_on(own: pa.Table, halo: pa.Table) -> pa.Table:
        if not own.num_rows:
            return own
        row = _blob(own)
        if not halo.num_rows:
            return _as_table(row | {"changed": False})
        wide = {c: np.pad(row[c], 1, constant_values=-np.inf) for c in ("marker", "mask")}
        y, x = halo.column("y").to_numpy() - row["y0"] + 1, halo.column("x").to_numpy() - row["x0"] + 1
        ok = (y >= 0) & (y < row["h"] + 2) & (x >= 0) & (x < row["w"] + 2)
        for a in wide.values():
            a[y[ok], x[ok]] = halo.column("v").to_numpy()[ok]
        v = k.reconstruct(wide["marker"], wide["mask"], connectivity)[1:-1, 1:-1]
        return _as_table(row | {"marker": v, "changed": bool((v != row["marker"]).any())})

    several = tiles.groupBy("image_id").count().where("count > 1")
    if not several.isEmpty():
        tiles = _by_rounds(tiles, lambda t: t.mapInArrow(seams, "image_id long, ty int, tx int, y int, x int, v double"), go_on)

    def pixels(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = _blob(pa.Table.from_batches([batch.slice(i, 1)]))
                y, x = np.nonzero(row["present"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), row["image_id"]), pa.int64()), pa.array(y + row["y0"], pa.int32()), pa.array(x + row["x0"], pa.int32()), pa.array(row["marker"][y, x])], [*PIXEL, "v"])

    return tiles.mapInArrow(pixels, "image_id long, y int, x int, v double")


def reconstruct_binary(px: DataFrame, cols: int, connectivity: int, tile: int = TILE) -> DataFrame:
    """Foreground (image_id, y, x, v = 255) of the mask's components that the marker touches, and of the marker where it lies outside the mask.
    No iteration beyond labelling."""
    mask = px.where("mask != 0").select(*PIXEL, F.lit(1).alias("v"))
    labels = label(mask, cols, connectivity, tile=tile)
    seeds = by_shuffle(px.where("marker != 0").select(*PIXEL))
    touched = by_shuffle(labels.join(seeds, PIXEL, "left_semi").select(*OBJECT).distinct())
    outside = px.where("marker != 0 AND mask = 0").select(*PIXEL)
    return labels.join(touched, OBJECT, "left_semi").select(*PIXEL).unionByName(outside).select(*PIXEL, F.lit(255).alias("v"))


def select(px: DataFrame, seeds: DataFrame, cols: int, connectivity: int, tile: int = TILE) -> DataFrame:
    """Foreground pixels of the components of ``px`` (v != 0) that contain a seed."""
    labels = by_shuffle(table(label(px.where("v != 0").select(*PIXEL, F.lit(1).alias("v")), cols, connectivity, tile=tile), "labels"))
    touched = labels.join(seeds.select(*PIXEL), PIXEL, "left_semi").select(*OBJECT).distinct()
    return labels.join(touched, OBJECT, "left_semi").select(*PIXEL)


def fill_from_seeds(px: DataFrame, seeds: DataFrame, cols: int, connectivity: int, tile: int = TILE) -> DataFrame:
    """A binary image (v 0 or 255) with the background components of the seeds filled."""
    background = px.where("v = 0").select(*PIXEL, F.lit(1).alias("v"))
    flooded = select(background, seeds, cols, connectivity, tile).withColumn("_in", F.lit(True))
    return px.join(by_shuffle(flooded), PIXEL, "left").select(*PIXEL, F.when(F.col("_in"), F.lit(255)).otherwise(F.col("v")).alias("v"))


def _edge(px: DataFrame) -> DataFrame:
    """``px`` with _edge: whether a pixel is on the border of its image."""
    box = px.groupBy("image_id").agg(F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    out = px.join(box, "image_id")
    on = (F.col("y") == F.col("_y0")) | (F.col("y") == F.col("_y1")) | (F.col("x") == F.col("_x0")) | (F.col("x") == F.col("_x1"))
    return out.withColumn("_edge", on).drop("_y0", "_y1", "_x0", "_x1")


def fill_holes(px: DataFrame, cols: int, connectivity: int, tile: int = TILE) -> DataFrame:
    """A binary image with the background components that don't reach the border filled. ``connectivity`` is that of the background."""
    background = px.where("v = 0").select(*PIXEL, F.lit(1).alias("v"))
    labels = by_shuffle(table(label(background, cols, connectivity, tile=tile), "background"))
    open_ = labels.join(_edge(px.select(*PIXEL)).where("_edge").select(*PIXEL), PIXEL, "left_semi").select(*OBJECT).distinct()
    holes = labels.join(open_, OBJECT, "left_anti").select(*PIXEL, F.lit(True).alias("_in"))
    return px.join(by_shuffle(holes), PIXEL, "left").select(*PIXEL, F.when(F.col("_in"), F.lit(255)).otherwise(F.col("v")).alias("v"))


def fill_holes_gray(px: DataFrame, connectivity: int, tile: int = TILE) -> DataFrame:
    """Grey holes filled: the complement is reconstructed from its border."""
    v = 255 - F.col("v")
    pairs = _edge(px).select(*PIXEL, F.when(F.col("_edge"), v).otherwise(F.lit(0)).alias("marker"), v.alias("mask"))
    return reconstruct(pairs, connectivity, tile).select(*PIXEL, (255 - F.col("v")).cast("int").alias("v"))


def h_minima(px: DataFrame, h: float, connectivity: int, eight_bit: bool = True, tile: int = TILE) -> DataFrame:
    """Minima shallower than h filled: the negative reconstructed from itself less h. 8-bit values saturate, floating ones don't."""
    v = 255 - F.col("v") if eight_bit else -F.col("v")
    marker = F.greatest(v - h, F.lit(0)) if eight_bit else v - h
    out = reconstruct(px.select(*PIXEL, marker.alias("marker"), v.alias("mask")), connectivity, tile)
    return out.select(*PIXEL, (255 - F.col("v")).cast("int").alias("v") if eight_bit else (-F.col("v")).alias("v"))


def regional_maxima(px: DataFrame, cols: int, connectivity: int, tile: int = TILE) -> DataFrame:
    """(image_id, y, x, v): 255 on flat zones without a higher neighbour, else 0. Zones are labels of equal values, shifted off zero."""
    zones = by_shuffle(table(label(px.select(*PIXEL, (F.col("v") + 1).alias("v")), cols, connectivity, tile=tile), "zones"))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in k.near(connectivity)])
    around = px.select(*PIXEL, "v", F.explode(steps).alias("o"))
    higher = around.groupBy("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).agg(F.max("v").alias("_top"))
    low = px.join(by_shuffle(higher), PIXEL).where("_top > v").select(*PIXEL)
    not_top = zones.join(low, PIXEL, "left_semi").select(*OBJECT).distinct().withColumn("_low", F.lit(True))
    return zones.join(not_top, OBJECT, "left").select(*PIXEL, F.when(F.col("_low"), F.lit(0)).otherwise(F.lit(255)).alias("v"))


def regional_minima(px: DataFrame, cols: int, connectivity: int, tile: int = TILE) -> DataFrame:
    """Regional maxima of the inverse of 8-bit values."""
    return regional_maxima(px.select(*PIXEL, (255 - F.col("v")).alias("v")), cols, connectivity, tile)


def reconstruct_by_levels(px: DataFrame, connectivity: int) -> DataFrame:
    """The reconstruction of 8-bit values level by level from the highest down, on each image as a whole."""
    return per_image(px, ["marker", "mask"], lambda _, a: {"v": k.downhill(a["marker"], a["mask"], connectivity)}, {"v": "double"})


def distance(px: DataFrame, strip: int = TILE) -> DataFrame:
    """Exact Euclidean distance of each pixel to the nearest zero (v); -1 in images without one.

    In two passes: along the columns in strips of ``strip`` columns, then along the rows in strips of as many rows. So a task has a strip of an
    image, not an image; pixels are shuffled twice.
    """

    def down(t: pa.Table) -> pa.Table:
        y0, x0, present, dense = arrays(t, ["v"])
        d = k.column_distance(np.minimum(dense["v"], 1))
        return rows(t.column("image_id")[0].as_py(), y0, x0, present, {"d": d}, {"d": pa.int64()})

    def across(t: pa.Table) -> pa.Table:
        y0, x0, present, dense = arrays(t, ["d"])
        square = k.nearest_in_rows(dense["d"])
        v = np.where(square < 0, -1.0, np.sqrt(square.clip(0)))
        return rows(t.column("image_id")[0].as_py(), y0, x0, present, {"v": v}, {"v": pa.float64()})

    by_column = px.select(*PIXEL, F.col("v").cast("double").alias("v")).groupBy("image_id", F.floor(F.col("x") / strip).alias("tx")).applyInArrow(down, "image_id long, y int, x int, d long")
    return by_column.groupBy("image_id", F.floor(F.col("y") / strip).alias("ty")).applyInArrow(across, "image_id long, y int, x int, v double")


def wavefront_distance(px: DataFrame) -> DataFrame:
    """Approximate distance by the eight-neighbour wavefront."""
    return per_image(px, ["v"], lambda _, a: {"v": k.wavefront_distance(a["v"])}, {"v": "double"})
