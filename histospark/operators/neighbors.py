"""Neighbourhood operators: structuring elements as offsets, windows along rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pixels import clamp_round
from ..schema import PIXEL

Offsets = list[tuple[int, int]]

CROSS: Offsets = [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
SQUARE: Offsets = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
#: The structuring elements of the pipeline. Ones of the 17 x 17 disk of radius 8.
DISK17: Offsets = [(dy, dx) for dy in range(-8, 9) for dx in range(-8, 9) if dy * dy + dx * dx <= 64]
#: Ones of the 19 x 19 octagon: each of the four outer rows is shorter by one at both ends than the next one.
DISK19: Offsets = [(i - 9, j - 9) for i in range(19) for j in range(19) if max(0, 4 - min(i, 18 - i)) <= j < 19 - max(0, 4 - min(i, 18 - i))]


def neighbourhood(connectivity: int) -> Offsets:
    """The 4 or 8 neighbours."""
    if connectivity not in (4, 8):
        raise ValueError(f"connectivity is 4 or 8, not {connectivity}")
    return [o for o in (CROSS if connectivity == 4 else SQUARE) if o != (0, 0)]


def _morph(px: DataFrame, offsets: Offsets, column: str, smallest: bool) -> DataFrame:
    """Minimum or maximum under the element: for each of its rows a sliding window along x, then the rows meet by an equi-join
    on y. A row of the element is a run, so the number of rows, not of pixels, multiplies the data."""
    rows: dict[int, list[int]] = {}
    for dy, dx in offsets:
        rows.setdefault(dy, []).append(dx)
    fold, out = (F.min, F.min) if smallest else (F.max, F.max)
    runs = {dy: (min(xs), max(xs)) for dy, xs in rows.items()}
    if any(b - a + 1 != len(rows[dy]) for dy, (a, b) in runs.items()):
        raise ValueError("each row of a structuring element is one run")
    along = Window.partitionBy("image_id", "y").orderBy("x")
    widths = sorted(set(runs.values()))
    slid = px.select(*PIXEL, *[fold(column).over(along.rangeBetween(a, b)).alias(f"_w{i}") for i, (a, b) in enumerate(widths)])
    # A run that reaches no pixel of its row gives null, which folds ignore.
    parts = F.array(*[F.struct((F.col("y") - dy).alias("y"), F.col(f"_w{widths.index(run)}").alias(column)) for dy, run in runs.items()])
    folded = slid.select("image_id", "x", F.explode(parts).alias("_p")).groupBy("image_id", F.col("_p.y").alias("y"), "x").agg(out(f"_p.{column}").alias(column))
    return folded.join(px.select(*PIXEL), PIXEL, "left_semi").select(*PIXEL, column)


def erode(px: DataFrame, offsets: Offsets = SQUARE, column: str = "v") -> DataFrame:
    """Minimum under the element; what is outside the image doesn't count. Images are whole rectangles, or else a run may only
    reach pixels that exist above or below."""
    return _morph(px, offsets, column, True)


def dilate(px: DataFrame, offsets: Offsets = SQUARE, column: str = "v") -> DataFrame:
    """Maximum under the element; what is outside the image doesn't count."""
    return _morph(px, offsets, column, False)


def opening(px: DataFrame, offsets: Offsets = SQUARE, column: str = "v") -> DataFrame:
    """Erosion, then dilation."""
    return dilate(erode(px, offsets, column), offsets, column)


def _row() -> Window:
    return Window.partitionBy("image_id", "y").orderBy("x")


def _col() -> Window:
    return Window.partitionBy("image_id", "x").orderBy("y")


def repair_ridges(px: DataFrame, background: int = -1, column: str = "label") -> DataFrame:
    """Close diagonal gaps of watershed lines: a pixel below a background pixel becomes background if beside it is background
    where above that is none. Rows from 1, without the first and last column; others stay as they are."""
    v, bg = F.col(column), F.lit(background)
    near = px.withColumns({"_w": F.lag(column).over(_row()), "_e": F.lead(column).over(_row()), "_n": F.lag(column).over(_col())})
    near = near.withColumns({"_nw": F.lag("_n").over(_row()), "_ne": F.lead("_n").over(_row())})
    gap = (F.col("_n") == bg) & (v != bg) & (((F.col("_nw") != bg) & (F.col("_w") == bg)) | ((F.col("_ne") != bg) & (F.col("_e") == bg)))
    inner = F.col("_w").isNotNull() & F.col("_e").isNotNull()
    return near.select(*PIXEL, F.when(inner & F.coalesce(gap, F.lit(False)), bg.cast("int")).otherwise(v).alias(column))


def cut_borders(px: DataFrame, background: int = 0, connectivity: int = 4, column: str = "label") -> DataFrame:
    """A pixel becomes background if the one above or to the left (8: or diagonally above) has another label that isn't
    background. The outermost pixels stay."""
    v, bg = F.col(column), F.lit(background)
    near = px.withColumns({"_w": F.lag(column).over(_row()), "_e": F.lead(column).over(_row()), "_n": F.lag(column).over(_col()), "_s": F.lead(column).over(_col())})
    other = lambda c: (F.col(c) != bg) & (F.col(c) != v)
    cut = other("_n") | other("_w")
    if connectivity == 8:
        near = near.withColumns({"_nw": F.lag("_n").over(_row()), "_ne": F.lead("_n").over(_row())})
        cut = cut | other("_nw") | other("_ne")
    inner = F.col("_w").isNotNull() & F.col("_e").isNotNull() & F.col("_n").isNotNull() & F.col("_s").isNotNull()
    return near.select(*PIXEL, F.when(inner & F.coalesce(cut, F.lit(False)), bg.cast("int")).otherwise(v).alias(column))


def clean_outside(labels: DataFrame, inside: DataFrame, background: int = 0, connectivity: int = 8) -> DataFrame:
    """Labels become background where the pixel or any neighbour in the image is outside the mask (0 in ``inside``)."""
    least = erode(inside, SQUARE if connectivity == 8 else CROSS).select(*PIXEL, F.col("v").alias("_least"))
    return labels.join(least, PIXEL, "left").select(*PIXEL, F.when(F.coalesce(F.col("_least"), F.lit(0)) > 0, F.col("label")).otherwise(F.lit(background)).alias("label"))


def gradient(px: DataFrame, column: str = "v") -> DataFrame:
    """Magnitude of central differences (one-sided at the edges), 0 to 255, rounded half up."""
    v = F.col(column)

    def slope(w: Window) -> Column:
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        central = (after - before) * F.lit(0.5)
        return F.coalesce(central, (after - v).cast("double"), (v - before).cast("double"), F.lit(0.0))

    steps = px.withColumns({"_dx": slope(_row()), "_dy": slope(_col())})
    return steps.select(*PIXEL, clamp_round(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))).alias(column))


def wavefront(px: DataFrame, column: str = "v") -> DataFrame:
    """Zero pixels with a non-zero neighbour among 8."""
    most = dilate(px, SQUARE, column).select(*PIXEL, F.col(column).alias("_most"))
    return px.where(F.col(column) == 0).join(most, PIXEL).where("_most > 0").select(*PIXEL)
