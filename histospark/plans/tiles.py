"""Dense kernels over sparse relations: one image or one tile to a task.

A tile is a square of pixels; its rows go to one group, become arrays, and the result's pixels become rows again. Order-dependent
operators that cross tile seams exchange one-pixel halos in rounds (geodesic.reconstruct) or link seams (components.label).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import PIXEL

TILE = 1024


def arrays(table: pa.Table, columns: list[str], fill: float = 0) -> tuple[int, int, np.ndarray, dict[str, np.ndarray]]:
    """(y0, x0, present, array by column) of a table of pixels."""
    y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
    y0, x0 = int(y.min()), int(x.min())
    shape = (int(y.max()) - y0 + 1, int(x.max()) - x0 + 1)
    present = np.zeros(shape, bool)
    present[y - y0, x - x0] = True
    out = {}
    for c in columns:
        values = table.column(c).to_numpy()
        out[c] = np.full(shape, fill, values.dtype)
        out[c][y - y0, x - x0] = values
    return y0, x0, present, out


def rows(image_id: int, y0: int, x0: int, present: np.ndarray, columns: dict[str, np.ndarray], kinds: dict[str, pa.DataType]) -> pa.Table:
    """The present pixels as rows."""
    y, x = np.nonzero(present)
    base = {"image_id": pa.array(np.full(len(y), image_id), pa.int64()), "y": pa.array(y + y0, pa.int32()), "x": pa.array(x + x0, pa.int32())}
    return pa.table(base | {c: pa.array(a[y, x]).cast(kinds[c]) for c, a in columns.items()})


ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def per_image(px: DataFrame, columns: list[str], kernel: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]], out: dict[str, str], fill: float = 0) -> DataFrame:
    """``kernel(present, arrays)`` on each image as a whole; the arrays that it returns become columns of types ``out``. Parallel over
    images: an image has to fit into a task."""
    kinds = {c: ARROW[t] for c, t in out.items()}

    def run(table: pa.Table) -> pa.Table:
        y0, x0, present, dense = arrays(table, columns, fill)
        return rows(table.column("image_id")[0].as_py(), y0, x0, present, kernel(present, dense), kinds)

    schema = ", ".join(["image_id long", "y int", "x int", *[f"{c} {t}" for c, t in out.items()]])
    return px.select(*PIXEL, *columns).groupBy("image_id").applyInArrow(run, schema)


def tiled(px: DataFrame, tile: int) -> DataFrame:
    """``px`` with the row and column of each pixel's tile, ty and tx."""
    return px.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})


def with_halo(px: DataFrame, tile: int, width: int) -> DataFrame:
    """``px`` with ty and tx, each pixel also for the tiles that are ``width`` or less from it. Only pixels along seams are repeated."""
    near = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + d) / tile).cast("int") for d in (-width, 0, width)]))
    return px.withColumn("ty", F.explode(near("y"))).withColumn("tx", F.explode(near("x")))
