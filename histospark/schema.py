"""Relations of the engine: an image is rows of pixels, an object a label on pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame

PIXEL = ["image_id", "y", "x"]
OBJECT = ["image_id", "label"]

SCHEMAS = {
    "image_px": "image_id long, y int, x int, b int, g int, r int",
    "gray_px": "image_id long, y int, x int, v int",
    "float_px": "image_id long, y int, x int, v double",
    "label_px": "image_id long, y int, x int, label long",
    "bbox": "image_id long, label long, minx int, maxx int, miny int, maxy int",
    "event_log": "session string, name string, type int, start_us long, end_us long",
    "status": "image_id long, status int",
}

#: Result codes of a segmentation.
SUCCESS, BACKGROUND, BACKGROUND_LIKELY, NO_CANDIDATES_LEFT, CONTINUE = 0, 1, 2, 3, 4
INVALID_IMAGE, RUNTIME_FAILED = -1, -2


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, if it has ``columns``; else ValueError."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")
    return df
