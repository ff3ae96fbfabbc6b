"""Images derived from the test tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PIXEL

#: Columns of the mosaic: 25 tiles of 8.
COLS = 200

SQL = {
    "emb_px": """SELECT vec_id AS image_id, CAST((i-1)//8 AS INT) AS y, CAST((i-1)%8 AS INT) AS x,
        CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE)+0.5)*255))) AS INT) AS v
        FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding,1) AS i FROM embeddings)""",
    "mosaic": "SELECT CAST(0 AS BIGINT) AS image_id, CAST((image_id//25)*8+y AS INT) AS y, CAST((image_id%25)*8+x AS INT) AS x, v FROM emb_px",
    "rgb_px": "SELECT image_id, y, x, CAST((v*5 + x*11) % 256 AS INT) AS b, CAST((v*7 + y*3) % 256 AS INT) AS g, v AS r FROM mosaic",
    "obj_px": "SELECT image_id, y, x, CAST(v//64 AS BIGINT) AS label FROM emb_px WHERE v >= 64",
    "gray2": "SELECT image_id, y, x, CAST((v*7 + x*3 + y*5) % 256 AS INT) AS v FROM emb_px",
    "centres": "SELECT k, 20 + 40 * (k // 5) + (k * 7) % 9 AS cy, 20 + 40 * (k % 5) + (k * 5) % 11 AS cx FROM range(25) t(k)",
    "cell_px": """SELECT CAST(0 AS BIGINT) AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(m % 100 AS INT) AS k, CAST(m // 100 AS INT) AS v FROM
        (SELECT y, x, min(((y - cy) * (y - cy) + (x - cx) * (x - cx)) * 100 + k) AS m FROM range(200) a(y) CROSS JOIN range(200) b(x) CROSS JOIN centres GROUP BY y, x)""",
    "discs": "SELECT cy, cx, 5 + k % 3 AS rad, k % 8 = 2 AS ring FROM centres UNION ALL SELECT cy, cx + 11, 7, false FROM centres WHERE k % 6 = 5",
    "disc_px": "SELECT DISTINCT CAST(0 AS BIGINT) AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM range(200) a(y) CROSS JOIN range(200) b(x) JOIN discs ON (y - cy) * (y - cy) + (x - cx) * (x - cx) <= rad * rad",
    "ev_log": """SELECT CAST(user_id AS VARCHAR) AS session, event_type AS name, CAST(user_id % 3 AS INT) AS type, CAST(0 AS BIGINT) AS start_us,
        CAST(round(value*100) AS BIGINT) AS end_us FROM events""",
}


def sql(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` with the images that it uses defined before it."""
    needs = {"rgb_px": ["mosaic"], "cell_px": ["centres"], "discs": ["centres"], "disc_px": ["centres", "discs"]}
    order = [n for n in SQL if n in {*names, "emb_px", *(m for x in names for m in needs.get(x, ()))}]
    return f"WITH {'RECURSIVE ' * recursive}" + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")


def emb_px(spark: SparkSession, d: str) -> DataFrame:
    """An 8 x 8 gray image per vector."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "e"))
    gray = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 0.5) * 255))).cast("int")
    return v.select("image_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), gray.alias("v"))


def mosaic(spark: SparkSession, d: str) -> DataFrame:
    """One image of all those, 25 in a row."""
    e = emb_px(spark, d)
    y, x = F.floor(F.col("image_id") / 25) * 8 + F.col("y"), F.col("image_id") % 25 * 8 + F.col("x")
    return e.select(F.lit(0).cast("long").alias("image_id"), y.cast("int").alias("y"), x.cast("int").alias("x"), "v")


def rgb_px(spark: SparkSession, d: str) -> DataFrame:
    v, y, x = F.col("v"), F.col("y"), F.col("x")
    return mosaic(spark, d).select(*PIXEL, ((v * 5 + x * 11) % 256).alias("b"), ((v * 7 + y * 3) % 256).alias("g"), v.alias("r"))


def obj_px(spark: SparkSession, d: str) -> DataFrame:
    """Labels on the small images: gray bands 1 to 3."""
    return emb_px(spark, d).where("v >= 64").select(*PIXEL, F.floor(F.col("v") / 64).cast("long").alias("label"))


def gray2(spark: SparkSession, d: str) -> DataFrame:
    return emb_px(spark, d).select(*PIXEL, ((F.col("v") * 7 + F.col("x") * 3 + F.col("y") * 5) % 256).alias("v"))


#: Places of the cells' centres: a grid of 5 x 5, a little out of line.
CENTRES = [(20 + 40 * (k // 5) + k * 7 % 9, 20 + 40 * (k % 5) + k * 5 % 11) for k in range(25)]
#: Discs on them: centre, radius, and whether there is a hole in it. Some have another one that they touch.
DISCS = [(y, x, 5 + k % 3, k % 8 == 2) for k, (y, x) in enumerate(CENTRES)] + [(y, x + 11, 7, False) for k, (y, x) in enumerate(CENTRES) if k % 6 == 5]


def _grid(spark: SparkSession) -> DataFrame:
    cells = spark.range(COLS * COLS)
    return cells.select(F.lit(0).cast("long").alias("image_id"), F.floor(F.col("id") / COLS).cast("int").alias("y"), (F.col("id") % COLS).cast("int").alias("x"))


def _square(cy: int, cx: int):
    return (F.col("y") - cy) * (F.col("y") - cy) + (F.col("x") - cx) * (F.col("x") - cx)


def cell_px(spark: SparkSession, d: str) -> DataFrame:
    """An image of cells: v is the squared distance to the nearest centre, whose number k gives the colour."""
    least = F.least(*[_square(y, x) * 100 + k for k, (y, x) in enumerate(CENTRES)])
    px = _grid(spark).withColumn("_m", least).select(*PIXEL, (F.col("_m") % 100).cast("int").alias("k"), F.floor(F.col("_m") / 100).cast("int").alias("v"))
    return px.select("*", (F.col("k") * 53 % 256).alias("b"), ((F.col("k") * 97 + 40) % 256).alias("g"), ((F.col("k") * 31 + 90) % 256).alias("r"))


def tissue_px(spark: SparkSession, d: str) -> DataFrame:
    """A painted piece of tissue: dark discs (nuclei, some with holes, some in touch) on a light ground, with single dark pixels."""
    any_of = lambda parts: F.coalesce(*[F.when(p, F.lit(True)) for p in parts], F.lit(False))
    disc = any_of([_square(y, x) <= r * r for y, x, r, _ in DISCS])
    hole = any_of([_square(y, x) <= 1 for y, x, _, ring in DISCS if ring])
    speck = any_of([_square(y + 12, x) == 0 for k, (y, x) in enumerate(CENTRES) if k % 4 == 1])
    dark = (disc & ~hole) | speck
    return _grid(spark).select(*PIXEL, *[F.when(dark, F.lit(a)).otherwise(F.lit(b)).alias(c) for c, a, b in (("b", 120, 190), ("g", 60, 150), ("r", 70, 200))])


def li_px(spark: SparkSession, d: str) -> DataFrame:
    """Lineitem as labelled gray values, without coordinates."""
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_suppkey").alias("label"), (F.col("l_quantity") * 5).cast("int").alias("v"))


def ev_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log: a session per user, durations from values."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("session"), F.col("event_type").alias("name"), (F.col("user_id") % 3).cast("int").alias("type"), F.lit(0).cast("long").alias("start_us"), F.round(F.col("value") * 100).cast("long").alias("end_us"))
