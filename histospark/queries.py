"""Registered queries of the image operators, with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import pixels as p
from .functions.texture import texture_features
from .operators import compare, eventlog, features, geodesic, histogram, layout, neighbors, watershed
from .operators import components as comp
from .plans import segmentation
from .schema import PIXEL
from .plans.storage import shared_dir, table
from .sources import fixtures as fx
from .sources import images, logs
from .sources.images import size_phantom

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COLS = fx.COLS
#: Absorption of red, green, blue by the two usual stains.
STAINS = [[0.650, 0.072, 0.0], [0.704, 0.990, 0.0], [0.286, 0.105, 0.0]]


def query(sql: str | None = None):
    def registered(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return registered


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, as engines sum in different orders."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def foreground(px: DataFrame, k: int) -> DataFrame:
    return px.where(F.col("v") > k).select(*PIXEL, F.lit(1).alias("v"))


def _dark(px: DataFrame) -> DataFrame:
    return px.where("r = 70").select(*PIXEL, F.lit(1).alias("v"))


def binary(px: DataFrame, k: int) -> DataFrame:
    return px.select(*PIXEL, p.above(F.col("v"), k).alias("v"))


# --- pixels -----------------------------------------------------------------------------------------------------------


@query(fx.sql("SELECT image_id, y, x, 255 - v AS v FROM mosaic", "mosaic"))
def invert(s, d):
    return fx.mosaic(s, d).select(*PIXEL, p.invert(F.col("v")).alias("v"))


@query(fx.sql("SELECT image_id, y, x, v % 7 AS v FROM mosaic", "mosaic"))
def mod(s, d):
    return fx.mosaic(s, d).select(*PIXEL, p.mod(F.col("v"), 7).alias("v"))


@query(fx.sql("SELECT image_id, y, x, CAST(floor(least(greatest(0.298936021293776::DOUBLE*r + 0.587043074451121::DOUBLE*g + 0.114020904255103::DOUBLE*b, 0), 255) + 0.5) AS INT) AS v FROM rgb_px", "rgb_px"))
def bgr2gray(s, d):
    return fx.rgb_px(s, d).select(*PIXEL, p.bgr2gray(F.col("b"), F.col("g"), F.col("r")).alias("v"))


def _deconv_sql() -> str:
    per = "(255 / ln(255))"
    dens = [f"(-ln(({c}::DOUBLE + 1) / 255) * {per})" for c in "rgb"]
    rows = p.unmixing(STAINS)
    stain = lambda q: f"CAST(floor(least(greatest(exp(-(({' + '.join(f'{float(a)!r}::DOUBLE * {x}' for a, x in zip(q, dens, strict=True))}) - 255) / {per}), 0), 255) + 0.5) AS INT)"
    return fx.sql(f"SELECT image_id, y, x, {stain(rows[0])} AS h, {stain(rows[1])} AS e FROM rgb_px", "rgb_px")


@query(_deconv_sql())
def color_deconv(s, d):
    h, e = p.color_deconv(F.col("b"), F.col("g"), F.col("r"), STAINS)
    return fx.rgb_px(s, d).select(*PIXEL, h.alias("h"), e.alias("e"))


@query(fx.sql("SELECT image_id, y, x, CASE WHEN v = 127 THEN 0 ELSE v END AS v FROM mosaic", "mosaic"))
def replace_value(s, d):
    return fx.mosaic(s, d).select(*PIXEL, p.replace(F.col("v"), 127, 0).alias("v"))


@query(fx.sql("SELECT image_id, y, x, CASE WHEN v >= 90 AND v < 160 THEN 255 ELSE 0 END AS v, CASE WHEN v > 153 THEN 255 ELSE 0 END AS above FROM mosaic", "mosaic"))
def threshold(s, d):
    v = F.col("v")
    return fx.mosaic(s, d).select(*PIXEL, p.threshold(v, 90, 160, True, False).alias("v"), p.above(v, 153).alias("above"))


@query(fx.sql("SELECT image_id, y, x, CASE WHEN g = 0 THEN NULL ELSE round(r::DOUBLE / g, 6) END AS q FROM rgb_px", "rgb_px"))
def divide(s, d):
    return rounded(fx.rgb_px(s, d).select(*PIXEL, p.divide(F.col("r"), F.col("g")).alias("q")))


@query(fx.sql("SELECT image_id, y, x, CASE WHEN g > 127 THEN r ELSE 0 END AS v, greatest(r - b, 0) AS difference FROM rgb_px", "rgb_px"))
def mask_and_subtract(s, d):
    masked = p.mask(F.col("r"), F.when(F.col("g") > 127, 255).otherwise(0))
    return fx.rgb_px(s, d).select(*PIXEL, masked.alias("v"), p.saturating_subtract(F.col("r"), F.col("b")).alias("difference"))


@query(fx.sql("SELECT image_id, y, x, CASE WHEN g > 127 THEN b ELSE r END AS v FROM rgb_px", "rgb_px"))
def masked_overwrite(s, d):
    mask = F.when(F.col("g") > 127, 255).otherwise(0)
    return fx.rgb_px(s, d).select(*PIXEL, p.overwrite(F.col("r"), F.col("b"), mask).alias("v"))


@query(fx.sql("SELECT image_id, count(*) FILTER (b > 127 AND g > 127) AS both_, count(*) FILTER (b > 127 OR g > 127) AS any_, count(*) FILTER (NOT b > 127) AS none_ FROM rgb_px GROUP BY image_id", "rgb_px"))
def mask_algebra(s, d):
    b, g = F.col("b") > 127, F.col("g") > 127
    return fx.rgb_px(s, d).groupBy("image_id").agg(F.count_if(b & g).alias("both_"), F.count_if(b | g).alias("any_"), F.count_if(~b).alias("none_"))


@query(fx.sql("SELECT image_id, y, x FROM rgb_px WHERE b > 120 AND g > 120 AND r > 120", "rgb_px"))
def background_mask(s, d):
    return fx.rgb_px(s, d).where(p.is_background(F.col("b"), F.col("g"), F.col("r"), 120)).select(*PIXEL)


@query(fx.sql("SELECT image_id, y, x, CAST((v - 128) / 32.0 AS FLOAT) AS f, CAST((v - 128) / 32.0 AS FLOAT) AS back FROM mosaic", "mosaic"))
def ordered_floats(s, d):
    f = ((F.col("v") - 128) / 32.0).cast("float")
    return fx.mosaic(s, d).select(*PIXEL, f.alias("f"), p.from_ordered_bits(p.ordered_bits(f)).alias("back"))


@query(fx.sql("""SELECT e.image_id, CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x, CAST(coalesce(m.v, 9) AS INT) AS v FROM (SELECT DISTINCT image_id FROM emb_px) e
    CROSS JOIN range(11) a(y) CROSS JOIN range(12) b(x) LEFT JOIN emb_px m ON m.image_id = e.image_id AND m.y = a.y - 1 AND m.x = b.x - 3""", "emb_px"))
def border(s, d):
    return layout.make_border(fx.emb_px(s, d), 1, 2, 3, 1, 9)


@query(fx.sql("SELECT image_id, y - 20 AS y, x - 30 AS x, v FROM mosaic WHERE y BETWEEN 20 AND 69 AND x BETWEEN 30 AND 89", "mosaic"))
def crop(s, d):
    return layout.crop(fx.mosaic(s, d), 20, 30, 50, 60)


@query(fx.sql("SELECT image_id, CAST(y - 1 AS INT) AS y, CAST(x - 1 AS INT) AS x, CAST(least(greatest(v * 2 - 100, 0), 255) AS INT) AS v, CAST(v AS FLOAT) / 4 AS f FROM emb_px WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6", "emb_px"))
def convert_without_border(s, d):
    inner = layout.remove_border(fx.emb_px(s, d), 1)
    return inner.select(*PIXEL, p.convert(F.col("v"), "uchar", 2, -100).alias("v"), p.convert(F.col("v"), "float", 0.25).alias("f"))


@query(fx.sql("SELECT image_id, y, x, b AS v FROM rgb_px", "rgb_px"))
def split_channel(s, d):
    return layout.split_channels(fx.rgb_px(s, d))["b"]


@query(fx.sql("SELECT image_id, CAST(y + 8 * i AS INT) AS y, CAST(x + 8 * j AS INT) AS x, v FROM emb_px CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j)", "emb_px"))
def zoom(s, d):
    return layout.repeat(fx.emb_px(s, d), 2, 8, 8)


@query(fx.sql("""+ f AS (SELECT image_id, label, min(y * 8 + x) AS a FROM obj_px GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY a) - 1 AS k,
    count(*) OVER (PARTITION BY image_id) AS n FROM f) SELECT o.image_id, y, x, CAST(k * greatest(1, 255 // n) AS INT) AS v FROM obj_px o JOIN r USING (image_id, label)""", "obj_px"))
def normalize_labels(s, d):
    return layout.normalize_labels(fx.obj_px(s, d))


# --- neighbourhoods ---------------------------------------------------------------------------------------------------


def _morph_sql(src: str, fold: str, cond: str) -> str:
    return f"SELECT a.image_id, a.y, a.x, {fold}(b.v) AS v FROM {src} a JOIN {src} b ON a.image_id = b.image_id AND {cond} GROUP BY ALL"


_SQUARE = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"
_CROSS = "abs(a.y - b.y) + abs(a.x - b.x) <= 1"
_DISK = "(a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 64"


@query(fx.sql(_morph_sql("emb_px", "min", _SQUARE), "emb_px"))
def erode(s, d):
    return neighbors.erode(fx.emb_px(s, d), neighbors.SQUARE)


@query(fx.sql(_morph_sql("emb_px", "max", _DISK), "emb_px"))
def dilate_disk(s, d):
    return neighbors.dilate(fx.emb_px(s, d), neighbors.DISK17)


@query(fx.sql(f"+ e AS ({_morph_sql('emb_px', 'min', _CROSS)}) {_morph_sql('e', 'max', _CROSS)}", "emb_px"))
def opening(s, d):
    return neighbors.opening(fx.emb_px(s, d), neighbors.CROSS)


_AROUND = "lag(v) OVER w AS w, lead(v) OVER w AS e, lag(v) OVER c AS n, lead(v) OVER c AS s"
_WINDOWS = "WINDOW w AS (PARTITION BY image_id, y ORDER BY x), c AS (PARTITION BY image_id, x ORDER BY y)"


@query(fx.sql(f"""+ l AS (SELECT image_id, y, x, CAST(v // 64 - 1 AS INT) AS v FROM emb_px), a AS (SELECT *, {_AROUND} FROM l {_WINDOWS}),
    b AS (SELECT *, lag(n) OVER (PARTITION BY image_id, y ORDER BY x) AS nw, lead(n) OVER (PARTITION BY image_id, y ORDER BY x) AS ne FROM a)
    SELECT image_id, y, x, CASE WHEN w IS NOT NULL AND e IS NOT NULL AND n = -1 AND v <> -1 AND ((nw <> -1 AND w = -1) OR (ne <> -1 AND e = -1)) THEN -1 ELSE v END AS label FROM b""", "emb_px"))
def ridge_repair(s, d):
    labels = fx.emb_px(s, d).select(*PIXEL, (F.floor(F.col("v") / 64) - 1).cast("int").alias("label"))
    return neighbors.repair_ridges(labels)


@query(fx.sql(f"""+ l AS (SELECT image_id, y, x, CAST(v // 64 AS INT) AS v FROM emb_px), a AS (SELECT *, {_AROUND} FROM l {_WINDOWS}),
    b AS (SELECT *, lag(n) OVER (PARTITION BY image_id, y ORDER BY x) AS nw, lead(n) OVER (PARTITION BY image_id, y ORDER BY x) AS ne FROM a)
    SELECT image_id, y, x, CASE WHEN w IS NOT NULL AND e IS NOT NULL AND n IS NOT NULL AND s IS NOT NULL AND ((n <> 0 AND n <> v) OR (w <> 0 AND w <> v) OR (nw <> 0 AND nw <> v)
    OR (ne <> 0 AND ne <> v)) THEN 0 ELSE v END AS label FROM b""", "emb_px"))
def border_cut(s, d):
    labels = fx.emb_px(s, d).select(*PIXEL, F.floor(F.col("v") / 64).cast("int").alias("label"))
    return neighbors.cut_borders(labels, 0, 8)


@query(fx.sql(f"""+ m AS ({_morph_sql('emb_px', 'min', _SQUARE)}) SELECT image_id, y, x, CASE WHEN m.v > 40 THEN CAST(e.v // 64 AS INT) ELSE 0 END AS label FROM emb_px e
    JOIN m USING (image_id, y, x)""", "emb_px"))
def outside_cleanup(s, d):
    px = fx.emb_px(s, d)
    labels = px.select(*PIXEL, F.floor(F.col("v") / 64).cast("int").alias("label"))
    return neighbors.clean_outside(labels, binary(px, 40))


_GRADIENT = f"""a AS (SELECT *, {_AROUND} FROM gray2 {_WINDOWS}), g AS (SELECT image_id, y, x, coalesce((e - w) * 0.5::DOUBLE, (e - v)::DOUBLE, (v - w)::DOUBLE, 0) AS dx,
    coalesce((s - n) * 0.5::DOUBLE, (s - v)::DOUBLE, (v - n)::DOUBLE, 0) AS dy FROM a),
    gr AS (SELECT image_id, y, x, CAST(floor(least(sqrt(dx * dx + dy * dy), 255) + 0.5) AS INT) AS v FROM g)"""


@query(fx.sql(f"+ {_GRADIENT} SELECT * FROM gr", "gray2"))
def gradient(s, d):
    return neighbors.gradient(fx.gray2(s, d))


@query(fx.sql(f"+ z AS (SELECT image_id, y, x, CASE WHEN v > 128 THEN 255 ELSE 0 END AS v FROM emb_px), m AS ({_morph_sql('z', 'max', _SQUARE)}) SELECT image_id, y, x FROM z JOIN m USING (image_id, y, x) WHERE z.v = 0 AND m.v > 0", "emb_px"))
def wavefront(s, d):
    return neighbors.wavefront(binary(fx.emb_px(s, d), 128))


_CANNY = f"""off AS (SELECT i - 2 AS dy, j - 2 AS dx, [1, 4, 6, 4, 1][i + 1] * [-1, -2, 0, 2, 1][j + 1] AS wx, [-1, -2, 0, 2, 1][i + 1] * [1, 4, 6, 4, 1][j + 1] AS wy FROM range(5) a(i) CROSS JOIN range(5) b(j)),
    sl AS (SELECT a.image_id, a.y, a.x, sum(wx * n.v) AS gx, sum(wy * n.v) AS gy FROM gray2 a CROSS JOIN off JOIN gray2 n ON n.image_id = a.image_id AND n.y = greatest(0, least(7, a.y + dy)) AND n.x = greatest(0, least(7, a.x + dx)) GROUP BY ALL),
    no AS (SELECT *, abs(gx) AS ax, abs(gy) AS ay, abs(gx) + abs(gy) AS v FROM sl),
    ar AS (SELECT *, lag(v, 1, 0) OVER w AS w, lead(v, 1, 0) OVER w AS e, lag(v, 1, 0) OVER c AS n, lead(v, 1, 0) OVER c AS s FROM no {_WINDOWS}),
    co AS (SELECT *, lag(n, 1, 0) OVER w AS nw, lead(n, 1, 0) OVER w AS ne, lag(s, 1, 0) OVER w AS sw, lead(s, 1, 0) OVER w AS se FROM ar {_WINDOWS}),
    wk AS (SELECT image_id, y, x, v, v > 70 AND CASE WHEN ay < ax * tan(pi() / 8) THEN v > w AND v >= e WHEN ay > ax * tan(3 * pi() / 8) THEN v > n AND v >= s
        WHEN (gx < 0) <> (gy < 0) THEN v > ne AND v > sw ELSE v > nw AND v > se END AS weak FROM co),
    reach AS (SELECT image_id, y, x FROM wk WHERE weak AND v > 90 UNION SELECT n.image_id, n.y, n.x FROM reach a JOIN wk n ON n.weak AND n.image_id = a.image_id AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1),
    can AS (SELECT image_id, g.y, g.x, CASE WHEN reach.y IS NULL THEN 0 ELSE 255 END AS v FROM gray2 g LEFT JOIN reach USING (image_id, y, x))"""


@query(fx.sql(f"+ {_CANNY} SELECT * FROM can", "gray2", recursive=True))
def canny(s, d):
    return watershed.canny(fx.gray2(s, d))


@query(fx.sql(f"+ {_CANNY} SELECT * FROM can", "gray2", recursive=True))
def canny_tiled(s, d):
    """On tiles of 4 x 4 with halos."""
    return watershed.canny(fx.gray2(s, d), tile=4)


# --- components -------------------------------------------------------------------------------------------------------

_LABELS = """fg AS (SELECT y, x, y * 200 + x AS p FROM mosaic WHERE v > 153), r(p, l) USING KEY (p) AS (SELECT p, p FROM fg UNION SELECT n.p, min(a.l) FROM r a JOIN fg c ON c.p = a.p
    JOIN fg n ON n.y BETWEEN c.y - 1 AND c.y + 1 AND n.x BETWEEN c.x - 1 AND c.x + 1 JOIN recurring.r k ON k.p = n.p WHERE a.l < k.l GROUP BY n.p),
    lab AS (SELECT CAST(0 AS BIGINT) AS image_id, CAST(p // 200 AS INT) AS y, CAST(p % 200 AS INT) AS x, CAST(l AS BIGINT) AS label FROM r)"""


def mosaic_labels(s, d, tile: int = 64):
    return comp.label(foreground(fx.mosaic(s, d), 153), COLS, 8, tile=tile)


@query(fx.sql(f"+ {_LABELS} SELECT * FROM lab", "mosaic", recursive=True))
def label(s, d):
    return mosaic_labels(s, d)


@query(fx.sql(f"+ {_LABELS}, k AS (SELECT label, row_number() OVER (ORDER BY label) AS n FROM (SELECT DISTINCT label FROM lab)) SELECT image_id, y, x, n AS label FROM lab JOIN k USING (label)", "mosaic", recursive=True))
def relabel(s, d):
    return comp.relabel(mosaic_labels(s, d))


_KEPT = "kept AS (SELECT label FROM lab GROUP BY label HAVING count(*) >= 3 AND count(*) < 1000)"


@query(fx.sql(f"+ {_LABELS}, {_KEPT} SELECT lab.* FROM lab JOIN kept USING (label)", "mosaic", recursive=True))
def area_threshold(s, d):
    return comp.area_threshold(foreground(fx.mosaic(s, d), 153), COLS, 3, 1000, 8, 64)


@query(fx.sql(f"+ {_LABELS}, {_KEPT} SELECT image_id, y, x, 255 AS v FROM lab JOIN kept USING (label)", "mosaic", recursive=True))
def area_open(s, d):
    return comp.area_open(foreground(fx.mosaic(s, d), 153), COLS, 3, 1000, 8, tile=64)


@query(fx.sql(f"""+ {_LABELS}, {_KEPT}, k AS (SELECT label AS l, row_number() OVER (ORDER BY label) AS n FROM kept)
    SELECT image_id, n AS label, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, count(*) AS area FROM lab JOIN k ON l = label GROUP BY image_id, n""", "mosaic", recursive=True))
def entity_boxes(s, d):
    found = comp.objects(mosaic_labels(s, d, tile=256))
    return comp.renumbered(found.where("area >= 3 AND area < 1000"))


@query(fx.sql(f"""+ {_LABELS}, k AS (SELECT label FROM lab GROUP BY label HAVING max(x) - min(x) >= 2 AND count(*) > 4) SELECT lab.* FROM lab JOIN k USING (label)""", "mosaic", recursive=True))
def label_filtered(s, d):
    return comp.label_filtered(foreground(fx.mosaic(s, d), 153), COLS, 8, (F.col("maxx") - F.col("minx") >= 2) & (F.col("area") > 4), tile=64)


_OUTSIDE = """cells AS (SELECT o.image_id, o.label, CAST(a.y - 1 AS INT) AS y, CAST(b.x - 1 AS INT) AS x FROM (SELECT DISTINCT image_id, label FROM obj_px) o CROSS JOIN range(10) a(y) CROSS JOIN range(10) b(x)
    WHERE NOT EXISTS (SELECT 1 FROM obj_px p WHERE p.image_id = o.image_id AND p.label = o.label AND p.y = a.y - 1 AND p.x = b.x - 1)),
    free AS (SELECT image_id, label, y, x FROM cells WHERE y = -1 AND x = -1 UNION SELECT n.image_id, n.label, n.y, n.x FROM free a JOIN cells n ON n.image_id = a.image_id AND n.label = a.label AND abs(n.y - a.y) + abs(n.x - a.x) = 1),
    filled AS (SELECT o.image_id, o.label, CAST(a.y AS INT) AS y, CAST(b.x AS INT) AS x FROM (SELECT DISTINCT image_id, label FROM obj_px) o CROSS JOIN range(8) a(y) CROSS JOIN range(8) b(x)
    WHERE NOT EXISTS (SELECT 1 FROM free p WHERE p.image_id = o.image_id AND p.label = o.label AND p.y = a.y AND p.x = b.x))"""


@query(fx.sql(f"+ {_OUTSIDE} SELECT image_id, label, count(*) AS area FROM filled GROUP BY ALL", "obj_px", recursive=True))
def contour_area(s, d):
    return comp.contour_area(fx.obj_px(s, d))


@query(fx.sql(f"""+ {_OUTSIDE}, quads AS (SELECT image_id, label, y + dy AS qy, x + dx AS qx, count(*) AS n FROM filled CROSS JOIN (VALUES (0, 0), (0, -1), (-1, -1), (-1, 0)) c(dy, dx) GROUP BY ALL),
    q AS (SELECT image_id, label, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0 END) AS polygon FROM quads GROUP BY ALL), f AS (SELECT image_id, label, count(*) AS filled FROM filled GROUP BY ALL),
    a AS (SELECT image_id, label, count(*) AS area FROM obj_px GROUP BY ALL) SELECT image_id, label, area, filled, polygon, CAST(2 * (filled - 1 - polygon) AS BIGINT) AS points FROM q JOIN f USING (image_id, label) JOIN a USING (image_id, label)""", "obj_px", recursive=True))
def contours(s, d):
    return comp.contours(fx.obj_px(s, d)).drop("net")


@query(fx.sql(f"+ {_OUTSIDE}, k AS (SELECT image_id, label FROM filled GROUP BY ALL HAVING count(*) >= 12 AND count(*) < 50) SELECT o.* FROM obj_px o JOIN k USING (image_id, label)", "obj_px", recursive=True))
def contour_area_filter(s, d):
    return comp.contour_area_filter(fx.obj_px(s, d), 12, 50, "filled")


@query(fx.sql("""+ k AS (SELECT *, row_number() OVER (ORDER BY cy - rad, cx) AS n FROM (SELECT k, cy, cx, 5 + k % 3 AS rad FROM centres WHERE k % 6 <> 5)) SELECT k.n AS place, count(*) AS area
    FROM k JOIN disc_px ON (y - cy) * (y - cy) + (x - cx) * (x - cx) <= rad * rad GROUP BY k.n""", "disc_px"))
def label_contours(s, d):
    """Filled contours of the discs that touch no other, by their first row."""
    found = comp.label_contours(_dark(fx.tissue_px(s, d)), COLS, 8, tile=64)
    size = found.groupBy("label").agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.min("x").alias("x0"))
    alone = size.where("area > 11 AND x1 - x0 < 16").withColumn("place", F.row_number().over(Window.orderBy("y0", "x0")).cast("long"))
    return alone.select("place", "area")


# --- reconstruction and what follows ----------------------------------------------------------------------------------


def _recon_sql(marker: str, mask: str, connectivity: int, out: str = "val", src: str = "emb_px") -> str:
    four = "AND abs(n.y - a.y) + abs(n.x - a.x) <= 1" if connectivity == 4 else ""
    return fx.sql(
        f"""+ m AS (SELECT image_id, y, x, v, {marker} AS marker, {mask} AS mask FROM {src}), r(image_id, y, x, val) USING KEY (image_id, y, x) AS (SELECT image_id, y, x, least(marker, mask) FROM m
        UNION SELECT n.image_id, n.y, n.x, max(least(a.val, n.mask)) FROM r a JOIN m n ON n.image_id = a.image_id AND n.y BETWEEN a.y - 1 AND a.y + 1 AND n.x BETWEEN a.x - 1 AND a.x + 1 {four}
        JOIN recurring.r k ON k.image_id = n.image_id AND k.y = n.y AND k.x = n.x WHERE least(a.val, n.mask) > k.val GROUP BY n.image_id, n.y, n.x) SELECT r.image_id, r.y, r.x, {out} AS v FROM r JOIN m USING (image_id, y, x)""",
        src, recursive=True,
    )


def _seeded(px: DataFrame) -> DataFrame:
    v = F.col("v")
    return px.select(*PIXEL, F.when((F.col("x") * 3 + F.col("y") * 5) % 7 == 0, v).otherwise(F.lit(0)).alias("marker"), v.alias("mask"))


_SEED = "CASE WHEN (x * 3 + y * 5) % 7 = 0 THEN v ELSE 0 END"


@query(_recon_sql(_SEED, "v", 8, "CAST(val AS DOUBLE)"))
def reconstruct(s, d):
    return geodesic.reconstruct(_seeded(fx.emb_px(s, d)), 8)


@query(_recon_sql("greatest(v - 40, 0)", "v", 4, "CAST(val AS DOUBLE)", "mosaic"))
def reconstruct_tiled(s, d):
    """On tiles of 64 x 64, which exchange seams."""
    px = fx.mosaic(s, d)
    return geodesic.reconstruct(px.select(*PIXEL, F.greatest(F.col("v") - 40, F.lit(0)).alias("marker"), F.col("v").alias("mask")), 4, tile=64)


@query(_recon_sql("greatest(255 - v - 40, 0)", "255 - v", 8, "255 - val"))
def h_minima(s, d):
    return geodesic.h_minima(fx.emb_px(s, d), 40, 8)


@query(_recon_sql("v - 1", "v", 8, "CASE WHEN val < m.v THEN 255 ELSE 0 END"))
def regional_maxima(s, d):
    return geodesic.regional_maxima(fx.emb_px(s, d), 8, 8)


@query(_recon_sql("254 - v", "255 - v", 4, "CASE WHEN val < 255 - m.v THEN 255 ELSE 0 END"))
def regional_minima(s, d):
    return geodesic.regional_minima(fx.emb_px(s, d), 8, 4)


@query(_recon_sql("CASE WHEN y = 0 OR y = 7 OR x = 0 OR x = 7 THEN 255 - v ELSE 0 END", "255 - v", 4, "255 - val"))
def fill_holes_gray(s, d):
    return geodesic.fill_holes_gray(fx.emb_px(s, d), 4)


def _reach_sql(src: str, seed: str, four: bool, out: str) -> str:
    near = "abs(n.y - a.y) + abs(n.x - a.x) = 1" if four else "abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1"
    return fx.sql(f"+ z AS ({src}), reach AS (SELECT image_id, y, x FROM z WHERE {seed} UNION SELECT n.image_id, n.y, n.x FROM reach a JOIN z n ON n.image_id = a.image_id AND {near}) {out}", "emb_px", recursive=True)


@query(_reach_sql("SELECT image_id, y, x FROM emb_px WHERE v <= 128", "y = 0 OR y = 7 OR x = 0 OR x = 7", True,
    "SELECT e.image_id, e.y, e.x, CASE WHEN v > 128 OR reach.y IS NULL THEN 255 ELSE 0 END AS v FROM emb_px e LEFT JOIN reach USING (image_id, y, x)"))
def fill_holes(s, d):
    return geodesic.fill_holes(binary(fx.emb_px(s, d), 128), 8, 4)


@query(_reach_sql("SELECT image_id, y, x FROM emb_px WHERE v <= 128", "x = 3 AND y = 3", True,
    "SELECT e.image_id, e.y, e.x, CASE WHEN v > 128 OR reach.y IS NOT NULL THEN 255 ELSE 0 END AS v FROM emb_px e LEFT JOIN reach USING (image_id, y, x)"))
def fill_from_seeds(s, d):
    px = binary(fx.emb_px(s, d), 128)
    return geodesic.fill_from_seeds(px, px.where("x = 3 AND y = 3"), 8, 4)


@query(_reach_sql("SELECT image_id, y, x, v FROM emb_px WHERE v > 110", "v > 190", False, "SELECT image_id, y, x FROM reach"))
def select_touched(s, d):
    px = fx.emb_px(s, d)
    return geodesic.select(foreground(px, 110), px.where("v > 190"), 8, 8)


@query(_reach_sql("SELECT image_id, y, x, v FROM emb_px WHERE v > 110", "v > 190", False, "SELECT image_id, y, x, 255 AS v FROM reach"))
def reconstruct_binary(s, d):
    px = fx.emb_px(s, d)
    return geodesic.reconstruct_binary(px.select(*PIXEL, p.above(F.col("v"), 190).alias("marker"), p.above(F.col("v"), 110).alias("mask")), 8, 8)


@query(fx.sql("""SELECT a.image_id, a.y, a.x, round(coalesce(sqrt(min((a.y - z.y) * (a.y - z.y) + (a.x - z.x) * (a.x - z.x))), -1), 6) AS v FROM emb_px a
    LEFT JOIN emb_px z ON z.image_id = a.image_id AND z.v <= 128 GROUP BY a.image_id, a.y, a.x""", "emb_px"))
def distance(s, d):
    return rounded(geodesic.distance(binary(fx.emb_px(s, d), 128)))


@query(fx.sql("""SELECT a.image_id, a.y, a.x, round(coalesce(sqrt(min((a.y - z.y) * (a.y - z.y) + (a.x - z.x) * (a.x - z.x))), -1), 6) AS v FROM emb_px a
    LEFT JOIN emb_px z ON z.image_id = a.image_id AND z.v <= 128 GROUP BY a.image_id, a.y, a.x""", "emb_px"))
def distance_tiled(s, d):
    """In strips of three rows and columns."""
    return rounded(geodesic.distance(binary(fx.emb_px(s, d), 128), strip=3))


@query(fx.sql("SELECT image_id, y, x, round(sqrt(v), 6) AS v FROM cell_px WHERE v <= 100", "cell_px"))
def wavefront_distance(s, d):
    """From the centres of cells, as far as no other centre comes in."""
    px = fx.cell_px(s, d).select(*PIXEL, F.when(F.col("v") == 0, 0).otherwise(1).alias("v"))
    return rounded(geodesic.wavefront_distance(px)).where("v <= 10")


@query(_recon_sql(_SEED, "v", 8, "CAST(val AS DOUBLE)"))
def reconstruct_by_levels(s, d):
    return geodesic.reconstruct_by_levels(_seeded(fx.emb_px(s, d)), 8)


# --- watersheds and segmentation --------------------------------------------------------------------------------------


_BASINS = "SELECT image_id, y, x, CAST({label} AS INT) AS label FROM cell_px JOIN (SELECT k, cy, cx, row_number() OVER (ORDER BY cy, cx) AS rank FROM centres) USING (k) WHERE v <= 64"
_LINEAR = _BASINS.format(label="cy * 200 + cx + 1")


def _cores(labels: DataFrame, px: DataFrame) -> DataFrame:
    """Labels near the centres of cells, where every way of flooding has to agree."""
    return labels.join(px.where("v <= 64").select(*PIXEL), PIXEL, "left_semi").select(*PIXEL, "label")


@query(fx.sql(_BASINS.format(label="rank"), "cell_px"))
def watershed_flood(s, d):
    px = fx.cell_px(s, d)
    return _cores(watershed.watershed(px.drop("k")), px)


@query(fx.sql(_LINEAR, "cell_px"))
def watershed_drop(s, d):
    px = fx.cell_px(s, d)
    return _cores(watershed.drop_of_water(px, 8, px.select(*PIXEL, F.lit(255).alias("v"))), px)


@query(fx.sql(_LINEAR, "cell_px"))
def watershed_paths(s, d):
    px = fx.cell_px(s, d)
    return _cores(watershed.cheapest_paths(px, 8), px)


@query(fx.sql("""SELECT image_id, round(avg(CASE WHEN b > 220 AND g > 220 AND r > 220 THEN 1.0 ELSE 0.0 END), 6) AS ratio,
    CASE WHEN avg(CASE WHEN b > 220 AND g > 220 AND r > 220 THEN 1.0 ELSE 0.0 END) >= 0.99 THEN 1 WHEN avg(CASE WHEN b > 220 AND g > 220 AND r > 220 THEN 1.0 ELSE 0.0 END) >= 0.9 THEN 2 ELSE 4 END AS status
    FROM rgb_px GROUP BY image_id""", "rgb_px"))
def background_status(s, d):
    return rounded(segmentation.background_status(fx.rgb_px(s, d)))


@query(fx.sql("""+ o AS (SELECT image_id, y, x, r::DOUBLE / (g + 1.1920928955078125e-07::DOUBLE) AS rg, r::DOUBLE / (b + 1.1920928955078125e-07::DOUBLE) AS rb FROM rgb_px), z AS (SELECT * FROM o WHERE rg > 4),
    reach AS (SELECT image_id, y, x FROM z WHERE rg > 5 UNION SELECT n.image_id, n.y, n.x FROM reach a JOIN z n ON n.image_id = a.image_id AND abs(n.y - a.y) <= 1 AND abs(n.x - a.x) <= 1)
    SELECT image_id, y, x FROM reach JOIN o USING (image_id, y, x) WHERE rb > 1""", "rgb_px", recursive=True))
def red_cells(s, d):
    return segmentation.red_cells(fx.rgb_px(s, d), COLS)


@query(fx.sql("SELECT CAST(0 AS BIGINT) AS image_id, CAST(g.y AS INT) AS y, CAST(g.x AS INT) AS x, CASE WHEN p.y IS NULL THEN 0 ELSE 255 END AS v FROM (SELECT a.y, b.x FROM range(200) a(y) CROSS JOIN range(200) b(x)) g LEFT JOIN disc_px p ON p.y = g.y AND p.x = g.x", "disc_px"))
def nucleus_candidates(s, d):
    """All discs of the painted tissue with their holes filled, and none of the single pixels."""
    return segmentation.candidates(fx.tissue_px(s, d), COLS)


def _nuclei(s, d):
    return segmentation.segment_nuclei(fx.tissue_px(s, d), COLS, tile=64)


@query(fx.sql("SELECT CAST(0 AS BIGINT) AS image_id, 0 AS status, cy, cx, 1 AS nuclei, true AS alone, true AS sized FROM discs", "discs"))
def segment_nuclei(s, d):
    """For every disc: a nucleus that has its centre, has no other's, and is about as large as the disc."""
    labels, _, status = _nuclei(s, d)
    labels = table(labels, "found-nuclei")
    area = labels.groupBy("label").agg(F.count(F.lit(1)).alias("area"))
    discs = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x"), F.lit(r).alias("rad")) for y, x, r, _ in fx.DISCS])
    points = s.range(1).select(F.explode(discs).alias("c")).select(F.lit(0).cast("long").alias("image_id"), "c.*")
    hit = points.join(labels, PIXEL, "left").join(area, "label", "left").join(status, "image_id")
    own = hit.withColumn("_n", F.count("label").over(Window.partitionBy("label")))
    sized = (F.col("area") > 2 * F.col("rad") * F.col("rad")) & (F.col("area") < 5 * F.col("rad") * F.col("rad"))
    return own.select("image_id", "status", F.col("y").alias("cy"), F.col("x").alias("cx"), F.when(F.col("label").isNotNull(), 1).otherwise(0).alias("nuclei"), (F.col("_n") == 1).alias("alone"), sized.alias("sized"))


@query()
def nucleus_features(s, d):
    labels, _, _ = _nuclei(s, d)
    gray = fx.tissue_px(s, d).select(*PIXEL, F.col("b").alias("v"))
    return rounded(features.all_features(labels, gray))


# --- histograms and features ------------------------------------------------------------------------------------------


@query(fx.sql("SELECT image_id, label, g.v AS bin, count(*) AS cnt FROM obj_px JOIN gray2 g USING (image_id, y, x) GROUP BY ALL", "obj_px", "gray2"))
def object_histogram(s, d):
    return histogram.object_histogram(fx.obj_px(s, d), fx.gray2(s, d))


@query(fx.sql("SELECT image_id, v AS bin, count(*) AS cnt FROM mosaic WHERE v > 0 AND y BETWEEN 10 AND 109 AND x BETWEEN 20 AND 119 GROUP BY ALL", "mosaic"))
def image_histogram(s, d):
    px = fx.mosaic(s, d)
    return histogram.image_histogram(px, px, (10, 20, 100, 100))


@query(fx.sql("SELECT image_id, m.v & g.v AS bin, count(*) AS cnt FROM emb_px m JOIN gray2 g USING (image_id, y, x) WHERE g.v > 0 GROUP BY ALL", "gray2"))
def masked_histogram(s, d):
    return histogram.masked_histogram(fx.emb_px(s, d), fx.gray2(s, d))


def _stats_sql(hist: str, keys: str, prefix: str = "") -> str:
    cols = ["mean", "std", "minimum", "maximum", "median", "first_quartile", "third_quartile", "entropy", "energy", "skewness", "kurtosis"]
    return f"""h AS ({hist}), c AS (SELECT *, sum(cnt) OVER (PARTITION BY {keys} ORDER BY bin) AS cum, sum(cnt) OVER (PARTITION BY {keys}) AS tot FROM h),
    t AS (SELECT {keys}, CAST(sum(cnt) AS BIGINT) AS n, CAST(sum(CASE WHEN bin >= 1 THEN cnt ELSE 0 END) AS BIGINT) AS nonzero, CAST(sum(cnt * bin) AS BIGINT) AS s1, CAST(sum(cnt * bin::BIGINT * bin) AS BIGINT) AS s2, CAST(sum(cnt * bin::BIGINT * bin * bin) AS BIGINT) AS s3,
      CAST(sum(cnt * bin::BIGINT * bin * bin * bin) AS BIGINT) AS s4, min(bin) AS minimum, max(bin) AS maximum,
      CASE WHEN max(tot) // 2 = 0 THEN 0 ELSE min(CASE WHEN cum >= tot // 2 THEN bin END) END AS median, CASE WHEN max(tot) // 4 = 0 THEN 0 ELSE min(CASE WHEN cum >= tot // 4 THEN bin END) END AS first_quartile,
      CASE WHEN 3 * max(tot) // 4 = 0 THEN 0 ELSE min(CASE WHEN cum >= 3 * tot // 4 THEN bin END) END AS third_quartile, sum(cnt::DOUBLE * cnt) AS hh, sum(cnt * log2(cnt)) AS hl FROM c GROUP BY {keys}),
    u AS (SELECT *, s1 / n::DOUBLE AS m, s2 / n::DOUBLE AS e2, s3 / n::DOUBLE AS e3, s4 / n::DOUBLE AS e4, (n::HUGEINT * s2 - s1::HUGEINT * s1)::DOUBLE / (n::DOUBLE * n) AS var FROM t),
    st AS (SELECT {keys}, n, nonzero, round(m, 6) AS mean, round(sqrt(var), 6) AS std, minimum, maximum, CAST(median AS INT) AS median, CAST(first_quartile AS INT) AS first_quartile, CAST(third_quartile AS INT) AS third_quartile,
      round(log2(n) - hl / n, 6) AS entropy, round(hh / (n::DOUBLE * n), 6) AS energy,
      round(CASE WHEN var = 0 THEN 0 ELSE (e3 - 3 * m * e2 + 2 * m * m * m) / (var * sqrt(var)) END, 6) AS skewness,
      round(CASE WHEN var = 0 THEN 0 ELSE (e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m) / (var * var) END, 6) AS kurtosis FROM u)"""  # noqa: F841


_OBJ_HIST = "SELECT image_id, label, g.v AS bin, count(*) AS cnt FROM obj_px JOIN gray2 g USING (image_id, y, x) GROUP BY ALL"


@query(fx.sql(f"+ {_stats_sql(_OBJ_HIST, 'image_id, label')} SELECT * FROM st", "obj_px", "gray2"))
def histogram_statistics(s, d):
    return rounded(histogram.statistics(histogram.object_histogram(fx.obj_px(s, d), fx.gray2(s, d))))


@query(fx.sql(f"""+ {_stats_sql(_OBJ_HIST, 'image_id, label')}, every AS (SELECT image_id, CAST(l AS BIGINT) AS label FROM (SELECT DISTINCT image_id FROM emb_px) CROSS JOIN range(1, 6) r(l))
    SELECT image_id, label, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, coalesce(minimum, 256) AS minimum, coalesce(maximum, 0) AS maximum, coalesce(median, 0) AS median FROM every LEFT JOIN st USING (image_id, label)""", "obj_px", "gray2"))
def empty_statistics(s, d):
    """Labels 1 to 5 of every image, of which the last never has a pixel."""
    found = histogram.statistics(histogram.object_histogram(fx.obj_px(s, d), fx.gray2(s, d)))
    every = fx.emb_px(s, d).select("image_id").distinct().select("image_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("label"))
    return rounded(histogram.with_empty(found, every).select("image_id", "label", "n", "mean", "minimum", "maximum", "median"))


@query(f"WITH {_stats_sql('SELECT l_suppkey AS label, CAST(l_quantity * 5 AS INT) AS bin, count(*) AS cnt FROM lineitem GROUP BY ALL', 'label')} SELECT * FROM st")
def load_statistics(s, d):
    hist = fx.li_px(s, d).groupBy("label", F.col("v").alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    return rounded(histogram.statistics(hist, ["label"]))


@query(fx.sql(f"+ {_stats_sql(_OBJ_HIST, 'image_id, label')} SELECT image_id, label, mean, maximum, minimum, std, entropy, energy, skewness, kurtosis FROM st", "obj_px", "gray2"))
def intensity_features(s, d):
    return rounded(features.intensity_features(fx.obj_px(s, d), fx.gray2(s, d)))


_GRAD_HIST = "SELECT image_id, label, gr.v AS bin, count(*) AS cnt FROM obj_px JOIN gr USING (image_id, y, x) GROUP BY ALL"
_GRAD_COLS = ", ".join(f"{c} AS gradient_{c}" for c in ("mean", "std", "entropy", "energy", "skewness", "kurtosis"))


@query(fx.sql(f"+ {_GRADIENT}, {_stats_sql(_GRAD_HIST, 'image_id, label')} SELECT image_id, label, {_GRAD_COLS} FROM st", "obj_px", "gray2"))
def gradient_features(s, d):
    return rounded(features.gradient_features(fx.obj_px(s, d), fx.gray2(s, d)))


@query(fx.sql(f"+ {_CANNY} SELECT image_id, label, count(*) FILTER (c.v > 0) AS canny_nonzero, round(avg(c.v), 6) AS canny_mean FROM obj_px JOIN can c USING (image_id, y, x) GROUP BY ALL", "obj_px", "gray2", recursive=True))
def canny_features(s, d):
    return rounded(features.canny_features(fx.obj_px(s, d), fx.gray2(s, d)))


_QUADS = f"""q AS (SELECT image_id, label, y + dy AS qy, x + dx AS qx, sum(bit) AS bits FROM obj_px CROSS JOIN (VALUES (0, 0, 1), (0, -1, 2), (-1, -1, 4), (-1, 0, 8)) c(dy, dx, bit) GROUP BY ALL),
    per AS (SELECT image_id, label, sum(CASE WHEN bits IN (5, 10) THEN {features.DIAGONAL}::DOUBLE WHEN bits IN (3, 6, 9, 12) THEN 1 WHEN bits = 15 THEN 0 ELSE {features.CORNER}::DOUBLE END) AS perimeter FROM q GROUP BY ALL)"""


@query(fx.sql(f"+ {_QUADS} SELECT image_id, label, round(perimeter, 6) AS perimeter FROM per", "obj_px"))
def perimeter(s, d):
    return rounded(features.perimeter(fx.obj_px(s, d)))


@query(fx.sql(f"""+ {_QUADS}, t AS (SELECT image_id, label, count(*) AS area, min(x) AS minx, max(x) AS maxx, min(y) AS miny, max(y) AS maxy, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM obj_px GROUP BY ALL),
    u AS (SELECT *, (area * sxx - sx * sx)::DOUBLE / (area::DOUBLE * area) + 1.0::DOUBLE / 12 AS xx, (area * syy - sy * sy)::DOUBLE / (area::DOUBLE * area) + 1.0::DOUBLE / 12 AS yy, (area * sxy - sx * sy)::DOUBLE / (area::DOUBLE * area) AS xy FROM t),
    w AS (SELECT *, sqrt(8.0::DOUBLE) * sqrt(greatest(xx + yy + sqrt((xx - yy) * (xx - yy) + 4 * xy * xy), 0)) AS major, sqrt(8.0::DOUBLE) * sqrt(greatest(xx + yy - sqrt((xx - yy) * (xx - yy) + 4 * xy * xy), 0)) AS minor FROM u)
    SELECT image_id, label, area, minx, maxx, miny, maxy, round(major, 6) AS major_axis, round(minor, 6) AS minor_axis, round(2 * sqrt(greatest((major * major - minor * minor) / 4, 0)) / major, 6) AS eccentricity,
    CASE WHEN (maxx - minx) * (maxy - miny) = 0 THEN 'inf'::DOUBLE ELSE round(area::DOUBLE / ((maxx - minx) * (maxy - miny)), 6) END AS extent_ratio, round(area::DOUBLE / ((maxx - minx + 1) * (maxy - miny + 1)), 6) AS extent_ratio_inclusive,
    round(perimeter, 6) AS perimeter, round(4 * {features.PI}::DOUBLE * area / (perimeter * perimeter), 6) AS circularity FROM w JOIN per USING (image_id, label)""", "obj_px"))
def shape_features(s, d):
    return rounded(features.shape_features(fx.obj_px(s, d)))


_RING = """ring AS (SELECT DISTINCT o.image_id, e.y, e.x, o.label FROM obj_px o JOIN emb_px e ON e.image_id = o.image_id AND (e.y - o.y) * (e.y - o.y) + (e.x - o.x) * (e.x - o.x) <= 64
    WHERE NOT EXISTS (SELECT 1 FROM obj_px p WHERE p.image_id = o.image_id AND p.label = o.label AND p.y = e.y AND p.x = e.x))"""


@query(fx.sql(f"+ {_RING} SELECT * FROM ring", "obj_px"))
def cytoplasm(s, d):
    return features.cytoplasm(fx.obj_px(s, d), fx.emb_px(s, d))


_RING_HIST = "SELECT image_id, label, g.v AS bin, count(*) AS cnt FROM ring JOIN gray2 g USING (image_id, y, x) GROUP BY ALL"
_RING_GRAD = "SELECT image_id, label, gr.v AS bin, count(*) AS cnt FROM ring JOIN gr USING (image_id, y, x) GROUP BY ALL"


@query(fx.sql(f"+ {_RING}, {_stats_sql(_RING_HIST, 'image_id, label')} SELECT image_id, label, mean, maximum, minimum, std, entropy, energy, skewness, kurtosis FROM st", "obj_px", "gray2"))
def cytoplasm_intensity(s, d):
    return rounded(features.intensity_features(features.cytoplasm(fx.obj_px(s, d), fx.emb_px(s, d)), fx.gray2(s, d)))


@query(fx.sql(f"+ {_RING}, {_GRADIENT}, {_stats_sql(_RING_GRAD, 'image_id, label')} SELECT image_id, label, {_GRAD_COLS} FROM st", "obj_px", "gray2"))
def cytoplasm_gradient(s, d):
    return rounded(features.gradient_features(features.cytoplasm(fx.obj_px(s, d), fx.emb_px(s, d)), fx.gray2(s, d)))


@query(fx.sql(f"+ {_RING}, {_CANNY} SELECT image_id, label, count(*) FILTER (c.v > 0) AS canny_nonzero, round(avg(c.v), 6) AS canny_mean FROM ring JOIN can c USING (image_id, y, x) GROUP BY ALL", "obj_px", "gray2", recursive=True))
def cytoplasm_canny(s, d):
    return rounded(features.canny_features(features.cytoplasm(fx.obj_px(s, d), fx.emb_px(s, d)), fx.gray2(s, d)))


_MATRIX = "SELECT l_returnflag AS k, CAST(l_quantity AS INT) AS i, CAST(l_linenumber AS INT) AS j, count(*) AS c FROM lineitem GROUP BY ALL"


@query(f"""WITH m AS ({_MATRIX}), t AS (SELECT k, sum(c)::DOUBLE AS n FROM m GROUP BY k), u AS (SELECT m.*, c / n AS p FROM m JOIN t USING (k)), a AS (SELECT k, sum(i * p) AS mx, sum(j * p) AS my FROM u GROUP BY k)
    SELECT u.k, round(sum((i - j) * (i - j) * p), 6) AS inertia, round(sum(p * p), 6) AS energy, round(sum(p * log2(p)), 6) AS entropy, round(sum(p / (1 + (i - j) * (i - j))), 6) AS homogeneity, round(max(p), 6) AS maximum_probability,
    round(any_value(mx), 6) AS mx, round(any_value(my), 6) AS my, round(sum(pow(1 + j - mx - my, 3) * p), 6) AS cluster_shade, round(sum(pow(1 + j - mx - my, 4) * p), 6) AS cluster_prominence FROM u JOIN a USING (k) GROUP BY u.k""")
def texture(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("k"), F.col("l_quantity").cast("int").alias("i"), F.col("l_linenumber").cast("int").alias("j"))
    matrix = li.groupBy("k", "i", "j").agg(F.count(F.lit(1)).alias("c"))
    return rounded(texture_features(matrix, ["k"]))


# --- logs and comparisons ---------------------------------------------------------------------------------------------


def _summary_sql(by: str) -> str:
    return fx.sql(f"""SELECT session, {by}, count(*) AS count, round(sum(end_us - start_us + 1) / count(*)::DOUBLE, 6) AS mean,
        CASE WHEN count(*) = 1 THEN -1 ELSE round(sqrt((count(*) * sum((end_us - start_us + 1) * (end_us - start_us + 1)) - sum(end_us - start_us + 1) * sum(end_us - start_us + 1))::DOUBLE) / count(*), 6) END AS stdev FROM ev_log GROUP BY ALL""", "ev_log")


@query(_summary_sql("name"))
def log_by_name(s, d):
    return rounded(eventlog.summary(fx.ev_log(s, d), "name"))


@query(_summary_sql("type"))
def log_by_type(s, d):
    return rounded(eventlog.summary(fx.ev_log(s, d), "type"))


_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query(fx.sql("SELECT session, " + ", ".join(
    f"""nullif(count(*) FILTER (name = '{n}'), 0) AS "{n} count", round(sum(end_us - start_us + 1) FILTER (name = '{n}') / nullif(count(*) FILTER (name = '{n}'), 0)::DOUBLE, 6) AS "{n} mean",
    CASE count(*) FILTER (name = '{n}') WHEN 0 THEN NULL WHEN 1 THEN -1 ELSE round(sqrt((count(*) FILTER (name = '{n}') * sum((end_us - start_us + 1) * (end_us - start_us + 1)) FILTER (name = '{n}')
    - sum(end_us - start_us + 1) FILTER (name = '{n}') * sum(end_us - start_us + 1) FILTER (name = '{n}'))::DOUBLE) / count(*) FILTER (name = '{n}'), 6) END AS "{n} stdev\"""" for n in _EVENT_TYPES) + " FROM ev_log GROUP BY session", "ev_log"))  # fmt: skip
def log_wide(s, d):
    wide = eventlog.wide_summary(fx.ev_log(s, d), "name", _EVENT_TYPES)
    return wide.select("session", *[(F.round(f"`{c}`", 6) if t == "double" else F.col(f"`{c}`")).alias(c) for c, t in wide.dtypes if c != "session"])


@query("SELECT event_id AS id, event_type AS name, 31 AS type, CAST(event_id AS BIGINT) AS start_us, CAST(event_id + user_id AS BIGINT) AS end_us, 'user ' || user_id AS annotation FROM events")
def log_events(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    note = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    return e.select(*eventlog.event(F.col("event_id"), F.col("event_type"), F.col("event_id"), F.col("event_id") + F.col("user_id"), note, "FILE_I"))


@query(fx.sql("""SELECT 'v2.1,' || min(start_us) || ',' || max(end_us) AS value FROM ev_log UNION ALL
    SELECT session || ',' || string_agg(name || ',' || type || ',' || (start_us + 1) || ',' || (end_us + 1), ';' ORDER BY start_us, end_us, name) FROM ev_log GROUP BY session""", "ev_log"))
def log_file(s, d):
    """A log written and read back as lines."""
    path = _folder(s, "log")
    logs.write_log(fx.ev_log(s, d), path)
    return s.read.text(path)


@query(fx.sql("SELECT session, name, count(*) AS count FROM ev_log GROUP BY ALL", "ev_log"))
def csv_file(s, d):
    """Values appended to a CSV file in two parts and read back."""
    path = _folder(s, "csv")
    values = fx.ev_log(s, d).groupBy("session", "name").agg(F.count(F.lit(1)).alias("count"))
    for part in (values.where("name < 'm'"), values.where("name >= 'm'")):
        logs.append_csv(part, path)
    return s.read.schema("session string, name string, count long").option("header", True).csv(path)


@query(fx.sql("SELECT session, string_agg(name || ',' || type || ',' || (start_us + 1) || ',' || (end_us + 1), ';' ORDER BY start_us, end_us, name) AS line FROM ev_log GROUP BY session", "ev_log"))
def log_sessions(s, d):
    return eventlog.session_lines(fx.ev_log(s, d))


@query("""WITH m AS (SELECT CAST(user_id AS VARCHAR) AS session, event_id AS ts, CASE event_id % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'start' ELSE 't0' END AS kind FROM events)
    SELECT *, coalesce(ts - last_value(CASE WHEN kind = 'log' THEN ts END IGNORE NULLS) OVER w, 0) AS since_log, coalesce(ts - last_value(CASE WHEN kind = 'start' THEN ts END IGNORE NULLS) OVER w, 0) AS since_start,
    coalesce(ts - last_value(CASE WHEN kind = 't0' THEN ts END IGNORE NULLS) OVER w, 0) AS since_t0 FROM m WINDOW w AS (PARTITION BY session ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def log_elapsed(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_id") % 3 == 0, "log").when(F.col("event_id") % 3 == 1, "start").otherwise("t0")
    return eventlog.elapsed(e.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("ts"), kind.alias("kind")))


@query(fx.sql("SELECT image_id, o.label AS a, CAST(g.v // 100 AS BIGINT) AS b, count(*) AS pixels FROM obj_px o JOIN gray2 g USING (image_id, y, x) GROUP BY ALL", "obj_px", "gray2"))
def compare_labels(s, d):
    other = fx.gray2(s, d).select(*PIXEL, F.floor(F.col("v") / 100).cast("long").alias("label"))
    return compare.label_pairs(fx.obj_px(s, d), other)


@query(fx.sql("""SELECT image_id, count(*) FILTER (e.v > 100 AND g.v > 100) AS common, count(*) FILTER (e.v > 100 AND NOT g.v > 100) AS only_first, count(*) FILTER (NOT e.v > 100 AND g.v > 100) AS only_second
    FROM emb_px e JOIN gray2 g USING (image_id, y, x) GROUP BY image_id HAVING count(*) FILTER (e.v > 100 OR g.v > 100) > 0""", "gray2"))
def pixel_sets(s, d):
    return compare.pixel_sets(fx.emb_px(s, d).where("v > 100"), fx.gray2(s, d).where("v > 100"))


@query(fx.sql("SELECT image_id, count(*) FILTER (e.v <> g.v) AS mismatches FROM emb_px e JOIN gray2 g USING (image_id, y, x) GROUP BY image_id", "gray2"))
def pixel_mismatches(s, d):
    return compare.mismatches(fx.emb_px(s, d), fx.gray2(s, d))


@query(fx.sql("SELECT * FROM gray2 WHERE v > 0", "gray2"))
def stream_compaction(s, d):
    return compare.compact(fx.gray2(s, d))


def _phantom_sql(size: int) -> str:
    """Disks in rows, the radius halving from row to row: pixels by row and value."""
    inside, top, radius = [], 0, size // 4
    while radius >= 1 and top + 2 * radius <= size:
        inside.append(f"(y >= {top} AND y < {top + 2 * radius} AND (y - {top + radius}) * (y - {top + radius}) + (x % {2 * radius} - {radius}) * (x % {2 * radius} - {radius}) < {radius * radius})")
        top, radius = top + 2 * radius, radius // 2
    return f"SELECT CAST(0 AS BIGINT) AS image_id, CAST(y AS INT) AS y, CASE WHEN {' OR '.join(inside)} THEN 255 ELSE 0 END AS v, count(*) AS n, sum(x) AS places FROM range({size}) a(y) CROSS JOIN range({size}) b(x) GROUP BY ALL"


@query(f"SELECT image_id, y, v, n, CAST(places AS BIGINT) AS places FROM ({_phantom_sql(4096)})")
def phantom(s, d):
    """All pixels of the phantom of 4096 x 4096, by row and value."""
    return size_phantom(s).groupBy("image_id", "y", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("places"))


# --- files ------------------------------------------------------------------------------------------------------------


def _folder(s: SparkSession, what: str) -> str:
    return f"{shared_dir(s)}/{what}-{uuid.uuid4().hex}"


@query(fx.sql("SELECT image_id, 'gray' AS stage, y, x, 0 AS channel, CAST(v AS DOUBLE) AS value FROM emb_px", "emb_px"))
def raw_files(s, d):
    """Images written as raw files and read back."""
    path = _folder(s, "raw")
    images.write_raw(fx.emb_px(s, d), path, "gray", ["v"])
    return images.read_raw(s, path, 8, 8)


@query(fx.sql("SELECT y, x, b, g, r FROM rgb_px", "rgb_px"))
def png_files(s, d):
    """A colour image written as a PNG file and read back by Spark's image source."""
    path = _folder(s, "png")
    images.write_png(fx.rgb_px(s, d), path, ["b", "g", "r"])
    return images.read_images(s, f"{path}/*", holes=True).select("y", "x", "b", "g", "r")


@query(fx.sql("SELECT y, x, v FROM mosaic", "mosaic"))
def pgm_files(s, d):
    """A gray image written as a PGM file and read back, by gray values."""
    path = _folder(s, "pgm")
    images.write_pgm(fx.mosaic(s, d), path)
    return images.read_pnm(s, f"{path}/*").select("y", "x", F.col("g").alias("v"))


@query(fx.sql("SELECT y, x, CAST(floor(least(greatest(0.298936021293776::DOUBLE*r + 0.587043074451121::DOUBLE*g + 0.114020904255103::DOUBLE*b, 0), 255) + 0.5) AS INT) AS v FROM rgb_px", "rgb_px"))
def gray_files(s, d):
    """A colour image read as a gray one."""
    path = _folder(s, "gray")
    images.write_png(fx.rgb_px(s, d), path, ["b", "g", "r"])
    return images.read_images(s, f"{path}/*", "gray", holes=True).select("y", "x", "v")


@query("SELECT unnest(['large', 'difference']) AS stage, unnest([true, true]) AS kept")
def stage_sink(s, d):
    """Which of the stages asked for the sink has kept tables of."""
    sink = images.StageSink(_folder(s, "stages"), {"large", "difference", "labels"})
    segmentation.candidates(fx.tissue_px(s, d), COLS, on_stage=sink)
    kept = [(name, not s.read.parquet(f"{sink.path}/{name}").isEmpty()) for name in sink.written]
    return s.createDataFrame(kept, "stage string, kept boolean")
