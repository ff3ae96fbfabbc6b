"""Image operators on small hand-made images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark import queries
from histospark.functions import pixels as p
from histospark.kernels import arrays as k
from histospark.kernels import arrays as kernels
from histospark.operators import compare, components, eventlog, features, geodesic, histogram, layout, neighbors, watershed
from histospark.plans import segmentation
from histospark.sources import fixtures, logs
from histospark.sources import images as io
from histospark.streaming import ingest


def px(spark, a, column="v", image=0):
    rows = [(image, y, x, int(v)) for (y, x), v in np.ndenumerate(np.array(a))]
    return spark.createDataFrame(rows, f"image_id long, y int, x int, {column} int")


def array(df, shape, column="v", fill=0):
    out = np.full(shape, fill)
    for r in df.collect():
        out[r["y"], r["x"]] = r[column]
    return out


def test_sizes_of_the_disks():
    assert len(neighbors.DISK17) == sum(2 * w + 1 for w in (0, 3, 5, 6, 6, 7, 7, 7, 8, 7, 7, 7, 6, 6, 5, 3, 0))
    assert len(neighbors.DISK19) == 2 * (11 + 13 + 15 + 17) + 11 * 19


def test_diagonal_pixels_join_by_eight_only(spark):
    img = px(spark, [[1, 0], [0, 1]])
    assert components.label(img, 2, 4).select("label").distinct().count() == 2
    assert components.label(img, 2, 8).select("label").distinct().count() == 1


@pytest.mark.parametrize("tile", [2, 5, 64])
@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels_do_not_depend_on_tiles(spark, tile, connectivity):
    a = np.random.default_rng(5).integers(0, 2, (11, 13))
    got = components.label(px(spark, a), 13, connectivity, tile=tile)
    assert np.array_equal(array(got, a.shape, "label", -1), k.label(a, connectivity))


def test_area_bounds_are_inclusive_and_exclusive(spark):
    a = [[1, 1, 1, 0, 1, 1, 0, 1]]
    labels = components.label(px(spark, a), 8, 8)
    assert {r["label"] for r in components.area_filter(labels, 2, 3).collect()} == {4}


def test_empty_and_full_images(spark):
    empty = px(spark, [[0, 0], [0, 0]])
    assert components.label(empty, 2, 8).count() == 0
    assert components.bounding_boxes(components.label(empty, 2, 8)).count() == 0
    full = components.bounding_boxes(components.label(px(spark, [[1, 1], [1, 1]]), 2, 4)).collect()
    assert [tuple(r) for r in full] == [(0, 0, 0, 1, 0, 1)]


@pytest.mark.parametrize("tile", [3, 64])
def test_reconstruction_does_not_depend_on_tiles(spark, tile):
    mask = np.random.default_rng(9).integers(0, 9, (8, 10))
    marker = np.where(np.arange(80).reshape(8, 10) % 17 == 0, mask, 0)
    both = px(spark, marker, "marker").join(px(spark, mask, "mask"), ["image_id", "y", "x"])
    assert np.array_equal(array(geodesic.reconstruct(both, 8, tile), mask.shape), k.reconstruct(marker.copy(), mask, 8))


def test_a_ring_is_filled_if_its_background_is_cut_off(spark):
    ring = np.array([[0, 0, 0, 0, 0], [0, 0, 255, 0, 0], [0, 255, 0, 255, 0], [0, 0, 255, 0, 0], [0, 0, 0, 0, 0]])
    assert array(geodesic.fill_holes(px(spark, ring), 5, 4), ring.shape)[2, 2] == 255
    assert array(geodesic.fill_holes(px(spark, ring), 5, 8), ring.shape)[2, 2] == 0


def test_statistics_of_one_and_three_pixels(spark):
    hist = spark.createDataFrame([(0, 1, 9, 1), (0, 2, 4, 1), (0, 2, 5, 1), (0, 2, 8, 1)], "image_id long, label long, bin int, cnt long")
    one, three = sorted(histogram.statistics(hist).collect(), key=lambda r: r["label"])
    assert (one["median"], one["first_quartile"], one["std"], one["skewness"], one["kurtosis"]) == (0, 0, 0.0, 0.0, 0.0)
    assert (three["median"], three["first_quartile"], three["third_quartile"], three["minimum"], three["maximum"]) == (4, 0, 5, 4, 8)


def test_shape_of_thin_objects(spark):
    line = spark.createDataFrame([(0, 0, x, 1) for x in range(4)], "image_id long, y int, x int, label long")
    r = features.shape_features(line).first()
    assert r["extent_ratio"] == float("inf") and r["extent_ratio_inclusive"] == 1.0 and abs(r["perimeter"] - (6 + 4 * 0.70710678118)) < 1e-9


def test_deconvolution_of_white_is_white(spark):
    white = spark.createDataFrame([(255, 255, 255)], "b int, g int, r int")
    h, e = p.color_deconv(F.col("b"), F.col("g"), F.col("r"), [[0.65, 0.07, 0], [0.7, 0.99, 0], [0.29, 0.11, 0]])
    assert tuple(white.select(h, e).first()) == (255, 255)
    assert p.unmixing([[1, 0, 0], [0, 1, 0], [0, 0, 0]]).shape == (2, 3)


def test_pointwise_kinds():
    with pytest.raises(ValueError):
        p.invert(None, "complex")


def test_borders_and_crops_undo_each_other(spark):
    a = np.arange(12).reshape(3, 4)
    framed = layout.make_border(px(spark, a), 2, 1, 1, 3, -1)
    assert framed.count() == 6 * 8 and np.array_equal(array(layout.crop(framed, 2, 1, 3, 4), a.shape), a)


def test_log_summaries(spark):
    log = spark.createDataFrame([("s", "a", 0, 0, 9), ("s", "a", 0, 5, 24), ("s", "b", 11, 0, 0)], "session string, name string, type int, start_us long, end_us long")
    by = {r["name"]: r for r in eventlog.summary(log).collect()}
    assert (by["a"]["count"], by["a"]["mean"], by["a"]["stdev"], by["b"]["stdev"]) == (2, 15.0, 5.0, -1.0)
    assert eventlog.wide_summary(log, "name", ["a", "b"]).first()["a_count"] == 2


def test_label_images_are_the_same_up_to_names(spark):
    one, two = px(spark, [[1, 1, 2]], "label"), px(spark, [[7, 7, 3]], "label")
    assert compare.same_up_to_names(one, two).first()["same"]
    assert not compare.same_up_to_names(one, px(spark, [[7, 3, 3]], "label")).first()["same"]


def blobs():
    """A pale tile with dark round nuclei, two of which touch."""
    yy, xx = np.mgrid[0:72, 0:72]
    nuclei = np.zeros((72, 72), bool)
    for y, x in ((16, 16), (48, 20), (48, 31), (20, 54)):
        nuclei |= (yy - y) ** 2 + (xx - x) ** 2 <= 36
    return nuclei


def test_segmentation_finds_the_nuclei(spark, tmp_path):
    nuclei = blobs()
    rows = [(0, y, x, 140, 60, 60) if nuclei[y, x] else (0, y, x, 200, 180, 215) for y in range(72) for x in range(72)]
    tile = spark.createDataFrame(rows + [(1, y, x, 250, 250, 250) for y in range(72) for x in range(72)], "image_id long, y int, x int, b int, g int, r int")
    sink = io.StageSink(str(tmp_path / "stages"), {"difference", "labels"})
    labels, boxes, status = segmentation.segment_nuclei(tile, 72, on_stage=sink)
    assert {r["image_id"]: r["status"] for r in status.collect()} == {0: 0, 1: 1}
    assert boxes.count() in (3, 4) and sorted(sink.written) == ["difference", "labels"]
    found = array(labels.where("image_id = 0"), (72, 72), "label") > 0
    assert (found & nuclei).sum() > 0.8 * nuclei.sum() and (found & ~nuclei).sum() < 0.2 * nuclei.sum()
    gray = tile.where("image_id = 0").select("image_id", "y", "x", F.col("b").alias("v"))
    assert features.all_features(labels, gray).count() == boxes.count()


def test_watersheds_run_on_flat_images(spark):
    flat = px(spark, np.zeros((5, 5), int)).withColumns({c: F.lit(0) for c in "bgr"})
    assert watershed.watershed(flat).count() == 25
    assert watershed.drop_of_water(flat).select("label").distinct().count() == 1
    assert watershed.cheapest_paths(flat).select("label").distinct().count() == 1


def test_images_from_files(spark, tmp_path):
    (tmp_path / "a.ppm").write_bytes(b"P6\n# c\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "b.pgm").write_text("P2\n1 2\n9\n7 8\n")
    rows = {(r["path"][-5:], r["y"], r["x"]): (r["b"], r["g"], r["r"]) for r in io.read_pnm(spark, str(tmp_path / "*.p?m")).collect()}
    assert rows == {("a.ppm", 0, 0): (3, 2, 1), ("a.ppm", 0, 1): (6, 5, 4), ("b.pgm", 0, 0): (7, 7, 7), ("b.pgm", 1, 0): (8, 8, 8)}
    img = px(spark, [[5, 6], [7, 8]])
    io.write_pgm(img, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["P2", "2 2", "255", "5 6", "7 8"]
    io.write_raw(img, str(tmp_path / "raw"), "gray", ["v"])
    raw = next((tmp_path / "raw" / f"name={io.raw_name('0', 'gray', '8UC1')}").glob("part-*"))
    assert raw.read_bytes()[:4] == bytes([5, 6, 7, 8])
    bytes_ = px(spark, np.arange(256).reshape(16, 16))
    io.write_raw(bytes_, str(tmp_path / "all"), "gray", ["v"])
    assert {(r["y"] * 16 + r["x"], r["value"]) for r in io.read_raw(spark, str(tmp_path / "all"), 16, 16).collect()} == {(i, float(i)) for i in range(256)}


def test_png_by_the_image_source(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    body = zlib.compress(b"\0" + bytes([10, 20, 30, 40, 50, 60]))
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b""))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {(r["y"], r["x"]): (r["b"], r["g"], r["r"]) for r in io.read_images(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): (30, 20, 10), (0, 1): (60, 50, 40)}
    assert sorted(r["status"] for r in io.read_status(spark, str(tmp_path)).collect()) == [-1, 4]
    done = segmentation.segment_files(spark, str(tmp_path), str(tmp_path / "out"))
    assert sorted(r["status"] for r in done.collect()) == [-1, 3]


def test_logs_to_files(spark, tmp_path):
    log = spark.createDataFrame([("s", "a", 0, 3, 9), ("t", "b", 1, 5, 6)], "session string, name string, type int, start_us long, end_us long")
    logs.write_log(log, str(tmp_path / "log"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()) == ["s,a,0,4,10", "t,b,1,6,7", "v2.1,3,9"]


def test_new_images_as_a_stream(spark, tmp_path):
    px(spark, [[1, 0], [0, 1]]).write.parquet(str(tmp_path / "in"))
    stream = ingest.pixel_stream(spark, str(tmp_path / "in"), "image_id long, y int, x int, v int")
    query = ingest.process(stream, lambda df: components.label(df, 2, 8), str(tmp_path / "out"), str(tmp_path / "state"), once=True)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("label").distinct().count() == 1


def traced(mask):
    """The boundary of a component's outer contour by walking around it: its points, and twice the area within their line."""
    h, w = mask.shape
    at = lambda y, x: 0 <= y < h and 0 <= x < w and mask[y, x]
    ring = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    y, x = next(zip(*np.nonzero(mask), strict=True))
    start, came, points, first = (y, x), 4, [], None
    while True:
        step = next((k for k in range(came + 1, came + 9) if at(y + ring[k % 8][0], x + ring[k % 8][1])), None)
        if step is None:
            return 1, 0
        move = ((y, x), step % 8)
        if move == first:
            break
        first = first or move
        points.append((y, x))
        y, x, came = y + ring[step % 8][0], x + ring[step % 8][1], (step + 4) % 8
    assert points[0] == start
    twice = sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(points, points[1:] + points[:1], strict=True))
    return len(points), abs(twice)


def test_contours_against_tracing(spark):
    rng = np.random.default_rng(7)
    masks = [rng.random((9, 9)) < 0.55 for _ in range(25)] + [np.ones((5, 7), bool), np.eye(6, dtype=bool), np.ones((1, 1), bool), np.ones((1, 6), bool)]
    ring = np.ones((7, 7), bool)
    ring[2:5, 2:5] = False
    masks.append(ring)
    for k, mask in enumerate(masks):
        parts = kernels.label(mask.astype(int), 8)
        for root in np.unique(parts[parts >= 0]):
            one = parts == root
            area, filled, polygon, points, net = kernels.contour_measures(one)
            solid = kernels.outer_filled(one)
            n, twice = traced(solid)
            assert (2 * polygon, filled, area) == (twice, solid.sum(), one.sum()), k
            assert points == (n if filled > 1 else 0)
            if area == filled:
                assert net == round(polygon) + points // 2 + 1
    # The ring's line is 6 x 6 with 24 points, that around its hole 4 x 4 less its corners with 12 points.
    assert kernels.contour_measures(ring) == (40, 49, 36.0, 24, 36 + 12 + 1 - (14 + 6 + 1))


def test_tiles_and_strips_agree_with_whole_images(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 256, (23, 31))
    image = px(spark, v)
    whole, cut = (array(watershed.canny(image, tile=t), v.shape) for t in (None, 8))
    assert (whole == cut).all() and 0 < whole.sum() < whole.size * 255
    blobs = px(spark, (v > 30).astype(int))
    far = array(geodesic.distance(blobs, strip=5), v.shape, fill=0.0)
    assert np.allclose(far**2, kernels.squared_distance((v > 30).astype(int)))
    assert set(array(geodesic.distance(px(spark, np.ones((6, 6), int)), strip=2), (6, 6)).ravel()) == {-1}


def test_nested_contours_have_the_label_of_the_outermost(spark):
    m = np.zeros((12, 12), int)
    m[1:9, 1:9], m[2:8, 2:8], m[4:6, 4:6], m[10, 10] = 1, 0, 1, 1
    got = array(components.label_contours(px(spark, m).where("v = 1"), 12, 8), m.shape, "label")
    want = np.zeros((12, 12), int)
    want[1:9, 1:9], want[10, 10] = 1, 2
    assert (got == want).all()


def test_marks_of_edges_are_not_joined_by_way_of_the_driver(spark):
    """Files of marks are small beside their rows; so are these, of any size, beside the bound for such joins."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 30))
    try:
        image = px(spark, np.random.default_rng(4).integers(0, 256, (16, 16)))
        edges = watershed.canny(image, tile=8)
        plan = edges._jdf.queryExecution().executedPlan().toString()
        whole = array(watershed.canny(image), (16, 16))
        assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 0
        assert (array(edges, (16, 16)) == whole).all()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


#: Lines that end early, begin late, have a gap, and are missing.
RAGGED = [(0, 0, 5), (0, 1, 6), (0, 2, 7), (1, 0, 8), (2, 1, 0), (2, 2, 9), (4, 0, 4), (4, 2, 3)]


def test_pgm_of_an_image_without_some_pixels(spark, tmp_path):
    image = spark.createDataFrame([(3, *p) for p in RAGGED], "image_id long, y int, x int, v int")
    io.write_pgm(image, str(tmp_path / "pgm"))
    got = io.read_pnm(spark, str(tmp_path / "pgm" / "*")).collect()
    assert sorted((r["y"], r["x"], r["b"], r["g"], r["r"]) for r in got) == [(y, x, v, v, v) for y, x, v in RAGGED]


def test_png_of_an_image_without_some_pixels(spark, tmp_path):
    image = spark.createDataFrame([(3, y, x, v, v + 10, v + 20) for y, x, v in RAGGED], "image_id long, y int, x int, b int, g int, r int")
    io.write_png(image, str(tmp_path / "png"), ["b", "g", "r"])
    got = io.read_images(spark, str(tmp_path / "png" / "*"), holes=True).collect()
    assert sorted((r["y"], r["x"], r["b"], r["g"], r["r"]) for r in got) == [(y, x, v, v + 10, v + 20) for y, x, v in RAGGED]
    io.write_png(image, str(tmp_path / "gray"), ["g"])
    got = io.read_images(spark, str(tmp_path / "gray" / "*"), "gray", holes=True).collect()
    assert sorted((r["y"], r["x"], r["v"]) for r in got) == [(y, x, v + 10) for y, x, v in RAGGED]


@pytest.mark.parametrize("name", ["png_files", "pgm_files", "gray_files"])
def test_files_of_a_mosaic_whose_last_row_is_not_full(spark, tmp_path, name):
    spark.range(27).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> CAST(((id * 64 + i) % 101 - 50) / 100 AS FLOAT)) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES[name](spark, str(tmp_path))
    px = fixtures.rgb_px(spark, str(tmp_path))
    want = {"png_files": px.select("y", "x", "b", "g", "r"), "pgm_files": px.selectExpr("y", "x", "r AS v"), "gray_files": px.select("y", "x", p.bgr2gray(F.col("b"), F.col("g"), F.col("r")).alias("v"))}[name]
    assert got.count() == 27 * 64 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
