"""Images as pixel relations: readers, writers, and the intermediate-result sink."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pixels import bgr2gray
from ..schema import PIXEL

#: Type tags of raw files by numpy type.
DEPTHS = {"uint8": "8U", "int8": "8S", "uint16": "16U", "int16": "16S", "int32": "32S", "float32": "32F", "float64": "64F"}
#: Pixels of an image that are turned into rows at a time.
ROWS = 1 << 18
COLOUR = "image_id long, path string, y int, x int, b int, g int, r int"


def _image_id():
    """A stable id of a file: from its path, not from the order of listing."""
    return F.xxhash64("path")


def _in_batches(image: int, name: str, a: np.ndarray, channels: list[int], present: np.ndarray | None = None):
    """(number of rows, columns of image_id, path, y, x and ``channels`` of ``a``) for some ROWS of an image's pixels at a time, by lines; with ``present``
    only for the pixels that it marks."""
    h, w = a.shape[:2]
    for top in range(0, h, max(1, ROWS // w)):
        part = a[top : top + max(1, ROWS // w)]
        y, x = np.nonzero(np.ones(part.shape[:2], bool) if present is None else present[top : top + len(part)])
        n = len(y)
        same = [pa.array(np.full(n, image), pa.int64()), pa.array([name]).take(pa.array(np.zeros(n, np.int64)))]
        yield n, [*same, *[pa.array(v, pa.int32()) for v in (y + top, x, *(part[y, x, c] for c in channels))]]


def read_images(spark: SparkSession, path: str, mode: str = "colour", holes: bool = False) -> DataFrame:
    """PNG, JPEG, BMP by Spark's image source: pixels with b, g, r (``colour``), or v (``gray``), or as stored (``unchanged``: v of gray images, else b, g, r
    of which v is null). With ``holes``, fully transparent pixels are left out, as ``write_png`` marks those that an image hasn't got. Files that can't be
    read give no pixels; see ``read_status``."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*").withColumnRenamed("origin", "path")
    names = ["image_id", "path", "y", "x", "b", "g", "r", "c"]

    def decoded(batches):
        """The rows of one image at a time, some ROWS of its lines in a batch."""
        for batch in batches:
            for image, name, h, w, channels, data in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                a = np.frombuffer(data, np.uint8).reshape(h, w, channels)
                present = a[:, :, 3] > 0 if holes and channels == 4 else None
                for n, columns in _in_batches(image, name, a, [0, 1, 2] if channels >= 3 else [0, 0, 0], present):
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(n, channels >= 3))], names)

    px = raw.select(_image_id().alias("image_id"), "path", "height", "width", "nChannels", "data").mapInArrow(decoded, COLOUR + ", c boolean")
    if mode == "colour":
        return px.drop("c")
    if mode == "gray":
        return px.select(*PIXEL, "path", F.when(F.col("c"), bgr2gray(F.col("b"), F.col("g"), F.col("r"))).otherwise(F.col("b")).alias("v"))
    if mode == "unchanged":
        return px.select(*PIXEL, "path", "b", "g", "r", F.when(~F.col("c"), F.col("b")).alias("v"))
    raise ValueError(f"mode is colour, gray or unchanged, not {mode}")


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, path, status): -1 for files that are no image, else 4 (go on)."""
    raw = spark.read.format("image").load(path).select("image.*").withColumnRenamed("origin", "path")
    return raw.select(_image_id().alias("image_id"), "path", F.when(F.col("height") > 0, 4).otherwise(-1).alias("status"))


def parse_pnm(data: bytes) -> np.ndarray:
    """(h, w, channels) of a PBM, PGM or PPM file, plain or raw."""
    tokens, at = [], 0
    kind = data[:2].decode()
    need = 2 if kind in ("P1", "P4") else 3
    at = 2
    while len(tokens) < need:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        tokens.append(int(data[at:end]))
        at = end
    w, h = tokens[:2]
    channels = 3 if kind in ("P3", "P6") else 1
    body = data[at + 1 :]
    if kind == "P4":
        bits = np.unpackbits(np.frombuffer(body, np.uint8, h * (-(-w // 8))).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits.astype(int))[:, :, None] * 255
    if kind in ("P5", "P6"):
        wide = np.dtype(">u2") if tokens[2] > 255 else np.dtype("u1")
        return np.frombuffer(body, wide, h * w * channels).reshape(h, w, channels).astype(int)
    if kind == "P1":
        digits = [c for c in body if c in b"01"]
        return (1 - (np.array(digits[: h * w]) - 48)).reshape(h, w, 1) * 255
    return np.fromstring(body, int, h * w * channels, sep=" ").reshape(h, w, channels)


#: Comment in the head of a PGM file for pixels of a line that the image hasn't got: y, first x, number.
ABSENT = "# absent"


def _absent(present: bytes | None, h: int, w: int) -> list[str]:
    """The comments on the pixels that an image of ``as_blobs`` hasn't got."""
    if present is None:
        return []
    steps = np.diff(np.pad(np.frombuffer(present, bool).reshape(h, w), ((0, 0), (1, 1)), constant_values=True).astype(np.int8), axis=1)
    (ys, starts), (_, ends) = np.nonzero(steps < 0), np.nonzero(steps > 0)
    return [f"{ABSENT} {y} {x} {end - x}" for y, x, end in zip(ys.tolist(), starts.tolist(), ends.tolist(), strict=True)]


def _present(data: bytes, shape: tuple[int, int]) -> np.ndarray | None:
    """Which pixels of a PNM file the image has got; None: all."""
    runs = [[int(i) for i in m.groups()] for m in re.finditer(rb"^%s (\d+) (\d+) (\d+)$" % ABSENT.encode(), data, re.MULTILINE)] if data[:2] == b"P2" else []
    out = np.ones(shape, bool) if runs else None
    for y, x, n in runs:
        out[y, x : x + n] = False
    return out


def read_pnm(spark: SparkSession, path: str) -> DataFrame:
    """Colour pixels of PNM files (channels are red, green, blue in the file; gray ones count three times), without those that ``write_pgm`` notes as absent."""

    def parsed(batches):
        for batch in batches:
            for image, name, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a = parse_pnm(content)
                for _, columns in _in_batches(image, name, a, [min(c, a.shape[2] - 1) for c in (2, 1, 0)], _present(content, a.shape[:2])):
                    yield pa.RecordBatch.from_arrays(columns, ["image_id", "path", "y", "x", "b", "g", "r"])

    files = spark.read.format("binaryFile").load(path).select(_image_id().alias("image_id"), "path", "content")
    return files.mapInArrow(parsed, COLOUR)


def as_blobs(px: DataFrame, columns: list[str], dtype: str = "uint8") -> DataFrame:
    """(image_id, h, w, tag, content, present): each image as one row of row-major interleaved values, tagged like 8UC3. Pixels that it hasn't got are 0, and
    ``present`` then is a byte for each pixel, else null."""
    tag = f"{DEPTHS[dtype]}C{len(columns)}"

    def packed(t: pa.Table) -> pa.Table:
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        out = np.zeros((int(y.max()) + 1, int(x.max()) + 1, len(columns)), dtype)
        for c, name in enumerate(columns):
            out[y, x, c] = t.column(name).to_numpy()
        present = np.zeros(out.shape[:2], bool)
        present[y, x] = True
        marks = None if present.all() else present.tobytes()
        return pa.table({"image_id": pa.array([t.column("image_id")[0].as_py()], pa.int64()), "h": pa.array([out.shape[0]], pa.int32()), "w": pa.array([out.shape[1]], pa.int32()), "tag": [tag], "content": pa.array([out.tobytes()], pa.binary()), "present": pa.array([marks], pa.binary())})

    return px.select(*PIXEL, *columns).groupBy("image_id").applyInArrow(packed, "image_id long, h int, w int, tag string, content binary, present binary")


def raw_name(prefix: str, stage: str, tag: str) -> str:
    return f"{prefix}-{stage}.{tag}.raw"


def _write_files(blobs: DataFrame, path: str) -> None:
    """A file for each row (name, content) below ``path``, in a folder ``name=<name>``, by Spark's text sink, which writes a line break after
    the content. Any file system and a lost task's second attempt are the sink's business."""
    blobs.select("name", F.col("content").cast("string").alias("value")).write.mode("append").partitionBy("name").text(path)


def write_raw(px: DataFrame, path: str, stage: str, columns: list[str], dtype: str = "uint8") -> None:
    """Images as files of row-major interleaved values without a header, in folders named like ``name=7-gray.8UC1.raw``."""
    blobs = as_blobs(px, columns, dtype)
    name = F.concat(F.col("image_id").cast("string"), F.lit(f"-{stage}."), F.col("tag"), F.lit(".raw"))
    _write_files(blobs.select(name.alias("name"), "content"), path)


def read_raw(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """(image_id, stage, y, x, channel, value) of the files that ``write_raw`` wrote, all of one size; their names say the type."""
    depths = {tag: dtype for dtype, tag in DEPTHS.items()}
    names = ["image_id", "stage", "y", "x", "channel", "value"]

    def parsed(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image, stage, depth, channels = re.search(r"name=(-?\d+)-(.*)\.(\d+[USF])C(\d+)\.raw/", file).groups()
                n = int(channels)
                values = np.frombuffer(content, depths[depth], height * width * n)
                y, x, c = (i.ravel() for i in np.mgrid[0:height, 0:width, 0:n])
                columns = [pa.array(np.full(len(y), int(image)), pa.int64()), pa.array([stage] * len(y)), *[pa.array(i, pa.int32()) for i in (y, x, c)], pa.array(values.astype(float))]
                yield pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(parsed, "image_id long, stage string, y int, x int, channel int, value double")


def png_bytes(a: np.ndarray) -> bytes:
    """A PNG of 8-bit values (h, w, 1: gray, 3: red, green, blue, or 4: and opacity)."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    h, w, channels = a.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), a.astype(np.uint8).reshape(h, -1)], axis=1)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def write_png(px: DataFrame, path: str, columns: list[str]) -> None:
    """Images as PNG files, in folders ``name=<image_id>.png``; ``columns`` are one gray plane, or blue, green and red. An image that hasn't got all pixels of
    its rectangle is written in colours with opacity, 0 where there is none and 255 elsewhere."""

    def packed(batches):
        for batch in batches:
            names, out = [], []
            for image, h, w, content, present in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                planes = np.frombuffer(content, np.uint8).reshape(h, w, len(columns))[:, :, ::-1]
                if present is not None:
                    opacity = np.frombuffer(present, np.uint8).reshape(h, w, 1) * np.uint8(255)
                    planes = np.concatenate([*[planes] * (3 // len(columns)), opacity], axis=2)
                names.append(f"{image}.png")
                out.append(png_bytes(planes))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], ["name", "content"])

    _write_files(as_blobs(px, columns).select("image_id", "h", "w", "content", "present").mapInArrow(packed, "name string, content binary"), path)


def write_pgm(px: DataFrame, path: str, column: str = "v") -> None:
    """Gray images as plain PGM text, one directory entry per image, by Spark's text sink. Pixels that an image hasn't got are 0, and comments (ABSENT) say
    which they are."""

    def packed(batches):
        for batch in batches:
            images, out = [], []
            for image, h, w, content, present in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                lines = (" ".join(map(str, line.tolist())) for line in np.frombuffer(content, np.int32).reshape(h, w))
                images.append(image)
                out.append("\n".join(["P2", *_absent(present, h, w), f"{w} {h}", "255", *lines]))
            yield pa.RecordBatch.from_arrays([pa.array(images, pa.int64()), pa.array(out, pa.string())], ["image_id", "value"])

    blobs = as_blobs(px, [column], "int32").select("image_id", "h", "w", "content", "present")
    blobs.mapInArrow(packed, "image_id long, value string").write.partitionBy("image_id").mode("overwrite").text(path)


class StageSink:
    """Keeps the intermediate results of chosen stages: call it with a stage's name and table. ``written`` lists what was kept."""

    def __init__(self, path: str, stages: set[str] | None = None) -> None:
        self.path, self.stages, self.written = path, stages, []

    def __call__(self, stage: str, df: DataFrame) -> None:
        if self.stages is None or stage in self.stages:
            df.write.mode("overwrite").parquet(f"{self.path}/{stage}")
            self.written.append(stage)


def size_phantom(spark: SparkSession, size: int = 4096, largest: int | None = None) -> DataFrame:
    """(image_id, y, x, v): disks in rows, the radius halving from row to row, 255 inside."""
    radius = largest or size // 4
    cells = spark.range(size * size).select(F.lit(0).cast("long").alias("image_id"), F.floor(F.col("id") / size).cast("int").alias("y"), (F.col("id") % size).cast("int").alias("x"))
    inside, top = F.lit(False), 0
    while radius >= 1 and top + 2 * radius <= size:
        dy = F.col("y") - (top + radius)
        dx = F.col("x") % (2 * radius) - radius
        band = (F.col("y") >= top) & (F.col("y") < top + 2 * radius)
        inside = inside | (band & (dy * dy + dx * dx < radius * radius))
        top, radius = top + 2 * radius, radius // 2
    return cells.select(*PIXEL, F.when(inside, 255).otherwise(0).alias("v"))
