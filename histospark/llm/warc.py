"""WARC archives: writing, reading back, and one global index of captures.

Pages become records of WARC/1.1 and are written by Spark's text sink with the record separator as line separator, gzipped,
on whatever file system holds the shared folder; a lost task writes its files again. Payload copies become revisits of
the record with the smallest id. Each archive is then read and parsed on its own; its index entries, sorted by URL key
and date, are a run. Entries are dealt to key ranges and in each range the runs' parts are merged by a loser tree, so
that the histories of all captures are in one order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from bisect import bisect_right
from math import ceil
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import shared_path, stored

ARCHIVE_BYTES = 32 << 20
#: Pages of more than so many times the mean size go to archives of their own.
LARGE = 8
ENTRIES_PER_RANGE = 20_000
#: About so many keys are brought to the driver to balance ranges, of which there are a quarter as many at most.
SPLIT_SAMPLE = 40_000
SALTS = 128
ENTRY = "page_id long, url string, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, record_offset long"


def base32_sha1(content: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string's bytes: 40 bits at a time are eight digits of base 32."""
    digest = F.sha1(content)
    eight = [F.lpad(F.conv(F.substring(digest, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31)]
    return F.translate(F.concat(*eight), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: Column) -> Column:
    """A record id that carries the page id; a null id has another first group."""
    digits = F.lpad(F.hex(F.coalesce(page_id, F.lit(0))), 16, "0")
    head = F.when(page_id.isNull(), "ffffffff").otherwise("00000000")
    return F.concat(F.lit("<urn:uuid:"), head, F.lit("-0000-4000-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 12), F.lit(">"))


def _page_of(urn: str) -> int | None:
    group = urn[10:-1].split("-")
    n = int(group[3] + group[4], 16)
    return None if group[0] == "ffffffff" else n - (1 << 64) * (n >> 63)


def _record() -> Column:
    """The text of a record; what ends it is the sink's line separator."""
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(F.col("_revisit"), "").otherwise(F.col("_payload")))
    revisit = F.concat(
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _urn(F.col("_original")))
    )
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("_revisit"), "revisit").otherwise("response"),
        line("WARC-Record-ID", _urn(F.col("_id"))), line("WARC-Date", F.col("_date")), line("WARC-Target-URI", F.col("_url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))), F.when(F.col("_revisit"), revisit).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n\r\n"), block,
    )


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None) -> str:
    """Write a record per row of ``pages`` and return the folder of the archives.

    Of records with equal payloads of ``min_bytes`` or more, that with the smallest id is the response, and the others
    revisit it. Null payloads are empty. Without ``date_col`` (a timestamp) dates follow from ids. Copies are found by digest, a
    second hash and length, with salted keys: ids and hashes are aggregated first, and payloads move once. An archive is some ARCHIVE_BYTES: those
    of pages up to LARGE times the mean size LARGE times that at most, those of larger ones no more than the largest page needs.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    page = F.col(id_col).cast("long")
    moment = F.col(date_col) if date_col else F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(F.coalesce(page, F.lit(0)), F.lit(1_000_000_000)))
    rows = pages.select(
        page.alias("_id"), payload.alias("_payload"), F.octet_length(payload).cast("long").alias("_bytes"),
        base32_sha1(payload).alias("_digest"), F.xxhash64(payload).alias("_lane"),
        F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("_date"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20").alias("_url"),
        F.pmod(F.xxhash64(page), F.lit(SALTS)).alias("_salt"),
    )
    key = ["_digest", "_lane", "_bytes"]
    partial = rows.groupBy(*key, "_salt").agg(F.min("_id").alias("_least"))
    total = partial.groupBy(*key).agg(F.min("_least").alias("_original"))
    spread = stored(partial.join(total, key).select(*key, "_salt", "_original"), "payload-groups")
    decided = rows.join(spread, [*key, "_salt"])
    revisit = (F.col("_bytes") >= min_bytes) & ~F.col("_id").eqNullSafe(F.col("_original"))
    n, size, most = rows.agg(F.count(F.lit(1)), F.sum("_bytes"), F.max("_bytes")).first()
    path, mean = shared_path(pages.sparkSession, "warc"), (size or 0) / max(n, 1) + 500
    small = F.col("_bytes") <= int(LARGE * mean)

    def written(part: DataFrame, record_bytes: float) -> None:
        out = part.withColumn("_revisit", revisit).select(_record().alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        out.option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / record_bytes))).mode("append").text(path)

    written(decided.where(small), mean)
    if (most or 0) > int(LARGE * mean):
        written(decided.where(~small), most + 2000)
    return path


def parse_records(data: bytes):
    """(offset, headers, block) of the records of an archive's bytes; ValueError where they aren't well formed."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no record at {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        block = data[end + 4 : end + 4 + int(headers["Content-Length"])]
        after = end + 4 + len(block)
        if data[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} doesn't end as its length says")
        yield at, headers, block
        at = after + 4


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the right, without www, then path and query; lower case."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return url.lower()
    labels = [x for x in host.split(".") if x]
    if labels and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    return (",".join(reversed(labels)) + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")).lower()


def _entry(offset: int, headers: dict[str, str], block: bytes, archive: str) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size, digest = int(http["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{archive}, record at {offset}: the payload isn't what the headers say")
    refers = _page_of(headers["WARC-Refers-To"]) if kind == "revisit" else None
    url = headers["WARC-Target-URI"]
    return _page_of(headers["WARC-Record-ID"]), url, url_key(url), headers["WARC-Date"], kind, size, digest, refers, archive, offset


def index_runs(spark, path: str) -> DataFrame:
    """The sorted run of index entries of each archive below ``path``: ENTRY and the place ``seq`` in the run. Archives are of about
    ARCHIVE_BYTES; one is in memory at a time. Responses' payloads are held against length and digest."""
    names = [c.split()[0] for c in ENTRY.split(", ")] + ["seq"]

    def indexed(batches):
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                run = sorted((_entry(o, h, b, archive) for o, h, b in parse_records(data)), key=_order)
                if run:
                    columns = [*map(list, zip(*run, strict=True)), list(range(len(run)))]
                    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(indexed, ENTRY + ", seq long")


def _order(entry: tuple) -> tuple:
    """Key of an entry: URL key, date, and the page id and place that part equal ones."""
    return entry[2], entry[3], -1 << 63 if entry[0] is None else entry[0], entry[8], entry[9]


class LoserTree:
    """Merges sorted lists. Inner nodes hold the loser of the match of their two subtrees; the overall winner is apart, so the
    next one takes a match for each level of the path of the last winner."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.at, self.n = runs, [0] * len(runs), max(1, len(runs))
        self.loser = [-1] * self.n
        winners = [-1] * self.n + list(range(len(runs)))
        for node in range(self.n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.loser[node] = (a, b) if self._wins(a, b) else (b, a)
        self.winner = winners[1] if self.n > 1 else 0

    def _wins(self, a: int, b: int) -> bool:
        """Whether run a's next comes before run b's; runs that are over lose."""
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or self.runs[a][self.at[a]] <= self.runs[b][self.at[b]]

    def __iter__(self):
        while self.runs and self.at[self.winner] < len(self.runs[self.winner]):
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            node = (w + self.n) // 2
            while node:
                if self._wins(self.loser[node], w):
                    w, self.loser[node] = self.loser[node], w
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame) -> DataFrame:
    """The entries of all runs with ``capture_order``, which rises with URL key, date and id over all of them.

    Range bounds come from about SPLIT_SAMPLE keys, chosen by a hash of archive and place; they only balance the work. A range holds about
    ENTRIES_PER_RANGE entries, or, where that would need more than SPLIT_SAMPLE / 4 ranges, a share of all, and one URL with many
    captures has as many ranges as it needs.
    """
    n = runs.count()
    key = ["url_key", "captured", "page_id", "archive", "record_offset"]
    step = max(1, n // SPLIT_SAMPLE)
    some = runs.where(F.pmod(F.xxhash64("archive", "seq"), F.lit(step)) == 0).select(*key).collect()
    sample = sorted(_order((p, None, u, t, *[None] * 4, a, o)) for u, t, p, a, o in some)
    ranges = min(max(1, ceil(n / ENTRIES_PER_RANGE)), SPLIT_SAMPLE // 4)
    bounds = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    shared = runs.sparkSession.sparkContext.broadcast(bounds)

    def dealt(batches):
        for batch in batches:
            keys = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in key), strict=True)
            part = [bisect_right(shared.value, (u, t, -1 << 63 if p is None else p, a, o)) for u, t, p, a, o in keys]
            yield batch.append_column("range", pa.array(part, pa.int32()))

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by([("archive", "ascending"), ("seq", "ascending")])
        columns = {c: table.column(c).to_pylist() for c in key}
        parts: dict[str, list[tuple]] = {}
        for row, (u, t, p, a, o) in enumerate(zip(*columns.values(), strict=True)):
            parts.setdefault(a, []).append((u, t, -1 << 63 if p is None else p, a, o, row))
        order = [e[-1] for e in LoserTree(list(parts.values()))]
        base = table.column("range")[0].as_py() << 32
        return table.take(pa.array(order)).drop_columns(["range", "seq"]).append_column("capture_order", pa.array(range(base, base + len(order)), pa.int64()))

    return runs.mapInArrow(dealt, ENTRY + ", seq long, range int").groupBy("range").applyInArrow(merged, ENTRY + ", capture_order long")


def archive_and_index(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives of ``pages``, read them back and merge their index; a row per page: the columns of ENTRY and capture_order.

    An empty table gives an empty index. Null payloads are empty payloads, null URLs ``urn:none``. Rows that repeat an id and a
    payload are responses all if that id is the smallest. A very long payload is an archive of its own, which one task holds; equal keys are
    ordered by id, archive and place. Other columns, whatever their names, are not read.
    """
    path = write_archives(pages, min_bytes, id_col, url_col, payload_col)
    runs = stored(index_runs(pages.sparkSession, path), "warc-runs")
    return merge_runs(runs).withColumnRenamed("page_id", id_col)
