"""Removal of repeated byte strings by enhanced suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a document with a smaller id or further to the
front of the same one. Strings of that length (windows) meet as follows. The smallest hash among a window's seeds, short strings within it,
is its anchor; it depends on the window's bytes alone, so equal windows have equal anchors. Neighbouring windows with one anchor make
a stretch. Stretches are grouped by anchor hash, those of a block of texts before they are shuffled; of stretches with equal bytes all but the
first go whole. Where an anchor has several different stretches, the first of each kind brings its bytes, and in each bucket of such stretches a
suffix array with common-prefix lengths is scanned with a stack: every interval of the common-prefix tree that is long enough and whose
occurrences differ in the byte before them is a maximal repeat, and all its occurrences but the first are covered.

An anchor with more than SPLIT different stretches is split by longer contexts: a stretch is cut by where its windows have the anchor, into
halves, quarters and so on. The windows of one part share more bytes than the anchor, so that parts with other bytes there can't have a
window in common, and of parts with equal bytes all but the first go whole. A part of one window is equal to all that it can meet, so this ends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import FILTER_BITS, SALTS
from .shingles import _mixed, _powers, cuts
from .storage import numbered, stored

LENGTH = 100
SEED = 24
BLOCK_BYTES = 1 << 20
BUCKET_STRETCHES = 120_000
BUCKET_BYTES = 2 << 20
MERGED_BYTES = 16 << 20
SPLIT = 2_000
POSITION_BITS = 22

_rng = np.random.default_rng(20240502)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ``row`` tells documents with the same id apart; ``at`` is where the anchor is in the stretch. ``left`` and ``right`` are hashes of the anchor with the
#: bytes before and after it that all windows have in which it is far from the front, or near to it; 0 if the stretch has no such window.
STRETCH = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i8"), ("size", "<u2"), ("at", "<u2"), ("left", "<u4"), ("right", "<u4")])
SPAN = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i8"), ("size", "<i8")])
PLACE = ["doc", "row", "start"]


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` keys: minima from the front and from the back of blocks of that width meet."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    front = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


def _pieces(texts: list[bytes], length: int):
    """(text number, offset, bytes) of at most about BLOCK_BYTES each; pieces of one text overlap by a window less one byte and a seed's
    worth, so that each window is in one piece whole."""
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at >= length:
            yield i, at, t[at : at + BLOCK_BYTES + length - 1]
            at += BLOCK_BYTES


def stretches(docs: list[tuple[int, int]], texts: list[bytes], length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """The stretches (STRETCH) of some documents, which are told by id and row."""
    out, batch, size = [np.zeros(0, STRETCH)], [], 0
    for piece in _pieces(texts, length):
        if batch and size + len(piece[2]) > BLOCK_BYTES:
            out.append(_stretches(batch, docs, length, seed))
            batch, size = [], 0
        batch.append(piece)
        size += len(piece[2])
    if batch:
        out.append(_stretches(batch, docs, length, seed))
    return np.concatenate(out)


def _stretches(batch, docs: list[tuple[int, int]], length: int, seed: int) -> np.ndarray:
    data = np.frombuffer(b"".join(p[2] for p in batch), np.uint8)
    sizes = np.array([len(p[2]) for p in batch])
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    up, down = _powers(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)])])
    hashes = _mixed((total[seed:] - total[:-seed]) * down[: len(data) - seed + 1])
    low = np.uint64((1 << POSITION_BITS) - 1)
    # Equal hashes: the first one within the window, which equal windows agree on.
    least = sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), length - seed + 1)
    owner = np.repeat(np.arange(len(batch)), sizes - length + 1)
    start = np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(base.tolist(), sizes.tolist(), strict=True)])
    at = (least[start] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    a, b = start[first], start[last] + length
    out = np.zeros(len(first), STRETCH)
    # Mixed once more: a smallest hash is a small number, and buckets are ranges of anchors.
    out["anchor"] = _mixed(hashes[at[first]])
    out["content"] = _mixed((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    own = owner[first]
    for k, name in enumerate(("doc", "row")):
        out[name] = np.array([docs[p[0]][k] for p in batch], np.int64)[own]
    out["start"] = a - base[own] + np.array([p[1] for p in batch], np.int64)[own]
    out["size"] = b - a
    out["at"] = at[first] - a
    half, place = (length - seed) // 2, at[first]

    def context(begin: np.ndarray, size: int) -> np.ndarray:
        begin = np.clip(begin, 0, len(data) - size)
        return (_mixed((total[begin + size] - total[begin]) * down[begin]) >> np.uint64(32)) | np.uint64(1)

    out["left"] = np.where(place - a >= half, context(place - half, half + seed), 0)
    out["right"] = np.where(place - (b - length) < half, context(place, length - half + 1), 0)
    return out


def _blob(rows: np.ndarray) -> bytes:
    """Column by column, so that ids and starts compress."""
    return b"".join(rows[c].tobytes() for c in rows.dtype.names)


def _unblob(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    out = [np.zeros(0, dtype)]
    for blob in blobs:
        n = len(blob) // dtype.itemsize
        part, at = np.zeros(n, dtype), 0
        for c in dtype.names:
            part[c] = np.frombuffer(blob, dtype[c], n, at)
            at += n * dtype[c].itemsize
        out.append(part)
    return np.concatenate(out)


def united(spans: np.ndarray) -> np.ndarray:
    """SPAN rows of which those of one document that overlap or touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["row"], spans["doc"]))]
    own = np.cumsum(np.concatenate([[False], (spans["doc"][1:] != spans["doc"][:-1]) | (spans["row"][1:] != spans["row"][:-1])]))
    # Each document's places are moved beyond those of the one before, so that one running maximum serves all.
    move = own * (int((spans["start"] + spans["size"]).max()) + 2)
    start = spans["start"] + move
    reach = np.maximum.accumulate(start + spans["size"])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    out = spans[first]
    out["size"] = reach[np.append(first[1:], len(spans)) - 1] - start[first]
    return out


def _spans(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), SPAN)
    for c in SPAN.names:
        out[c] = rows[c]
    return out


def _packed(found: np.ndarray, buckets: int):
    """Rows (bucket, stretches, done) of a block. Of stretches with equal anchor and bytes only the first goes to its bucket; the others, as spans,
    to any."""
    place, counts = np.unique(found["content"], return_inverse=True, return_counts=True)[1:]
    some = np.flatnonzero(counts[place] > 1)
    some = some[np.lexsort([found[c][some] for c in ("start", "row", "doc", "anchor", "content")])]
    own = found[some]
    later = np.concatenate([[False], (own["content"][1:] == own["content"][:-1]) & (own["anchor"][1:] == own["anchor"][:-1])])[: len(own)]
    keep = np.ones(len(found), bool)
    keep[some[later]] = False
    done, found = united(_spans(own[later])), found[keep]
    part = (found["anchor"] // np.uint64(-(-(1 << 64) // buckets))).astype(np.int64)
    order = np.argsort(part, kind="stable")
    found, part = found[order], part[order]
    out = [(int(part[i]), _blob(found[i:j]), b"") for i, j in cuts(part)]
    if len(done):
        out.append((int(done["doc"][0] % buckets), b"", _blob(done)))
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "stretches", "done"])


MET = "doc long, row long, start long, size long, at int, anchor long, whole boolean"


def _met(table: pa.Table) -> pa.Table:
    """Rows of MET of a bucket's stretches: whole ones have the bytes of an earlier one; of the others, those that can have a window in common with
    another kind: each window has one of the two contexts of its anchor whole, so one of them must be the same."""
    found = _unblob(table.column("stretches").to_pylist(), STRETCH)
    found = found[np.lexsort([found[c] for c in ("start", "row", "doc", "content", "anchor")])]
    anchor, content = found["anchor"], found["content"]
    other = np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(found)]
    first = other | np.concatenate([[True], content[1:] != content[:-1]])[: len(found)]
    group = np.cumsum(other) - 1
    several = (np.bincount(group, first) > 1)[group] if len(found) else first
    done = np.concatenate([_unblob(table.column("done").to_pylist(), SPAN), united(_spans(found[~first]))])
    open_ = found[first & several]

    def met(side: str) -> np.ndarray:
        key = open_["anchor"] ^ open_[side].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        place, counts = np.unique(key, return_inverse=True, return_counts=True)[1:]
        return (open_[side] > 0) & (counts[place] > 1)

    open_ = open_[met("left") | met("right")]
    n, m = len(done), len(open_)
    columns = {c: np.concatenate([done[c], open_[c].astype(np.int64)]) for c in SPAN.names}
    columns["at"] = np.concatenate([np.zeros(n, np.int32), open_["at"].astype(np.int32)])
    columns["anchor"] = np.concatenate([np.zeros(n, np.int64), open_["anchor"].view(np.int64)])
    columns["whole"] = np.arange(n + m) < n
    return pa.table(columns)


def suffix_array(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes that begin at ``starts``, sorted by their first 256 bytes, and how many bytes each has in common with the one
    before it, 255 at most. By prefix doubling from 8-byte words."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(520, np.uint8)])
    word = np.zeros(n + 512, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n + 512]

    def ranked(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys, kind="stable")
        ranks = np.empty(len(keys), np.int64)
        sorted_ = keys[order]
        ranks[order] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))
        return ranks

    levels = [ranked(word)]
    for k in range(3, 7):
        ahead = np.concatenate([levels[-1][1 << k :], np.zeros(1 << k, np.int64)])
        levels.append(ranked(levels[-1] << 32 | ahead))
    order = starts[np.argsort(levels[-1][starts] << 32 | levels[-1][starts + 128], kind="stable")]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(7, 2, -1):
        common += (levels[k - 3][a + common] == levels[k - 3][b + common]).astype(np.int64) << k
    going = np.ones(len(a), bool)
    for _ in range(7):
        going &= padded[a + common] == padded[b + common]
        common += going
    return order, np.concatenate([[0], common])


def maximal_intervals(common: np.ndarray, left: np.ndarray, least: int):
    """Scan common-prefix lengths with a stack; (length, first, last) of each interval of the common-prefix tree of ``least`` or more whose suffixes
    are not all preceded by the same byte (``left``; negative: nothing), inner intervals before outer ones."""
    lengths, lefts = [*common.tolist(), 0], left.tolist()
    # An entry: length, first suffix, the byte before all of its suffixes so far or None if they differ.
    stack: list[list] = []
    for i in range(1, len(lengths)):
        begin = i - 1
        before = lefts[i - 1] if lefts[i - 1] >= 0 else None
        carried: list = [before]
        while stack and stack[-1][0] > lengths[i]:
            length, begin, own = stack.pop()
            own = own if own == carried[0] else None
            if own is None:
                yield length, begin, i - 1
            carried = [own]
        if lengths[i] < least:
            continue
        if stack and stack[-1][0] == lengths[i]:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == carried[0] else None
        else:
            stack.append([lengths[i], begin, carried[0]])


def repeats(contents: list[bytes], length: int = LENGTH):
    """Maximal repeats of ``length`` or more within and across the contents: (size, numbers of contents, offsets in them) of all occurrences of
    each, inner ones first. Sizes are counted to 255 bytes."""
    sizes = np.array([len(c) for c in contents])
    data = np.frombuffer(b"\xff".join(contents) + b"\xff", np.uint8)
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    many = np.maximum(sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(contents)), many)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    order, common = suffix_array(data, base[owner] + offset)
    owner = np.searchsorted(base, order, "right") - 1
    end = base[owner] + sizes[owner]
    room = end - order
    common[1:] = np.minimum(common[1:], np.minimum(room[1:], room[:-1]))
    left = np.where(order > base[owner], data[order - 1].astype(np.int64), -1)
    # Runs of equal windows; those that have the same byte before all of them are part of repeats that begin further left.
    begin = np.flatnonzero(common < length)
    stop = np.append(begin[1:], len(order))
    same = (np.minimum.reduceat(left, begin) == np.maximum.reduceat(left, begin)) & (left[begin] >= 0) if len(begin) else np.zeros(0, bool)
    where = order - base[owner]
    for i, j in zip(begin[(stop - begin > 1) & ~same].tolist(), stop[(stop - begin > 1) & ~same].tolist(), strict=True):
        for size, a, b in maximal_intervals(np.concatenate([[0], common[i + 1 : j]]), left[i:j], length):
            yield size, owner[i + a : i + b + 1], where[i + a : i + b + 1]


def _covered(table: pa.Table) -> pa.Table:
    """SPAN rows: all occurrences of a bucket's repeats but the first of each. An inner interval's occurrences have their longest repeat from
    it and are left out of the outer ones, but for the first."""
    table = table.sort_by([(c, "ascending") for c in PLACE])
    doc, row, start = (table.column(c).to_numpy() for c in PLACE)
    # Contents are in the order of documents by now, and those of one document have this number in common.
    rank = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))
    out = [np.zeros((0, 3), np.int64)]
    for size, owner, offset in repeats(table.column("content").to_pylist()):
        at = start[owner] + offset
        keep = np.arange(len(owner)) != np.lexsort((at, rank[owner]))[0]
        out.append(np.stack([owner[keep], at[keep], np.full(len(owner) - 1, size)], 1))
    rows = np.concatenate(out)
    spans = np.zeros(len(rows), SPAN)
    spans["doc"], spans["row"], spans["start"], spans["size"] = doc[rows[:, 0]], row[rows[:, 0]], rows[:, 1], rows[:, 2]
    spans = united(spans)
    return pa.table({c: spans[c] for c in SPAN.names})


OPEN = "key long, doc long, row long, start long, at int, content binary"


def parts(content: bytes, at: int, level: int, length: int = LENGTH, seed: int = SEED):
    """(key, first window, anchor's place, content) of the parts of a stretch at ``level``: windows whose offsets of the anchor are in one cell of 128 >> level
    offsets. The key is a hash of the bytes that all windows of the cell have."""
    width = 128 >> level
    least = at - (len(content) - length)
    for cell in range(at // width, least // width - 1, -1):
        low, high = cell * width, min(cell * width + width - 1, length - seed)
        first, last = at - min(at, high), at - max(least, low)
        shared = content[at - low : at + length - high]
        key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=bytes([level, cell])).digest(), "little", signed=True)
        yield key, first, at - first, content[first : last + length]


def _split(rows: DataFrame, level: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for _, doc, row, start, at, content in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                out += [(key, doc, row, start + first, place, part) for key, first, place, part in parts(content, at, level)]
            yield _open_batch(out)

    return rows.mapInArrow(cut, OPEN)


def _open_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", *PLACE, "at", "content"])


def _collapsed(rows: DataFrame) -> DataFrame:
    """``rows`` (OPEN) with whole: true for all but the first of those with equal key and content. Salted, so that many equal ones are spread."""
    place = F.struct(*PLACE)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*PLACE), F.lit(SALTS)).cast("int"))
    partial = salted.groupBy("key", "content", "_salt").agg(F.min(place).alias("_least"))
    total = partial.groupBy("key", "content").agg(F.min("_least").alias("_first"))
    spread = partial.join(total, ["key", "content"]).select("key", "content", "_salt", "_first")
    return salted.join(spread, ["key", "content", "_salt"]).select("key", *PLACE, "at", "content", (place != F.col("_first")).alias("whole"))


def _bounded(rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (OPEN) with every key that more than SPLIT of them have split by longer contexts, and the spans that go whole by that."""
    few, spans = [], []
    for level in range(1, 9):
        hot = stored(rows.groupBy("key").count().where(f"count > {SPLIT}").select("key"), "hot-anchors")
        if hot.isEmpty():
            break
        few.append(rows.join(hot, "key", "left_anti").select(*[c.split()[0] for c in OPEN.split(", ")]))
        cut = stored(_split(rows.join(hot, "key", "left_semi").select(few[0].columns), level), "split-anchors")
        marked = stored(_collapsed(cut), "split-kinds")
        spans.append(marked.where("whole").select(*PLACE, F.octet_length("content").cast("long").alias("size")))
        rows = marked.where("NOT whole").drop("whole")
    for part in few:
        rows = rows.unionByName(part)
    return rows, spans


def _maybe(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``docs`` (_id, _text) with _maybe: whether _id may be among ``chosen`` (doc). From a bitmap of FILTER_BITS bits, whatever the size of
    ``chosen``; what is false is certain."""
    place = lambda c: f"pmod(xxhash64({c}), {FILTER_BITS})"
    bits = chosen.select(F.expr(f"{place('doc')} div 32768").alias("_part"), F.expr(f"{place('doc')} % 32768").alias("_bit"))
    maps = F.broadcast(bits.groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map")))
    own = place("_id")
    byte = f"cast(conv(hex(substring(_map, cast({own} % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = docs.withColumn("_part", F.expr(f"{own} div 32768")).join(maps, "_part", "left")
    return marked.select("_id", "_row", "_text", F.expr(f"coalesce(shiftright({byte}, cast({own} % 8 as int)) & 1, 0) = 1").alias("_maybe"))


def _with_contents(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """OPEN rows of ``chosen`` (doc, row, start, size, at, anchor) with their bytes from ``rows`` (_id, _row, _text), which are read once more."""
    wanted = chosen.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "size", "at", "anchor")).alias("wanted"))
    likely = _maybe(rows, chosen.select("doc")).where("_maybe")

    def contents(batches):
        for batch in batches:
            out: list[tuple] = []
            for k, row, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = text.as_py().encode()
                out += [(s["anchor"], k, row, s["start"], s["at"], raw[s["start"] : s["start"] + s["size"]]) for s in spans]
            yield _open_batch(out)

    texts = likely.join(wanted, (likely["_id"] == wanted["doc"]) & (likely["_row"] == wanted["row"])).select("_id", "_row", "_text", "wanted")
    return stored(texts.mapInArrow(contents, OPEN), "open-stretches")


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(doc, row, start, size) of spans to remove from ``rows`` (_id, _row, _text), overlapping ones included."""
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = max(8, -(-size // (35 * BUCKET_STRETCHES)))

    def cut(batches):
        docs, texts, held, found, size = [], [], 0, [], 0
        for batch in batches:
            for k, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                docs.append((k, row))
                texts.append(text.as_py().encode())
                held += len(texts[-1])
                if held > 4 * BLOCK_BYTES:
                    found.append(stretches(docs, texts))
                    docs, texts, size, held = [], [], size + held, 0
                if size > MERGED_BYTES:
                    yield _packed(np.concatenate(found), buckets)
                    found, size = [], 0
        found.append(stretches(docs, texts))
        yield _packed(np.concatenate(found), buckets)

    met = rows.mapInArrow(cut, "bucket int, stretches binary, done binary").groupBy("bucket").applyInArrow(_met, MET)
    met = stored(met, "stretches")
    open_ = met.where("NOT whole")
    held = open_.agg(F.sum("size")).first()[0] or 0
    n_buckets = max(8, -(-held // BUCKET_BYTES))

    few, spans = _bounded(_with_contents(rows, open_))
    dealt = few.select(F.pmod("key", F.lit(n_buckets)).cast("int").alias("bucket"), *PLACE, "content")
    covered = dealt.groupBy("bucket").applyInArrow(_covered, "doc long, row long, start long, size long")
    for more in (met.where("whole").select(*PLACE, "size"), *spans):
        covered = covered.unionByName(more)
    return stored(covered, "covered")


PART = "repeat_id long, size long, doc long, row long, start long, offset long"


def _grouped(table: pa.Table) -> pa.Table:
    """PART rows of a bucket: the repeats within its stretches (doc, row, start, content, n copies), by the stretches and places that have them; a
    stretch with copies is a repeat itself, if it isn't part of another."""
    contents, copies = table.column("content").to_pylist(), table.column("n").to_pylist()
    longest, out = [0] * len(contents), []
    for size, owner, offset in repeats(contents):
        first = int(owner[0])
        string = contents[first][int(offset[0]) : int(offset[0]) + size]
        out.append((string, size, owner, offset))
        for k in owner[offset == 0].tolist():
            longest[k] = max(longest[k], size)
    for k, content in enumerate(contents):
        if copies[k] > 1 and longest[k] < len(content):
            out.append((content, len(content), np.array([k]), np.array([0])))
    if not out:
        return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in PART.split(", ")})
    owner, offset = (np.concatenate([x[i] for x in out]) for i in (2, 3))
    many = [len(x[2]) for x in out]
    names = np.repeat(np.array([_string_id(x[0]) for x in out], np.int64), many)
    place = [table.column(c).to_numpy()[owner] for c in PLACE]
    return pa.table({"repeat_id": names, "size": np.repeat(np.array([x[1] for x in out], np.int64), many), **dict(zip(PLACE, place, strict=True)), "offset": offset.astype(np.int64)})


def _string_id(string: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(string, digest_size=8).digest(), "little", signed=True)


def _windows(batches):
    """PART rows of single windows of stretches (OPEN)."""
    for batch in batches:
        out: list[tuple] = []
        for _, doc, row, start, _, content in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            out += [(_string_id(content[k : k + LENGTH]), LENGTH, doc, row, start, k) for k in range(len(content) - LENGTH + 1)]
        columns = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PART.split(", ")])


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated strings of LENGTH bytes or more with all their occurrences: repeat_id (a hash of the string), size, ``id_col``, start, a row for each
    place in the corpus that has the string.

    The strings are the maximal repeats among the stretches of one anchor, so a repeat that is longer than a stretch is a chain of them, each
    overlapping the next by all but a byte of a window; together the strings cover every repeated window. Of an anchor with more than SPLIT
    different stretches the strings are single windows. A stretch is cut where a piece of BLOCK_BYTES ends. Null ids and texts, repeated
    ids and empty tables are as with ``remove_repeats``. Only strings that occur twice at least are grouped; occurrences are joined, never collected.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    known, row = numbered(narrow.where("_id IS NOT NULL"), "_id", "_text")
    known = known.select("_id", F.col("_row") if row else F.lit(0).cast("long").alias("_row"), "_text")

    def placed(batches):
        for batch in batches:
            ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            found = stretches(ids, [t.as_py().encode() for t in batch.column(2)])
            columns = [found[c].view(np.int64) if found[c].dtype == np.uint64 else found[c].astype(np.int64) for c in ("anchor", "content", *PLACE, "size", "at")]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["anchor", "kind", *PLACE, "size", "at"])

    places = stored(known.mapInArrow(placed, "anchor long, kind long, doc long, row long, start long, size long, at long"), "all-stretches")
    one = F.min(F.struct(*PLACE, "size", "at")).alias("f")
    kinds = stored(places.groupBy("anchor", "kind").agg(one, F.count(F.lit(1)).alias("n")).select("anchor", "kind", "f.*", "n"), "kinds")
    several = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("total")).where("total > 1").select("anchor", "kinds")
    some = stored(kinds.join(several, "anchor"), "repeated-kinds")
    alone = some.where("kinds = 1").select(F.col("kind").alias("repeat_id"), "size", *PLACE, F.lit(0).cast("long").alias("offset"))
    open_ = _with_contents(known, some.where("kinds > 1"))
    hot = stored(open_.groupBy("key").count().where(f"count > {SPLIT}").select("key"), "hot-anchors")
    copies = some.select(*PLACE, "n")
    few = open_.join(hot, "key", "left_anti").join(copies, PLACE)
    buckets = max(8, -(-(open_.agg(F.sum(F.octet_length("content"))).first()[0] or 0) // BUCKET_BYTES))
    met = few.select(F.pmod("key", F.lit(buckets)).cast("int").alias("bucket"), *PLACE, "content", "n").groupBy("bucket").applyInArrow(_grouped, PART)
    single = stored(open_.join(hot, "key", "left_semi").select(*[c.split()[0] for c in OPEN.split(", ")]).mapInArrow(_windows, PART), "single-windows")
    often = single.join(copies, PLACE).groupBy("repeat_id").agg(F.sum("n").alias("many")).where("many > 1").select("repeat_id")
    found = alone.unionByName(met).unionByName(single.join(often, "repeat_id", "left_semi").select(*[c.split()[0] for c in PART.split(", ")]))
    kept = some.select("anchor", "kind", *[F.col(c).alias(f"_{c}") for c in PLACE])
    every = places.join(kept, ["anchor", "kind"])
    on = (found["doc"] == every["_doc"]) & (found["row"] == every["_row"]) & (found["start"] == every["_start"])
    return found.join(every, on).select("repeat_id", found["size"], every["doc"].alias(id_col), (every["start"] + found["offset"]).alias("start"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of spans (start, size)."""
    out: list[list[int]] = []
    for start, size in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + size)
        else:
            out.append([start, start + size])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", contents: bool = False) -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256 of every document; with ``contents`` also kept (binary) and spans (array of start, end).

    Null texts are empty. Documents without an id are in no order and lose nothing. Rows that repeat an id are documents of their own, one after
    the other in the order of a hash of their texts, so that the first occurrence of every string stays in one of them. Very long texts are
    worked on in pieces of BLOCK_BYTES, which overlap by a window. An empty table gives an empty result; other columns are not read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    known, row = numbered(narrow.where("_id IS NOT NULL"), "_id", "_text")
    known = known.select("_id", F.col("_row") if row else F.lit(0).cast("long").alias("_row"), "_text")
    spans = repeated_spans(known)
    by_doc = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "size")).alias("_spans"))
    marked = _maybe(known, spans.select("doc"))
    some = marked.where("_maybe")
    touched = some.join(by_doc, (some["_id"] == by_doc["doc"]) & (some["_row"] == by_doc["row"]), "left").select("_id", "_text", "_spans")
    none = F.lit(None).cast("array<struct<start:long,size:long>>").alias("_spans")
    rest = marked.where("NOT _maybe").select("_id", "_text", none).unionByName(narrow.where("_id IS NULL").select("_id", "_text", none))

    def kept(batches):
        for batch in batches:
            out: list[tuple] = []
            for k, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                runs = merged([(s["start"], s["size"]) for s in own or ()])
                parts, at = [], 0
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                left = b"".join([*parts, raw[at:]])
                row = (k, len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest())
                out.append(row + (left, [{"start": a, "end": b} for a, b in runs]) * contents)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] * contents
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "spans"] * contents)

    schema = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start:long,end:long>>" * contents
    return touched.unionByName(rest).mapInArrow(kept, schema).withColumnRenamed("_id", id_col)
