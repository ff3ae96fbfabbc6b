"""Exact Jaccard similarity join of documents by word shingles, and its components.

Documents with the same shingle set are one from the start. What remains goes through two exact filters that count, for
each set, how many of its shingles other sets have as well: a set with a similar partner shares at least three quarters of
its shingles with it. The first looks at the head of each set by hash order (a quarter of the set, and an eighth more); of
the heads of two similar sets, that which ends first shares at least an eighth of its set with the other. The second looks at
whole sets, of what the first left. Only then do sets meet: those that share a rare shingle at places where similar sets can
form regions, and regions are joined as metric spaces by pivots, Voronoi cells and guests from the windows about them (see regions.py).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import FILTER_BITS, SALTS, without_rows
from .graph import components
from .regions import joined, least_common
from .shingles import cuts, set_ids, shingle_sets
from .storage import discard, numbered, release, stored

BLOCK_ENTRIES = 1 << 20
BUCKET_ENTRIES = 400_000
ENTRY = "bucket int, kind int, block long, hashes binary, sets binary"
COUNTS = "block long, sets binary, counts binary"


def _extra(n: int) -> int:
    return max(1, -(-n // 8))


def head_length(n: int) -> int:
    """Of the filter by heads: so many of a set's hashes are looked at."""
    return min(n, n - least_common(n) + _extra(n))


def _entries(sets, buckets: int, length):
    """Rows of ENTRY for (set id, sorted hashes) in blocks. kind 0: hashes that one set of the block has, and the sets; 1: sets
    and how many of their hashes other sets of the block have; 2: the hashes of kind 1, once."""
    block: dict[int, np.ndarray] = {}
    size, width = 0, -(-(1 << 64) // buckets)

    def flushed():
        ids = np.fromiter(block, np.int64, len(block))
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in block.values()])
        hashes = np.concatenate(list(block.values()))
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        single = new & np.concatenate([new[1:], [True]])
        out = []
        name = int(ids[0])
        for kind, h, s in ((0, hashes[single], ids[owner[single]]), (2, hashes[new & ~single], None)):
            part = (h // np.uint64(width)).astype(np.int64)
            for a, b in cuts(part):
                out.append((int(part[a]), kind, name, h[a:b].tobytes(), b"" if s is None else s[a:b].tobytes()))
        counts = np.bincount(owner[~single], minlength=len(ids))
        if (some := counts > 0).any():
            out.append((name % buckets, 1, name, counts[some].astype(np.int64).tobytes(), ids[some].tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["bucket", "kind", "block", "hashes", "sets"])

    for key, hashes in sets:
        if len(hashes) and key not in block:
            block[key] = hashes[: length(len(hashes))]
            size += len(block[key])
            if size >= BLOCK_ENTRIES:
                yield flushed()
                block, size = {}, 0
    if block:
        yield flushed()


def _shared(table: pa.Table) -> pa.Table:
    """Rows of COUNTS of a bucket: for each block, how many entries of its sets other sets have as well."""
    kind, block = table.column("kind").to_numpy(), table.column("block").to_numpy()
    blobs = {c: table.column(c).to_pylist() for c in ("hashes", "sets")}
    join = lambda c, k, t: np.frombuffer(b"".join(x for x, own in zip(blobs[c], kind, strict=True) if own == k), t)
    hashes, sets = join("hashes", 0, np.uint64), join("sets", 0, np.int64)
    home = np.repeat(block[kind == 0], [len(x) // 8 for x, own in zip(blobs["sets"], kind, strict=True) if own == 0])
    order = np.lexsort((sets, hashes))
    hashes, sets, home = hashes[order], sets[order], home[order]
    out = [(int(b), s, h) for b, k, s, h in zip(block, kind, blobs["sets"], blobs["hashes"], strict=True) if k == 1]
    if len(hashes):
        fresh = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (sets[1:] != sets[:-1])])
        hashes, sets, home = hashes[fresh], sets[fresh], home[fresh]
        same = hashes[1:] == hashes[:-1]
        shared = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | np.isin(hashes, join("hashes", 2, np.uint64))
        sets, home = sets[shared], home[shared]
        order = np.argsort(home, kind="stable")
        sets, home = sets[order], home[order]
        for a, b in cuts(home):
            ids, counts = np.unique(sets[a:b], return_counts=True)
            out.append((int(home[a]), ids.tobytes(), counts.astype(np.int64).tobytes()))
    columns = list(zip(*out, strict=True)) or [(), (), ()]
    return pa.table({"block": pa.array(columns[0], pa.int64()), "sets": pa.array(columns[1], pa.binary()), "counts": pa.array(columns[2], pa.binary())})


def _summed(table: pa.Table) -> pa.Table:
    """(set_id, shared) of a block."""
    sets = np.frombuffer(b"".join(table.column("sets").to_pylist()), np.int64)
    ids, place = np.unique(sets, return_inverse=True)
    counts = np.bincount(place, np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64), len(ids))
    return pa.table({"set_id": ids, "shared": counts.astype(np.int64)})


def _stored_sets(batches):
    for batch in batches:
        for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield key, np.frombuffer(blob.as_py(), np.uint64)


def _sharing(source: DataFrame, sets_of, buckets: int, length) -> DataFrame:
    """(set_id, shared): counted by bucket, then summed by the block that a set came from, as rows of blobs, and by set."""
    rows = source.mapInArrow(lambda batches: _entries(sets_of(batches), buckets, length), ENTRY)
    counts = rows.groupBy("bucket").applyInArrow(_shared, COUNTS).groupBy("block").applyInArrow(_summed, "set_id long, shared long")
    return counts.groupBy("set_id").agg(F.sum("shared").alias("shared"))


def _among(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(_text, set_id) of the rows of ``docs`` (_id, _text) with an id of ``chosen`` (_id, set_id). A bitmap of fixed size keeps most others out of
    the shuffle; the join behind it is exact."""
    place = f"pmod(xxhash64(_id), {FILTER_BITS})"
    bits = chosen.select(F.expr(f"{place} div 32768").alias("_part"), F.expr(f"{place} % 32768").alias("_bit"))
    maps = F.broadcast(bits.groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_map")))
    byte = f"cast(conv(hex(substring(_map, cast({place} % 32768 div 8 as int) + 1, 1)), 16, 10) as int)"
    near = docs.withColumn("_part", F.expr(f"{place} div 32768")).join(maps, "_part").where(f"shiftright({byte}, cast({place} % 8 as int)) & 1 = 1")
    return near.select("_id", "_text").join(chosen, "_id").select("_text", "set_id")


def _blocks(batches):
    """Rows (block, sets, sizes, hashes) of sets, some BLOCK_ENTRIES / 2 entries each."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: list[tuple[int, np.ndarray]] = []

    def flushed():
        blobs = [np.array([k for k, _ in held], np.int64), np.array([len(h) for _, h in held], np.int64), np.concatenate([h for _, h in held])]
        columns = [pa.array([number], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]]
        return pa.RecordBatch.from_arrays(columns, ["block", "sets", "sizes", "hashes"])

    size = 0
    for key, hashes in _stored_sets(batches):
        held.append((key, hashes))
        size += len(hashes)
        if 2 * size >= BLOCK_ENTRIES:
            yield flushed()
            held, size, number = [], 0, number + 1
    if held:
        yield flushed()


#: Rows of two arrays of 64-bit numbers for a block and, on the way there, a bucket.
PAIRS = "bucket int, block long, kind int, one binary, two binary"
PAIR_NAMES = ["bucket", "block", "kind", "one", "two"]
EDGES, OPEN, CLOSED = 0, 1, 2


def _pairs(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    blobs = [[x.tobytes() for x in c] if k > 2 else c for k, c in enumerate(columns)]
    return pa.table([pa.array(c, t) for c, t in zip(blobs, kinds, strict=True)], PAIR_NAMES)


def _by_token(tokens: np.ndarray, other: np.ndarray, block: int, kind: int, buckets: int) -> list[tuple]:
    """Rows of PAIRS, tokens in order, for the buckets of ranges of tokens."""
    part = (tokens // np.uint64(-(-(1 << 64) // buckets))).astype(np.int64)
    return [(int(part[i]), block, kind, tokens[i:j], other[i:j]) for i, j in cuts(part)]


def _column(table: pa.Table, name: str, dtype, kind: int | None = None) -> np.ndarray:
    blobs = table.column(name).to_pylist()
    if kind is not None:
        blobs = [b for b, k in zip(blobs, table.column("kind").to_pylist(), strict=True) if k == kind]
    return np.frombuffer(b"".join(blobs), dtype)


def _counted(buckets: int):
    def counts(batches):
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens, n = np.unique(np.frombuffer(blob, np.uint64), return_counts=True)
                yield from _pairs(_by_token(tokens, n.astype(np.int64), block, EDGES, buckets)).to_batches()

    return counts


def _totals(table: pa.Table) -> pa.Table:
    """Of a bucket: to each block its tokens that are in two sets or more, and in how many. A block has a token once, however many sets have it."""
    tokens, place = np.unique(_column(table, "one", np.uint64), return_inverse=True)
    total = np.bincount(place, _column(table, "two", np.int64), len(tokens)).astype(np.int64)
    out = []
    for block, blob in zip(table.column("block").to_pylist(), table.column("one").to_pylist(), strict=True):
        own = np.frombuffer(blob, np.uint64)
        often = total[np.searchsorted(tokens, own)]
        out.append((0, block, EDGES, own[often > 1], often[often > 1]))
    return _pairs(out)


def _heads(block: pa.Table, totals: pa.Table) -> pa.Table:
    """The entries of a block by which similar sets can meet first: where an entry could also have a partner of its set's own size it is
    open, else closed. Rows: edges from the smallest set with an open entry of a token to the others with that token; such smallest sets; and
    closed entries of tokens that have no open one in the block."""
    if not block.num_rows:
        return _pairs([])
    name = block.column("block")[0].as_py()
    sets, sizes, hashes = _column(block, "sets", np.int64), _column(block, "sizes", np.int64), _column(block, "hashes", np.uint64)
    tokens, often = _column(totals, "one", np.uint64), _column(totals, "two", np.int64)
    order = np.argsort(tokens)
    tokens, often = tokens[order], often[order]
    owner = np.repeat(np.arange(len(sets)), sizes)
    at = np.searchsorted(tokens, hashes)
    at[at == len(tokens)] = 0
    shared = tokens[at] == hashes if len(tokens) else np.zeros(len(hashes), bool)
    owner, at = owner[shared], at[shared]
    order = np.lexsort((at, often[at], owner))
    owner, at = owner[order], at[order]
    many = np.bincount(owner, minlength=len(sets))
    # Those that no other set has come first.
    place = np.arange(len(owner)) - (np.cumsum(many) - many)[owner] + (sizes - many)[owner]
    n = sizes[owner]
    keep = place <= n - least_common(n)
    owner, at, n, place = owner[keep], at[keep], n[keep], place[keep]
    open_ = 7 * (n - place) // 3 - n >= n
    ids = sets[owner]
    order = np.lexsort((ids, ~open_, at))
    ids, at, open_ = ids[order], at[order], open_[order]
    if not len(at):
        return _pairs([])
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    run = np.cumsum(np.concatenate([[False], at[1:] != at[:-1]]))
    hub, led = ids[begin][run], open_[begin][run]
    others = led & (ids != hub)
    edges = np.unique(np.stack([hub[others], ids[others]], 1), axis=0)
    return _pairs([
        (0, name, EDGES, edges[:, 0], edges[:, 1]),
        (0, name, OPEN, tokens[at[begin]][open_[begin]], ids[begin][open_[begin]]),
        (0, name, CLOSED, tokens[at][~led], ids[~led]),
    ])


def _to_buckets(buckets: int):
    def dealt(batches):
        for batch in batches:
            for block, kind, one, two in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                tokens, ids = np.frombuffer(one, np.uint64), np.frombuffer(two, np.int64)
                if kind == CLOSED:
                    tokens = np.unique(tokens)
                    ids = np.zeros(len(tokens), np.int64)
                if kind != EDGES and len(tokens):
                    yield from _pairs(_by_token(tokens, ids, block, kind, buckets)).to_batches()

    return dealt


def _stars(table: pa.Table) -> pa.Table:
    """Of a bucket: edges between the smallest open sets of all blocks, and to each block the smallest sets of tokens that it has closed entries of."""
    tokens, ids = _column(table, "one", np.uint64, OPEN), _column(table, "two", np.int64, OPEN)
    order = np.lexsort((ids, tokens))
    tokens, ids = tokens[order], ids[order]
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]])[: len(tokens)]
    known, hubs = tokens[new], ids[new]
    hub = hubs[np.cumsum(new) - 1] if len(ids) else ids
    other = hub != ids
    out = [(0, 0, EDGES, hub[other], ids[other])]
    for block, kind, blob in zip(table.column("block").to_pylist(), table.column("kind").to_pylist(), table.column("one").to_pylist(), strict=True):
        if kind == CLOSED and len(known):
            own = np.frombuffer(blob, np.uint64)
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            some = known[at] == own
            if some.any():
                out.append((0, block, CLOSED, own[some], hubs[at[some]]))
    return _pairs(out)


def _closed(entries: pa.Table, hubs: pa.Table) -> pa.Table:
    """Edges of a block from the sets of closed entries to the smallest open set of their token, where there is one."""
    tokens, ids = _column(entries, "one", np.uint64), _column(entries, "two", np.int64)
    known, hub = _column(hubs, "one", np.uint64), _column(hubs, "two", np.int64)
    if not len(known) or not len(tokens):
        return _pairs([])
    order = np.argsort(known)
    known, hub = known[order], hub[order]
    at = np.searchsorted(known, tokens)
    at[at == len(known)] = 0
    some = (known[at] == tokens) & (hub[at] != ids)
    edges = np.unique(np.stack([hub[at[some]], ids[some]], 1), axis=0)
    return _pairs([(0, 0, EDGES, edges[:, 0], edges[:, 1])])


def _unpacked(batches):
    for batch in batches:
        for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(one, np.int64)), pa.array(np.frombuffer(two, np.int64))], ["a", "b"])


def _region_edges(sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b), and the stored tables that they are read from, that connect all sets (set_id, hashes, n) which can be similar by where they have a first shingle in common, the order being from
    rare to common. How common a shingle is, is exact. A shingle that many sets have is one entry in a block of sets, so that no
    bucket gets more than a row of it from each block."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_ENTRIES))
    blocks = stored(sets.select("set_id", "hashes").mapInArrow(_blocks, "block long, sets binary, sizes binary, hashes binary"), "set-blocks")
    totals = blocks.select("block", "hashes").mapInArrow(_counted(buckets), PAIRS).groupBy("bucket").applyInArrow(_totals, PAIRS)
    heads = stored(blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_heads, PAIRS), "set-heads")
    few = max(8, -(-total // (4 * BUCKET_ENTRIES)))  # heads are about a quarter
    stars = stored(heads.mapInArrow(_to_buckets(few), PAIRS).groupBy("bucket").applyInArrow(_stars, PAIRS), "set-stars")
    closed = heads.where(F.col("kind") == CLOSED).groupBy("block").cogroup(stars.where(F.col("kind") == CLOSED).groupBy("block")).applyInArrow(_closed, PAIRS)
    edges = heads.where(F.col("kind") == EDGES).unionByName(stars.where(F.col("kind") == EDGES)).unionByName(closed)
    discard(blocks)
    return edges.select("one", "two").mapInArrow(_unpacked, "a long, b long"), [heads, stars]


def _spread_by(rows: DataFrame, small: DataFrame, key: str, own: str) -> DataFrame:
    """``rows`` joined with ``small`` (a row for each ``key``), of which many rows may have one key: by key and a salt from ``own``."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int"))
    spread = salted.select(key, "_s").distinct().join(small, key)
    return salted.join(spread, [key, "_s"]).drop("_s")


SET = "set_id long, hashes binary, n long"
#: What the second half of a set's id is changed by where it has to stand for the first.
STAND_IN = 0x5DEECE66D


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``id_col``, n_shingles, component_id of every document.

    Documents link when 100 * intersection >= 75 * union of their sets of distinct 5-word shingles; component_id is the smallest id
    that links lead to. Null texts and texts without words have no shingles and are their own component. Rows that
    repeat an id are rows like any other, and so are null ids, which have no id to offer. An empty table gives an empty result, other
    columns are not read, and a text of any length is one set, made in one piece. With ``row_col``, a column of numbers, also that column and
    group, a number that two rows have in common if and only if links connect them; null for rows without shingles.
    """
    extra = [F.col(row_col).cast("long").alias("_row")] if row_col else []
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *extra)

    def measured(batches):
        for batch in batches:
            keys = [(len(s), *set_ids(s)) for s in shingle_sets(batch.column(1))]
            columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], ["_id", "n", "set_id", "other_id"] + ["_row"] * bool(row_col))

    schema = "_id long, n long, set_id long, other_id long" + ", _row long" * bool(row_col)
    salted = rows.mapInArrow(measured, schema).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    narrow = stored(salted, "shingle-counts")
    key = ["set_id", "other_id"]
    partial = stored(narrow.groupBy(*key, "n", "_salt").agg(F.min("_id").alias("_least")), "set-groups")
    classes = partial.groupBy(*key, "n").agg(F.min("_least").alias("rep"))
    classes = stored(classes, "sets")
    # Different sets with the same first half of their 128-bit ids go by the second; of 10^10 sets there are some three.
    twins = frozenset(r[0] for r in classes.groupBy("set_id").count().where("count > 1").select("set_id").collect())
    if twins:
        classes = classes.withColumn("set_id", F.when(F.col("set_id").isin(list(twins)), F.col("other_id").bitwiseXOR(F.lit(STAND_IN))).otherwise(F.col("set_id")))
        narrow, partial = (t.withColumn("set_id", F.when(F.col("set_id").isin(list(twins)), F.col("other_id").bitwiseXOR(F.lit(STAND_IN))).otherwise(F.col("set_id"))) for t in (narrow, partial))

    def name(s: np.ndarray) -> int:
        one, two = set_ids(s)
        return two ^ STAND_IN if one in twins else one

    heads = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-heads // BUCKET_ENTRIES))
    from_texts = lambda batches: ((name(s), s) for b in batches for s in shingle_sets(b.column(0)))
    sharing = _sharing(rows.select("_text"), from_texts, buckets, head_length)
    enough = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * 3 / 4) / 8))
    chosen = stored(sharing.join(classes, "set_id").where(F.col("shared") >= enough).select(F.col("rep").alias("_id"), "set_id"), "sharing-heads")
    release(docs.sparkSession)

    def with_sets(batches):
        """Sets of texts that have the id of the set's representative; other texts may have that id as well."""
        for batch in batches:
            out = [(k, s) for s, k, e in ((s, name(s), e) for s, e in zip(shingle_sets(batch.column(0)), batch.column(1).to_pylist(), strict=True)) if e is None or e == k]
            columns = [pa.array([k for k, _ in out], pa.int64()), pa.array([s.tobytes() for _, s in out], pa.binary()), pa.array([len(s) for _, s in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["set_id", "hashes", "n"])

    some = stored(_among(rows.select("_id", "_text"), chosen.where("_id IS NOT NULL")).mapInArrow(with_sets, SET), "some-sets")
    wanted = chosen.select("set_id").distinct().count()
    if some.count() != wanted or not chosen.where("_id IS NULL").isEmpty():  # rows that repeat an id, or sets of rows without one
        nameless = rows.where("_id IS NULL").select("_text", F.lit(None).cast("long").alias("set_id")).mapInArrow(with_sets, SET)
        some = stored(some.unionByName(nameless).join(chosen.select("set_id").distinct(), "set_id", "left_semi").dropDuplicates(["set_id"]), "some-sets")
    whole = _sharing(some.select("set_id", "hashes"), _stored_sets, buckets, lambda n: n)
    keep = whole.join(some.select("set_id", "n"), "set_id").where(F.col("shared") >= F.ceil(F.col("n") * 3 / 4)).select("set_id")
    left = stored(some.join(keep, "set_id", "left_semi"), "sharing-sets")
    discard(some)
    release(docs.sparkSession)
    edges, tables = _region_edges(left)
    regions = components(edges)
    for done in tables:
        discard(done)
    placed = left.join(regions, left["set_id"] == regions["node"]).select(F.col("root").alias("region"), "set_id", "n", F.col("set_id").alias("label"), F.lit(True).alias("home"), "hashes")
    placed = stored(placed, "regions")
    discard(left)
    found = joined(placed)
    discard(placed)

    members = found.join(classes.select("set_id", "rep"), "set_id")
    least = members.groupBy("root").agg(F.min("rep").alias("component"))
    told = _spread_by(members.select("set_id", "root"), least, "root", "set_id")
    named = classes.join(told, "set_id", "left").select(
        *key, F.when(F.col("n") > 0, F.coalesce("component", "rep")).alias("component"), F.when(F.col("n") > 0, F.coalesce("root", "set_id")).alias("group")
    )
    spread = partial.join(named, key).select(*key, "_salt", "component", "group")
    out = narrow.join(spread, [*key, "_salt"])
    columns = [F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id")).alias("component_id")]
    return out.select(*columns, *([F.col("_row").alias(row_col), "group"] if row_col else []))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of ``docs`` that stay, with all their columns: of those that links of ``jaccard_components`` connect, one row, that with the smallest
    id; of rows that repeat this id, one. Rows without shingles (null and empty texts) all stay, an empty table stays empty, and null ids stay only
    where none of a group has another."""
    rows, row = numbered(docs, id_col, text_col)
    if not row:
        found = jaccard_components(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "component_id")
        return without_rows(docs, None, id_col, found.where(~F.col("_id").eqNullSafe(F.col("component_id"))))
    narrow = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(row).alias("_row"))
    found = stored(jaccard_components(narrow, "_id", "_text", "_row"), "grouped-rows").where("group IS NOT NULL")
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")
    first = found.groupBy("group").agg(F.min(place).alias("first"))
    kept = _spread_by(found.withColumn("_own", F.xxhash64("_id", "_row")), first, "group", "_own")
    return without_rows(rows, row, id_col, kept.where(place != F.col("first")))
