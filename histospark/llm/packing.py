"""Bounded-space online best-fit packing of token sequences.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt into groups of about TOKENS_PER_GROUP tokens by a
hash, the number of groups following the tokens counted over all documents, and each group is packed on its own, its pieces arriving in
the order of their ids: open bins are kept by free space, a bitset tells which free spaces have a bin, and a piece goes to
the bin with the least space that holds it. OPEN_BINS are open at most, out of the thousands that a group fills; when another is needed, the
fullest closes. What a group leaves open at its end is a few bins out of TOKENS_PER_GROUP / capacity.
"""

from __future__ import annotations

import struct
import zlib
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .storage import stored
from .words import ChunkTable, Vocabulary, byte_symbols, chunks
from .worker_memory import tidied

TOKENS_PER_GROUP = 32_000_000
OPEN_BINS = 64
_TABLES: dict[int, tuple[ChunkTable, ChunkTable]] = {}


def best_fit(lengths: list[int], capacity: int, open_bins: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, in the order in which they come; lengths are from 1 to ``capacity``."""
    at_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled, n_open, n_bins, out = 0, 0, 0, []
    for n in lengths:
        roomy = filled >> n
        if roomy:
            free = (roomy & -roomy).bit_length() - 1 + n
            bin_ = at_free[free].pop()
            if not at_free[free]:
                filled ^= 1 << free
        else:
            if n_open == open_bins:  # the fullest closes
                fullest = (filled & -filled).bit_length() - 1
                at_free[fullest].pop()
                if not at_free[fullest]:
                    filled ^= 1 << fullest
                n_open -= 1
            bin_, free, n_bins, n_open = n_bins, capacity, n_bins + 1, n_open + 1
        out.append((bin_, capacity - free))
        if left := free - n:
            at_free[left].append(bin_)
            filled |= 1 << left
        else:
            n_open -= 1
    return out


def _ids(key: int, text: str) -> tuple[ChunkTable, ChunkTable]:
    """This worker's tables of ids, as little-endian 32-bit numbers, by chunk and by word; words are split by the tokenizers library's model."""
    if key not in _TABLES:
        vocabulary = Vocabulary(text)
        model, shown = Tokenizer.from_str(text).model, byte_symbols()
        packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        words = ChunkTable(lambda w: packed([t.id for t in model.tokenize("".join([shown[b] for b in w]))]), 1 << 18)

        def coded(chunk: str) -> bytes:
            parts = [packed([p]) if isinstance(p, int) else words[p] for p in vocabulary.pieces(chunk)]
            return parts[0] if len(parts) == 1 else b"".join(parts)

        _TABLES[key] = ChunkTable(coded), words
    return _TABLES[key]


def pieces(docs: DataFrame, vocabulary_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """_id, piece, start, length, ids_crc32 of each document's pieces: its ids, then ``end_id``; only documents longer than
    ``capacity`` are cut. The vocabulary file is read on the driver and broadcast."""
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    key, end, step = hash(vocabulary_path), end_id.to_bytes(4, "little"), 4 * capacity

    def cut(batches):
        tables = _ids(key, shared.value)
        table = tables[0]
        try:
            yield from _cut(batches, table)
        finally:
            for each in tables:
                each.forget()

    def _cut(batches, table):
        for batch in batches:
            out: list[tuple] = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = b"".join([*map(table.__getitem__, chunks(text.as_py())), end])
                for piece, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    out.append((k, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(tidied(cut), "_id long, piece int, start long, length long, ids_crc32 long")


def pack(
    docs: DataFrame, vocabulary_path: str, capacity: int = 4096, end_id: int = 1, open_bins: int = OPEN_BINS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns ``id_col``, piece, start, length, ids_crc32, sequence_id, offset, a row per piece. Null and empty texts are pieces
    of ``end_id`` alone; an empty table gives no piece. Rows that repeat an id are documents of their own. Only the
    pieces' numbers are shuffled; a very long text is encoded by one task and then is pieces like any others. Other columns are not read.
    Within a group pieces arrive by id and piece, those of rows with one id by their checksum; null ids come last.
    """
    cut = stored(pieces(docs, vocabulary_path, capacity, end_id, id_col, text_col), "pieces")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, ceil(tokens / TOKENS_PER_GROUP))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    schema = "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("_id", "piece", "ids_crc32", "length")])
        base = table.column("_group")[0].as_py() << 40
        placed = best_fit(table.column("length").to_pylist(), capacity, open_bins)
        table = table.drop_columns(["_group"])
        table = table.append_column("sequence_id", pa.array([base + b for b, _ in placed], pa.int64()))
        return table.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return dealt.groupBy("_group").applyInArrow(packed, schema).withColumnRenamed("_id", id_col)
