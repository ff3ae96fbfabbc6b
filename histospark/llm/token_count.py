"""Token counts by byte-pair merging that never emits an identifier.

A word is a linked list of symbols and a heap of the ranks of its adjacent pairs. The lowest rank is popped again and
again (of equal ranks, the leftmost), its pair merged, and the two new neighbour pairs pushed. The count is the number of
initial symbols minus the number of merges.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ChunkTable, Vocabulary, chunks

SCHEMA = "_id long, n_bytes long, n_tokens long"
_TABLES: dict[int, ChunkTable] = {}


def count_word(vocabulary: Vocabulary, word: bytes) -> int:
    """The tokens of one word."""
    n = len(word)
    if n < 2:
        return n
    first, rank = vocabulary.first, vocabulary.rank
    sym = [first[b] for b in word]
    sym[-1] = first[256 + word[-1]]
    heap = [r[0] * n + i for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1])))]
    heapify(heap)
    after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
    while heap:
        k, i = divmod(heappop(heap), n)
        j = after[i]
        if sym[i] < 0 or j == n or (r := rank.get((sym[i], sym[j]))) is None or r[0] != k:
            continue  # one of the two has been merged meanwhile
        merges += 1
        sym[i], sym[j], after[i] = r[1], -1, after[j]
        if (q := after[i]) < n:
            before[q] = i
            if s := rank.get((sym[i], sym[q])):
                heappush(heap, s[0] * n + i)
        if (p := before[i]) >= 0 and (s := rank.get((sym[p], sym[i]))):
            heappush(heap, s[0] * n + p)
    return n - merges


def _counter(key: int, text: str) -> ChunkTable:
    """This worker's table of chunk counts for a vocabulary."""
    if key not in _TABLES:
        vocabulary = Vocabulary(text)
        words = ChunkTable(lambda w: count_word(vocabulary, w), 1 << 18)
        _TABLES[key] = ChunkTable(lambda c: sum(1 if isinstance(p, int) else words[p] for p in vocabulary.pieces(c)))
    return _TABLES[key]


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text, as the tokenizers library counts them without special tokens added.

    ``vocabulary_path`` is read on the driver and broadcast (a vocabulary file, not data). Returns ``id_col``, n_bytes,
    n_tokens, over_limit, a row per input row. Null and empty texts have 0 bytes and 0 tokens. No shuffle; a text's length
    only bounds the memory of its own row. Other columns are not read.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    key = hash(vocabulary_path)

    def counted(batches):
        table = _counter(key, shared.value)
        for batch in batches:
            sizes, tokens = [], []
            for text in batch.column(1):
                text = text.as_py()
                sizes.append(len(text.encode()))
                tokens.append(sum(map(table.__getitem__, chunks(text))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = rows.mapInArrow(counted, SCHEMA)
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
