"""BPE encoding by a table over prefixes, and decoding.

Byte-pair merging gives every prefix of a word one encoding, and the encoding of a longer prefix extends that of a
shorter one by its last token. So a table holds the last token of each prefix. The candidates for a prefix are the
tokens that end there, which a suffix automaton of the vocabulary gives; the right one is that which is compatible with
the last token of the prefix before it: merging would not have joined anything across the seam. Back-pointers from the
end give the ids.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ChunkTable, Vocabulary, chunks

_CODERS: dict[int, ChunkTable] = {}
NO_LIMIT = 1 << 62


class SuffixAutomaton:
    """Generalised suffix automaton of words over small integers, with the words that end in each state.

    ``step`` has the transitions by state * width + symbol; ``link`` the suffix links; ``chain`` by state the (length, value) of
    the words that are among its strings or those of the states on its suffix path, longest first. A state is left with a
    length, and only words of that length or less are suffixes of what was read.
    """

    def __init__(self, words: list[list[int]], values: list[int], width: int) -> None:
        self.width = width
        step: dict[int, int] = {}
        self.step, self.link, self.length = step, [-1], [0]
        out: list[list[int]] = [[]]
        ends: dict[int, list[tuple[int, int]]] = {}
        for word in words:
            last = 0
            for s in word:
                last = self._extend(last, s, out)
        for number, word in enumerate(words):
            state = 0
            for s in word:
                state = step[state * width + s]
            ends.setdefault(state, []).append((len(word), number))
        self.ends = {k: tuple(sorted(v, reverse=True)) for k, v in ends.items()}
        self.chain: list[tuple] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            own = tuple((n, values[number]) for n, number in self.ends.get(state, ()))
            self.chain[state] = own + self.chain[self.link[state]]

    def _new(self, length: int, link: int, out: list[list[int]]) -> int:
        self.length.append(length)
        self.link.append(link)
        out.append([])
        return len(self.link) - 1

    def _clone(self, p: int, q: int, s: int, out: list[list[int]]) -> int:
        """Split off state q the strings that end p's step by s."""
        step, w = self.step, self.width
        c = self._new(self.length[p] + 1, self.link[q], out)
        for x in out[q]:
            step[c * w + x] = step[q * w + x]
        out[c] = list(out[q])
        self.link[q] = c
        while p >= 0 and step.get(p * w + s) == q:
            step[p * w + s] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, s: int, out: list[list[int]]) -> int:
        step, w = self.step, self.width
        if (q := step.get(last * w + s)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, s, out)
        new, p = self._new(self.length[last] + 1, 0, out), last
        while p >= 0 and p * w + s not in step:
            step[p * w + s] = new
            out[p].append(s)
            p = self.link[p]
        if p >= 0:
            q = step[p * w + s]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, s, out)
        return new

class PrefixCoder:
    """Encodes words of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        symbols = {i: [s] for s, i in enumerate(vocabulary.first)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = dict.fromkeys(vocabulary.first, -1)
        for k, (a, b, c) in enumerate(vocabulary.merges):
            self.parts[c], self.born[c] = (a, b), k
            symbols[c] = symbols[a] + symbols[b]
        # Tokens that their own symbols don't merge into are never made, and so never candidates.
        self.numbers = [c for c in symbols if c not in self.parts or self._fits(*self.parts[c], self.born[c])]
        self.automaton = SuffixAutomaton([symbols[c] for c in self.numbers], self.numbers, 512)
        self.seams = ChunkTable(lambda key: self._fits(key >> 20, key & 0xFFFFF, NO_LIMIT), 1 << 19)

    def _fits(self, a: int, b: int, limit: int) -> bool:
        """Whether merging leaves a seam between two tokens: undo the younger merge at the seam, step by step, and see if the
        two now adjacent would have been joined before that merge. ``key`` is (left, right), limit: pairs that rank at
        or above the limit don't count."""
        rank, parts, born = self.vocabulary.rank, self.parts, self.born
        while True:
            joined = rank.get((a, b))
            if joined and joined[0] < limit:
                return False
            # On equal birth the tokens are equal; the left one merged first, so the right one is undone first.
            if born[a] > born[b]:
                limit = min(limit, born[a])
                a = parts[a][1]
            elif born[b] >= 0:
                limit = min(limit, born[b] + 1)
                b = parts[b][0]
            else:
                return True

    def encode(self, word: bytes) -> list[int]:
        """The ids of one word."""
        symbols = list(word)
        symbols[-1] += 256
        step, chain, w = self.automaton.step, self.automaton.chain, self.automaton.width
        link, length, seams = self.automaton.link, self.automaton.length, self.seams
        last, back = [-1], [0]
        state = at = 0
        for i, s in enumerate(symbols, 1):
            to = step.get(state * w + s)
            while to is None and state:
                state = link[state]
                at = length[state]
                to = step.get(state * w + s)
            state, at = (0, 0) if to is None else (to, at + 1)
            for n, token in chain[state]:
                if n <= at and (n == i or ((before := last[i - n]) >= 0 and seams[before << 20 | token])):
                    last.append(token)
                    back.append(i - n)
                    break
            else:
                last.append(-1)
                back.append(0)
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i = back[i]
        return out[::-1]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """As the library does for a file without a decoder: the tokens with a space between."""
    return " ".join(vocabulary.tokens[i] for i in ids)


def _coder(key: int, text: str) -> ChunkTable:
    """This worker's table of (number of ids, ids as text, decoded text) by chunk."""
    if key not in _CODERS:
        vocabulary = Vocabulary(text)
        coder = PrefixCoder(vocabulary)

        def outcome(ids: list[int]) -> tuple[int, str, str]:
            return len(ids), " ".join(map(str, ids)), decode(vocabulary, ids)

        words = ChunkTable(lambda word: outcome(coder.encode(word)), 1 << 18)

        def coded(chunk: str) -> tuple[int, str, str]:
            parts = [outcome([p]) if isinstance(p, int) else words[p] for p in vocabulary.pieces(chunk)]
            return parts[0] if len(parts) == 1 else (sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts]))

        _CODERS[key] = ChunkTable(coded)
    return _CODERS[key]


def encode_decode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Ids of every whole text and what they decode to.

    Returns ``id_col``, n_tokens, ids_sha256 (of the decimal ids with a space between), decoded_sha256; with ``texts``
    also ids (array of int) and decoded (string). Null counts as the empty text, which has no ids. The vocabulary file is
    read on the driver and broadcast. No shuffle. Other columns are not read.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    key = hash(vocabulary_path)
    names = ["_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * texts

    def coded(batches):
        table = _coder(key, shared.value)
        for batch in batches:
            out: list[list] = [[] for _ in names[1:]]
            for text in batch.column(1):
                found = list(map(table.__getitem__, chunks(text.as_py())))
                ids = " ".join([f[1] for f in found])
                decoded = " ".join([f[2] for f in found])
                row = [sum([f[0] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                for column, value in zip(out, row + [list(map(int, ids.split())), decoded] * texts, strict=False):
                    column.append(value)
                if texts:
                    out[-1][-1], out[-2][-1] = decoded, list(map(int, ids.split()))
            kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32()), pa.string()] * texts
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names)

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = rows.mapInArrow(coded, "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * texts)
    return out.withColumnRenamed("_id", id_col)
