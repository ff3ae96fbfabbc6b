"""Words of a BPE vocabulary with word ends, as its tokenizer cuts them out of a text.

The rules are those of the vocabulary file: added tokens are cut out of the raw text first; then NFC, lower case by
character, white space dropped, and matches of the file's pattern, which never reach across white space. So a text is
the sequence of its white-space separated chunks, and whatever is known of a chunk is kept in a bounded table.
"""

from __future__ import annotations

import json
import re

import regex
from tokenizers import Tokenizer

#: str.split() parts texts at these characters too, which are not white space to the vocabulary's pattern.
_CONTROLS = re.compile("[\x1c-\x1f]")
#: Characters up to here are in NFC by themselves, and no Unicode version has changed their case or class.
_RARE = re.compile("[^\x00-\u024f]")
_CHUNKS = regex.compile(r"\P{White_Space}+")
#: Chunks longer than this are worked out each time, so that a table's size is bounded by its number of entries.
LONGEST_KEPT = 64


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 characters for
    themselves, the other bytes, in order, for the characters from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and word pattern of a tokenizers file (text of the .json).

    A word's symbols are 0 to 255 for its bytes but the last, and 256 plus the byte for the last, which carries the
    word end. ``rank`` has, by left and right id, the merge's rank and result; ``first`` the id of each symbol.
    """

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        shown = byte_symbols()
        self.first = [self.ids[shown[b]] for b in range(256)] + [self.ids[shown[b] + end] for b in range(256)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        self.rank = {(a, b): (k, c) for k, (a, b, c) in enumerate(self.merges)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: s for s, i in (self.ids | self.added).items()}
        self._added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if "pattern" in p)
        self._word = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self._ascii = re.compile(pattern.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9"), re.ASCII)
        self._library = Tokenizer.from_str(text)
        self._byte = {c: b for b, c in shown.items()}

    def pieces(self, chunk: str) -> list[int | bytes]:
        """Of a chunk without white space: ids of added tokens, and words as bytes."""
        low = chunk.lower()
        if low.isalpha() and (chunk.isascii() or not _RARE.search(chunk)):
            return [low.encode()]
        if "<" not in chunk or not self._added.search(chunk):
            return self._words(chunk)
        out: list[int | bytes] = []
        at = 0
        for m in self._added.finditer(chunk):
            out += self._words(chunk[at : m.start()])
            out.append(self.added[m[0]])
            at = m.end()
        return out + self._words(chunk[at:])

    def _words(self, text: str) -> list[bytes]:
        if text.isascii():
            return [w.encode() for w in self._ascii.findall(text.lower())]
        if _RARE.search(text):  # forms, cases and classes as in the library's Unicode version
            cut = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
            return [bytes(self._byte[c] for c in w) for w, _ in cut]
        return [w.encode() for w in self._word.findall(text.lower())]


def chunks(text: str) -> list[str]:
    """The white-space separated chunks of a text."""
    return _CHUNKS.findall(text) if _CONTROLS.search(text) else text.split()


class ChunkTable(dict):
    """What ``work`` makes of each chunk, kept for short chunks in two generations of ``limit`` entries: when the younger is full
    it becomes the older, and what is used again moves back, so that common chunks stay."""

    def __init__(self, work, limit: int = 1 << 17) -> None:
        super().__init__()
        self.work, self.limit, self.older = work, limit, {}

    def forget(self) -> None:
        """Empty the table; it fills again in the first megabytes of a task."""
        self.clear()
        self.older = {}

    def __missing__(self, chunk):
        value = self.older.get(chunk)
        if value is None:
            value = self.work(chunk)
            if not isinstance(chunk, int) and len(chunk) > LONGEST_KEPT:
                return value
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[chunk] = value
        return value
