"""Sets of hashed word shingles, worked out for blocks of texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
BLOCK_BYTES = 2 << 20

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, for n places or more."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 17))
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    return _POWERS


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _block(texts: list[bytes]) -> list[np.ndarray]:
    data = _LOWER[np.frombuffer(b" ".join(texts), np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * up[: len(data)])])
    word = _mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    owner = np.searchsorted(first, start, "right") - 1
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    runs = max(0, len(word) - WORDS + 1)
    shingle = np.zeros(runs, np.uint64)
    for k in range(WORDS):
        shingle += word[k : k + runs] * _PLACE[k]
    shingle = _mixed(shingle)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(shingle[a : b - WORDS + 1]))
        elif b > a:
            out.append(_mixed((word[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + _PLACE[WORDS:] * np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(column):
    """For each text of an Arrow column (null: empty) the sorted hashes of its distinct runs of WORDS words; of all its words, if it has
    fewer.

    Words are runs of bytes other than ASCII white space, with A to Z lower-cased. Texts are worked on in blocks of about
    BLOCK_BYTES, of which one is in memory; a longer text is a block of its own.
    """
    block: list[bytes] = []
    size = 0
    for text in column:
        raw = (text.as_py() or "").encode()
        if block and size + len(raw) > BLOCK_BYTES:
            yield from _block(block)
            block, size = [], 0
        block.append(raw)
        size += len(raw) + 1
    if block:
        yield from _block(block)


def set_ids(hashes: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that identify a set."""
    d = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def linked(common: int, a: int, b: int) -> bool:
    """Whether two sets of sizes a and b are similar by 0.75 or more."""
    return 100 * common >= 75 * (a + b - common)


def cuts(key: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal values."""
    if not len(key):
        return []
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
    return list(zip(at, [*at[1:], len(key)], strict=True))
