"""Vectorised word and shingle hashing over batches of whole documents.

A batch of documents is one byte buffer; words are the maximal runs of bytes
outside ``[\\x20\\x09-\\x0D]``, with A-Z lowered.  All hashes are 64-bit, made by
numpy over the whole buffer, so that Python never loops over words.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(4096, _BASE, dtype=np.uint64))


def _powers(n: int) -> np.ndarray:
    """Powers of the base, at least n of them."""
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.multiply.accumulate(np.full(max(n, 2 * len(_POWERS)), _BASE, dtype=np.uint64))
    return _POWERS


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit values."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all documents in order, and the number of words before each document (len + 1 values)."""
    sizes = np.fromiter((len(d) + 1 for d in docs), dtype=np.int64, count=len(docs))
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b" ".join(docs) + b" ", dtype=np.uint8)
    if not len(docs):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    space = IS_SPACE[buf]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    before = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), before
    spans = np.diff(np.append(starts, len(buf)))
    at = np.arange(starts[0], len(buf), dtype=np.int64) - np.repeat(starts, spans)
    tail = buf[starts[0]:]
    longest = int(at[inside[starts[0]:]].max()) + 1
    powers = _powers(longest)
    values = BYTE_VALUE[LOWER[tail]] * powers[np.minimum(at, longest - 1)]
    values[space[starts[0]:]] = 0
    return mix64(np.add.reduceat(values, starts - starts[0])), before


def shingles(docs: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each document's runs of `width` words.

    A document of fewer words is one run; one without words has none.
    """
    words, before = hash_words(docs)
    n = len(words)
    odd = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(1000003)) | np.uint64(1)
    total = words * odd[0]
    for j in range(1, width):
        total[: max(0, n - j)] += words[j:] * odd[j]
    total = mix64(total)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(total[a : b - width + 1]))
        elif b > a:
            out.append(mix64(np.add.reduce(words[a:b] * odd[: b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
