"""Winnowing: rolling hashes of k-grams, and the minimum of each window of w of them.

Ties go to the rightmost gram, and positions are kept.  Two texts that share a
run of k + w - 1 symbols share at least one (hash) entry, found at the same place of
the run.
"""

from __future__ import annotations

import numpy as np

from .text import mix64

_LOW = np.uint64(2**24 - 1)
_HIGH = ~_LOW
#: Symbols handled at once; a position in such a block fits 24 bits.
BLOCK = 1 << 20


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k-gram (k a power of two) at each position; the last k - 1 mean nothing."""
    h = values
    m = 1
    while m < k:
        grown = h * (mix64(np.array([m], dtype=np.uint64)) | np.uint64(1))
        if m < len(h):
            grown[: len(h) - m] += h[m:]
        h = grown
        m *= 2
    return mix64(h)


def sliding_min(keys: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each full window of w keys."""
    if len(keys) < w:
        return keys[:0]
    cur, m = keys, 1
    while 2 * m <= w:
        cur = np.minimum(cur[:-m], cur[m:])
        m *= 2
    return np.minimum(cur[: len(cur) - (w - m)], cur[w - m :]) if m < w else cur


def _spans(sizes: np.ndarray, most: int, overlap: int) -> list[list[tuple[int, int, int]]]:
    """Groups of (document, from, to) with at most about `most` symbols each; long documents come in overlapping parts."""
    groups: list[list[tuple[int, int, int]]] = [[]]
    held = 0
    for i, n in enumerate(sizes.tolist()):
        a = 0
        while True:
            b = min(n, a + most)
            if held and held + b - a > most:
                groups.append([])
                held = 0
            groups[-1].append((i, a, b))
            held += b - a
            if b == n:
                break
            a = b - overlap
    return groups


def window_minima(values: np.ndarray, sizes: np.ndarray, k: int, w: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each document of the concatenated `values` (uint64, mixed): the chosen grams.

    Returns arrays (document, position, hash, first, last): the gram at `position`
    is the choice of exactly the windows that start at first..last.  A document
    with fewer than w grams has no windows; with `short`, all its grams are one.
    """
    before = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    parts: list[tuple[np.ndarray, ...]] = []
    width = k + w - 1
    for group in _spans(sizes, BLOCK, width - 1):
        pieces = [values[before[i] + a : before[i] + b] for i, a, b in group]
        block = pieces[0] if len(pieces) == 1 else np.concatenate(pieces)
        if not len(block):
            continue
        lens = np.array([b - a for _, a, b in group], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        hashes = gram_hashes(block, k)
        n = len(block)
        keys = (hashes & _HIGH) | (_LOW - np.arange(n, dtype=np.uint64))
        best = sliding_min(keys, w)
        count = np.maximum(lens - width + 1, 0)
        if count.any():
            at = np.repeat(starts, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            chosen = (_LOW - (best[at] & _LOW)).astype(np.int64)
            owner = np.repeat(np.arange(len(group)), count)
            new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])]))
            end = np.append(new[1:], len(chosen)) - 1
            own = owner[new]
            base = np.array([a for _, a, _ in group], dtype=np.int64)[own] - starts[own]
            parts.append((np.array([i for i, _, _ in group], dtype=np.int64)[own], chosen[new] + base, hashes[chosen[new]], at[new] + base, at[end] + base))
        if short:
            for j in np.flatnonzero((lens >= k) & (lens < width)).tolist():
                i, a, b = group[j]
                if a == 0 and b == sizes[i]:
                    s = int(starts[j])
                    p = int(_LOW) - int(keys[s : s + b - k + 1].min() & _LOW)
                    parts.append((np.array([i]), np.array([p - s]), hashes[p : p + 1], np.array([0]), np.array([0])))
    if not parts:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, np.uint64), empty, empty
    doc, pos, h, lo, hi = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((lo, doc))
    doc, pos, h, lo, hi = doc[order], pos[order], h[order], lo[order], hi[order]
    # Parts of a long document meet at a window border: one gram may have been chosen on both sides.
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])])) if len(doc) else np.empty(0, np.int64)
    return doc[new], pos[new], h[new], lo[new], np.maximum.reduceat(hi, new) if len(new) else hi
