"""Two-stage suffix sorting of a byte block, and common prefixes of neighbours in that order.

Only suffixes smaller than their successors are sorted directly; a scan of the
first-byte buckets in ascending order puts all others in place, since each of them
is one byte before a suffix that is already placed.  Everything works on whole
numpy arrays: a bucket is scanned at once, runs of one byte in waves.
"""

from __future__ import annotations

import numpy as np

from .text import BYTE_VALUE

#: Places that are hashed or compared at once.
_CHUNK = 1 << 18
_STEP = np.array([0xD6E8FEB86659FD93], dtype=np.uint64)


class Block:
    """A block of bytes with views of its 8-byte words; suffixes are compared over `depth` bytes."""

    def __init__(self, data: bytes, depth: int):
        self.depth = depth
        self.n = len(data)
        self._padded = np.frombuffer(data + bytes(depth + 16), dtype=np.uint8)
        self.bytes = self._padded[: self.n]
        self._words = np.ndarray((self.n + depth + 8,), dtype=">u8", buffer=self._padded, strides=(1,))

    def words(self, at: np.ndarray, offset: int) -> np.ndarray:
        """The big-endian words at these places plus an offset; bytes beyond the depth read as 0."""
        found = self._words[at + offset].astype(np.uint64)
        over = offset + 8 - self.depth
        return found >> np.uint64(8 * over) << np.uint64(8 * over) if over > 0 else found

    def hashes(self, at: np.ndarray) -> np.ndarray:
        """An array with a hash of the `depth` bytes from each of these places; what stands elsewhere means nothing."""
        wanted = np.zeros(self.n, dtype=bool)
        wanted[at] = True
        out = np.zeros(self.n, dtype=np.uint64)
        for a in range(0, self.n, _CHUNK):
            b = min(self.n, a + _CHUNK)
            own = np.flatnonzero(wanted[a:b])
            if len(own):
                out[a + own] = self._hashed(a, b)[own]
        return out

    def _hashed(self, a: int, b: int) -> np.ndarray:
        h = BYTE_VALUE[self._padded[a : b + self.depth]]
        total, taken, m, power = None, 0, 1, _STEP
        depth = self.depth
        while depth:
            if depth & 1:
                part = h[taken : taken + b - a]
                total = part.copy() if total is None else total * power + part
                taken += m
            depth >>= 1
            if depth:
                grown = h * power
                grown[:-m] += h[m:]
                h, power, m = grown, power * power, 2 * m
        return total


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the end counts as smaller than all."""
    n = len(t)
    if not n:
        return np.empty(0, bool)
    up = np.empty(n, dtype=np.int8)
    up[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    up[-1] = -1
    decided = np.flatnonzero(up).astype(np.int32)
    following = np.cumsum(up != 0, dtype=np.int32) - (up != 0)
    return up[decided[following]] > 0


def _sort_directly(block: Block, at: np.ndarray) -> np.ndarray:
    """These suffixes in order of their first `depth` bytes.

    Words are compared from the first on, among ties only.  A group of ties whose
    members all have the same hash of `depth` bytes is equal and leaves.
    """
    key = block.words(at, 0)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    if len(at) < 2:
        return at
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    done = np.zeros(len(at), dtype=bool)
    tied = ~fresh
    tied[:-1] |= ~fresh[1:]
    whole = block.hashes(at[tied])
    for offset in range(8, block.depth, 8):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        slots = np.flatnonzero(tied & ~done)
        if not len(slots):
            break
        heads = np.flatnonzero(fresh[slots])
        h = whole[at[slots]]
        size = np.diff(np.append(heads, len(slots)))
        same = np.minimum.reduceat(h, heads) == np.maximum.reduceat(h, heads)
        equal = np.repeat(same, size)
        done[slots[equal]] = True
        slots = slots[~equal]
        if not len(slots):
            break
        group = np.cumsum(fresh[slots])
        places = at[slots]
        key = block.words(places, offset)
        order = np.lexsort((key, group))
        at[slots] = places[order]
        key, group = key[order], group[order]
        fresh[slots[1:]] |= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    return at


def suffix_order(block: Block) -> np.ndarray:
    """All suffixes in ascending order of their first `depth` bytes at least."""
    t, n = block.bytes, block.n
    if not n:
        return np.empty(0, np.int32)
    direct = _sort_directly(block, np.flatnonzero(smaller_than_successor(t)).astype(np.int32))
    edges = np.searchsorted(t[direct], np.arange(257))
    ready: list[list[np.ndarray]] = [[] for _ in range(256)]
    ready[t[n - 1]].append(np.array([n - 1], dtype=np.int32))
    out = []
    for c in range(256):
        own = direct[edges[c] : edges[c + 1]]
        if not ready[c] and not len(own):
            continue
        wave = np.concatenate(ready[c]) if ready[c] else own[:0]
        ready[c] = []
        bucket = [wave]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[t[wave] == c]
            bucket.append(wave)
        placed = np.concatenate([*bucket, own])
        out.append(placed)
        before = placed[placed > 0] - 1
        byte = t[before]
        larger = byte > c
        before, byte = before[larger], byte[larger]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cuts = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(byte) else []
        for a, b in zip(cuts, [*cuts[1:], len(byte)]):
            ready[byte[a]].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(block: Block, order: np.ndarray) -> np.ndarray:
    """For each two neighbours in the order, the bytes they share from their start, `depth` at most."""
    a, b = order[:-1], order[1:]
    shared = np.zeros(len(a), dtype=np.int64)
    alive = np.arange(len(a))
    for offset in range(0, block.depth, 8):
        x = block.words(a[alive], offset) ^ block.words(b[alive], offset)
        differ = x != 0
        stopped = alive[differ]
        if len(stopped):
            y = x[differ]
            bytes_equal = sum((y < np.uint64(1 << (8 * j))).astype(np.int64) for j in range(1, 8))
            shared[stopped] = offset + bytes_equal
        alive = alive[~differ]
        if not len(alive):
            break
    shared[alive] = block.depth
    return np.minimum(shared, np.minimum(block.depth, block.n - np.maximum(a, b)))


#: Stands between texts; UTF-8 has no such byte.
SEPARATOR = b"\xff"


def repeated_starts(texts: list[bytes], depth: int) -> np.ndarray:
    """Whether the `depth` bytes from each place of the separated texts also start at another place of them.

    A string that would cross the end of its text is never repeated.
    """
    data = SEPARATOR.join(texts) + SEPARATOR
    block = Block(data, depth)
    order = suffix_order(block)
    hit = np.zeros(block.n, dtype=bool)
    for a in range(0, len(order) - 1, _CHUNK):
        near = order[a : a + _CHUNK + 1]
        pair = common_prefixes(block, near) >= depth
        hit[near[:-1][pair]] = True
        hit[near[1:][pair]] = True
    end = 0
    for text in texts:
        start, end = end, end + len(text) + 1
        hit[max(start, end - depth) : end] = False
    return hit
