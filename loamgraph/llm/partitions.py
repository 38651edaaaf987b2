"""Signatures of sets of hashes by parts: two sets that are alike enough agree on a whole part.

The sets of a band of sizes are cut into parts by their elements' hashes.  Sets that are alike enough differ in
at most d elements, so that at most d parts differ: of more than d parts, some are the same in both.
A part's signature is a hash of all its elements, so that only sets with a good deal in common share one, however
many sets there are and however frequent some of their elements.

Parts of fewer than `least` elements say little.  A set leaves them out as long as more than d of its parts are larger:
one of those is the same in the other set.  Few sets have to give all their parts, empty ones included.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .text import mix64

#: The sizes of a band span this ratio.
RATIO = 1.41


@lru_cache(maxsize=None)
def band_edge(i: int) -> int:
    """The smallest size of band i."""
    return 1 if i == 0 else max(band_edge(i - 1) + 1, int(band_edge(i - 1) * RATIO))


def differences(n: int, most: int, percent: int) -> int:
    """The most elements that a set of n and one of up to `most` can differ in, when alike enough."""
    return (n + max(n, min(most, 100 * n // percent))) * (100 - percent) // (100 + percent)


def _large_share(mean: float, least: int) -> float:
    """How many parts of a mean size have at least so many elements."""
    return 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(least))


@lru_cache(maxsize=None)
def plan(band: int, percent: int) -> tuple[int, int]:
    """(parts, least) of a band: as large parts as leave nearly every set with more than d of them."""
    low, high = band_edge(band), band_edge(band + 1) - 1
    need = differences(high, high, percent)
    most = 4 * (need + 1) + 8

    def enough(parts: int, least: int) -> bool:
        for n in (low, high):
            share = _large_share(n / parts, least)
            if parts * share - 3.5 * math.sqrt(parts * share * (1 - share)) <= differences(n, high, percent):
                return False
        return True

    for least in range(6, 0, -1):
        for parts in range(need + 1, max(need + 2, 2 * need), max(1, need // 50)):
            if enough(parts, least):
                return parts, least
    return next((parts for parts in range(need + 1, most) if enough(parts, 1)), most), 1


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of the sets' parts in all bands where a set may have to meet others.

    `sets`: sorted distinct hashes.  A set that only equal ones are alike to has none.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    owners: list[np.ndarray] = []
    found: list[np.ndarray] = []
    if not sizes.sum():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    edges = [1]
    while edges[-1] <= int(sizes.max()):
        edges.append(band_edge(len(edges)))
    own = np.searchsorted(np.array(edges), sizes, side="right") - 1
    for band in range(len(edges)):
        low, high = band_edge(band), band_edge(band + 1) - 1
        # Sets a little smaller than the band may be alike to sets in it.
        here = np.flatnonzero((sizes > 0) & ((own == band) | ((own < band) & (100 * sizes >= percent * low))))
        limit = np.array([differences(int(n), high, percent) for n in sizes[here]], dtype=np.int64)
        here, limit = here[limit > 0], limit[limit > 0]
        if not len(here):
            continue
        parts, least = plan(band, percent)
        flat = np.concatenate([sets[i] for i in here])
        owner = np.repeat(np.arange(len(here)), sizes[here])
        # Hashes ascend within a set, and so do their parts.
        part = ((flat >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        slot = owner * parts + part.astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        count = np.diff(np.append(starts, len(slot)))
        total = np.add.reduceat(mix64(flat ^ np.uint64(0xA0761D6478BD642F)), starts)
        slot = slot[starts]
        large = count >= least
        enough = np.bincount(slot[large] // parts, minlength=len(here)) > limit
        keep = large | ~enough[slot // parts]
        slots, totals = [slot[keep]], [total[keep]]
        for i in np.flatnonzero(~enough).tolist():
            empty = np.setdiff1d(np.arange(i * parts, (i + 1) * parts), slot)
            slots.append(empty)
            totals.append(np.zeros(len(empty), np.uint64))
        slot, total = np.concatenate(slots), np.concatenate(totals)
        name = mix64((slot % parts).astype(np.uint64) + np.uint64((band + 1) << 40))
        owners.append(here[slot // parts])
        found.append(mix64(total ^ name))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    owner, value = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(owner, kind="stable")
    return owner[order], value[order]
