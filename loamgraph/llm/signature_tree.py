"""Signature trees: nodes with OR-combined bitmaps and size ranges, joined by dual traversal.

A set of n hashes has a bitmap of the next power of two of at least 2n bits, folded by OR to narrower
widths.  Elements that two sets share set the same bits, so the sets share at most the bits they have in
common plus the smaller number of elements that found their bit taken; for nodes, the OR
of the bitmaps and the largest such number bound all their pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FAN = 8


def width_of(n: int) -> int:
    return 1 << max(6, (2 * n - 1).bit_length())


def bitmap(hashes: np.ndarray) -> int:
    """The bitmap of sorted distinct hashes as an integer; its width follows from their number."""
    width = width_of(len(hashes))
    bits = np.zeros(width, dtype=np.uint8)
    bits[(hashes & np.uint64(width - 1)).astype(np.int64)] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def fold(bits: int, width: int, to: int) -> int:
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


class Node:
    __slots__ = ("bits", "width", "low", "high", "spare", "below", "item", "done")

    def __init__(self, bits: int, width: int, low: int, high: int, spare: int, below: list[Node], item: int):
        self.bits, self.width, self.low, self.high, self.spare, self.below, self.item, self.done = bits, width, low, high, spare, below, item, None


def build(sizes: list[int], bitmaps: list[int]) -> Node | None:
    """A tree over the sets: leaves ascend by size, each node combines up to FAN neighbours."""
    level = []
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i], bitmaps[i])):
        n, b = sizes[i], bitmaps[i]
        level.append(Node(b, width_of(n), n, n, n - b.bit_count(), [], i))
    while len(level) > 1:
        grown = []
        for a in range(0, len(level), FAN):
            own = level[a : a + FAN]
            if len(own) == 1:
                grown.append(own[0])
                continue
            width = min(x.width for x in own)
            bits = 0
            spare = 0
            for x in own:
                f = fold(x.bits, x.width, width)
                bits |= f
                # Folding makes more elements of a set share a bit; a folded inner node may have up to all.
                if x.width == width or not x.below:
                    spare = max(spare, x.spare + x.bits.bit_count() - f.bit_count())
                else:
                    spare = max(spare, x.high)
            grown.append(Node(bits, width, own[0].low, own[-1].high, spare, own, -1))
        level = grown
    return level[0] if level else None


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether some pair below the two nodes can be alike enough, by sizes and by the most that they can share."""
    if 100 * x.high < percent * y.low or 100 * y.high < percent * x.low:
        return False
    width = min(x.width, y.width)
    a = x.bits if x.width == width else fold(x.bits, x.width, width)
    b = y.bits if y.width == width else fold(y.bits, y.width, width)
    spare = []
    for node, bits in ((x, a), (y, b)):
        if node.width == width:
            spare.append(node.spare)
        else:
            spare.append(node.low - bits.bit_count() if not node.below else node.high)
    most = (a & b).bit_count() + min(spare)
    return (100 + percent) * min(most, x.high, y.high) >= percent * (x.low + y.low)


def dual_join(root: Node | None, percent: int, visit: Callable[[int, int], None], settled: Callable[[Node, Node], bool]) -> None:
    """Visits each pair of sets that no bound excludes, once; `settled` tells that a pair of nodes needs no look."""
    if root is None:
        return
    stack = [(root, root)]
    while stack:
        x, y = stack.pop()
        if x is y:
            if not x.below or settled(x, x):
                continue
            below = x.below
            for i in range(len(below) - 1, -1, -1):
                for j in range(len(below) - 1, i - 1, -1):
                    stack.append((below[i], below[j]))
            continue
        if settled(x, y) or not may_link(x, y, percent):
            continue
        if not x.below and not y.below:
            visit(x.item, y.item)
        elif x.below and (not y.below or x.high - x.low >= y.high - y.low):
            stack.extend((b, y) for b in reversed(x.below))
        else:
            stack.extend((x, b) for b in reversed(y.below))
