"""Maximal runs of sequences of integers, by the linear-time method of Gusfield and Stoye for tandem repeats.

1. The sequence falls into Lempel-Ziv blocks, each the longest that has started before.  The leftmost
   square of any kind can't lie inside one block, so common extensions around the block borders
   give pairs (start, period) that cover the leftmost squares of all kinds.
2. Each pair is a point of the suffix tree.  From there suffix links lead to the square's rotation
   (drop the first symbol, append it): all kinds of squares are found, each marked once.
3. The leaves under a marked point are the places of that kind of square; places of one period
   that follow each other are one maximal run.

Squares whose half is itself a power are left out before step 2, so that a run is found with its smallest period only, and the
places stay within n log n.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np


class SuffixTree:
    """The suffix tree of a sequence whose first and last element stand nowhere else, as arrays over nodes.

    Node r < n is the leaf of the suffix with rank r; nodes from n on are inner ones, the last of them the root.
    """

    def __init__(self, values: np.ndarray):
        self.names = [np.unique(values, return_inverse=True)[1].astype(np.int32)]
        self.n = n = len(values)
        self.text = self.names[0]
        while self.names[-1].max() < n - 1:
            last, step = self.names[-1].astype(np.int64), 1 << (len(self.names) - 1)
            after = np.zeros(n, dtype=np.int64)
            after[: n - step] = last[step:] + 1
            self.names.append(np.unique(last * (n + 1) + after, return_inverse=True)[1].astype(np.int32))
        self.rank = self.names.pop() if len(self.names) > 1 else self.names[0]
        self.order = np.empty(n, dtype=np.int32)
        self.order[self.rank] = np.arange(n, dtype=np.int32)
        self.shared = np.zeros(n + 1, dtype=np.int32)
        self.shared[1:n] = self.ahead(self.order[:-1], self.order[1:])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the suffixes at i and j (unequal) agree."""
        at, to = i.astype(np.int64), j.astype(np.int64)
        for k in reversed(range(len(self.names))):
            step = (self.names[k][at] == self.names[k][to]).astype(np.int64) << k
            at, to = at + step, to + step
        return at - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many elements up to i, itself included, agree with those up to j (unequal)."""
        at, to = i.astype(np.int64), j.astype(np.int64)
        for k in reversed(range(len(self.names))):
            a, b = at - (1 << k) + 1, to - (1 << k) + 1
            step = ((a >= 0) & (b >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])).astype(np.int64) << k
            at, to = at - step, to - step
        return i - at

    def blocks(self) -> np.ndarray:
        """The starts of the Lempel-Ziv blocks, and the end."""
        n, rank, order = self.n, memoryview(self.rank), memoryview(self.order)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        near = np.zeros((2, n), dtype=np.int32)
        lower, upper = memoryview(near[0]), memoryview(near[1])
        # Suffixes leave from the last start on: those left beside one in the order are the nearest with an earlier start.
        for i in range(n - 1, 0, -1):
            r = rank[i]
            p, q = left[r], right[r]
            lower[i] = order[p] if p >= 0 else i - 1
            upper[i] = order[q] if q < n else i - 1
            if p >= 0:
                right[p] = q
            if q < n:
                left[q] = p
        at = np.arange(n, dtype=np.int32)
        longest = np.maximum(self.ahead(at[1:], near[0][1:]), self.ahead(at[1:], near[1][1:]))
        jump = memoryview(np.maximum(np.concatenate([[1], longest]), 1))
        starts, i = [], 0
        while i < n:
            starts.append(i)
            i += jump[i]
        return np.array([*starts, n], dtype=np.int64)

    def grow(self) -> None:
        """Makes the nodes: parent, depth, low and high (ranks of their leaves), link, and children by first element."""
        n = self.n
        parent_of: list[int] = []
        depths, lows, highs = [0], [0], [n - 1]
        parent_of.append(-1)
        stack = [0]
        holder = np.zeros(n + 1, dtype=np.int32)  # the inner node that two neighbouring leaves meet in
        holds = memoryview(holder)
        for r, d in enumerate(self.shared[1:n].tolist(), 1):
            low, last = r - 1, -1
            while depths[stack[-1]] > d:
                if last >= 0:
                    parent_of[last] = stack[-1]
                last = stack.pop()
                highs[last] = r - 1
                low = lows[last]
            if depths[stack[-1]] < d:
                depths.append(d)
                lows.append(low)
                highs.append(0)
                parent_of.append(stack[-1])
                stack.append(len(depths) - 1)
            if last >= 0:
                parent_of[last] = stack[-1]
            holds[r] = stack[-1]
        while len(stack) > 1:
            last = stack.pop()
            highs[last] = n - 1
            parent_of[last] = stack[-1]
        inner = np.array(depths, dtype=np.int64)
        ranks = np.arange(n)
        deeper = np.where(self.shared[1 : n + 1] > self.shared[:n], holder[1 : n + 1], holder[:n])
        self.depth = np.concatenate([n - self.order.astype(np.int64), inner])
        self.low = np.concatenate([ranks, np.array(lows, dtype=np.int64)])
        self.high = np.concatenate([ranks, np.array(highs, dtype=np.int64)])
        self.parent = np.concatenate([deeper.astype(np.int64), np.array(parent_of, dtype=np.int64)])
        self.parent += n
        self.root = n
        self.parent[n] = n
        self._inner_key = self.low[n:] * (n + 1) + self.high[n:]
        self._by_key = np.argsort(self._inner_key)
        self._minima = [self.shared]
        while 2 << (len(self._minima) - 1) <= n:
            last, m = self._minima[-1], 1 << (len(self._minima) - 1)
            self._minima.append(np.minimum(last[:-m], last[m:]))
        link = np.full(len(self.depth), self.root, dtype=np.int64)
        here = self.order < n - 1
        link[:n][here] = self.rank[self.order[here] + 1]
        own = n + np.flatnonzero(inner > 1)
        if len(own):
            link[own] = self.points(self.rank[self.order[self.low[own]] + 1], self.depth[own] - 1)
        self.link = link
        nodes = np.arange(len(self.depth))
        nodes = nodes[nodes != self.root]
        first = self.text[self.order[self.low[nodes]] + self.depth[self.parent[nodes]]]
        by = np.lexsort((first, self.parent[nodes]))
        self.children, self.first = nodes[by], first[by]
        self.begin = np.searchsorted(self.parent[self.children], np.arange(len(self.depth) + 1))

    def points(self, rank: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The highest nodes whose strings start with the first `length` elements of the suffixes with these ranks."""
        low, high = rank.astype(np.int64), rank.astype(np.int64)
        for k in reversed(range(len(self._minima))):
            m, table = 1 << k, self._minima[k]
            at = low - m + 1
            low = np.where((at >= 1) & (table[np.maximum(at, 0)] >= length), low - m, low)
            at = high + 1
            inside = at + m <= self.n
            high = np.where(inside & (table[np.where(inside, at, 0)] >= length), high + m, high)
        key = low * (self.n + 1) + high
        slot = np.minimum(np.searchsorted(self._inner_key, key, sorter=self._by_key), len(self._by_key) - 1)
        return np.where(low == high, low, self.n + self._by_key[slot])


def leftmost_squares(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(starts, periods) of squares around block borders that cover the leftmost squares of all kinds; their halves are no powers."""
    border = tree.blocks()
    size = np.diff(border)
    begin, end = border[:-1], border[1:]
    n, text = tree.n, tree.text
    # Before the next block's start, by up to this block's length; after this block's start, by up to both blocks' lengths.
    both = size + np.append(size[1:], 0)
    pairs = []
    for anchor, reach, sign in ((end, size, -1), (begin, both, 1)):
        period = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach) + 1
        fixed = np.repeat(anchor, reach)
        moved = fixed + sign * period
        fits = (fixed < n) & (moved >= 0) & (moved < n)
        fixed, moved, period = fixed[fits], moved[fits], period[fits]
        same = text[fixed] == text[moved]
        fixed, moved, period = fixed[same], moved[same], period[same]
        near = np.minimum(fixed, moved)
        after = tree.ahead(fixed, moved)
        ahead_of = np.where(near > 0, tree.behind(np.maximum(fixed - 1, 0), np.maximum(moved - 1, 0)), 0)
        whole = after + ahead_of >= period
        start = np.maximum(near - ahead_of, near - period + 1)
        pairs.append(np.stack([start[whole], period[whole]]))
    start, period = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return _of_no_powers(tree, start, period)


def _of_no_powers(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the squares whose half isn't a power: no prime part of the period is a period as well."""
    if not len(start):
        return start, period
    least = np.arange(period.max() + 1)
    for p in range(2, int(len(least) ** 0.5) + 1):
        if least[p] == p:
            own = least[p * p :: p]
            own[own == np.arange(p * p, len(least), p)] = p
    keep, rest = np.ones(len(start), dtype=bool), period.copy()
    while True:
        at = np.flatnonzero(rest > 1)
        if not len(at):
            break
        prime = least[rest[at]]
        part = period[at] // prime
        keep[at] &= tree.ahead(start[at], start[at] + part) < 2 * period[at] - part
        while True:
            more = rest[at] % prime == 0
            if not more.any():
                break
            rest[at[more]] //= prime[more]
    return start[keep], period[keep]


def vocabulary(tree: SuffixTree, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, periods): the points of all kinds of squares that rotations of these lead to."""
    if not len(start):
        return start, period
    tree.grow()
    points = tree.points(tree.rank[start], 2 * period)
    order, text, low, depth, parent, link, begin = (memoryview(np.ascontiguousarray(x)) for x in (tree.order, tree.text, tree.low, tree.depth, tree.parent, tree.link, tree.begin))
    children, first = memoryview(tree.children), memoryview(tree.first)
    seen: set[tuple[int, int]] = set()
    for node, half in zip(points.tolist(), period.tolist()):
        length = 2 * half
        while (node, half) not in seen:
            seen.add((node, half))
            symbol = text[order[low[node]]]
            node = link[node]
            while depth[parent[node]] >= length - 1 and node != parent[node]:
                node = parent[node]
            if depth[node] == length - 1:
                a, b = begin[node], begin[node + 1]
                at = bisect_left(first, symbol, a, b)
                if at == b or first[at] != symbol:
                    break
                node = children[at]
            elif text[order[low[node]] + length - 1] != symbol:
                break
    found = np.array(list(seen), dtype=np.int64)
    return found[:, 0], found[:, 1]


def maximal_runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of all maximal runs of `values`, by period and start; the first and last value stand nowhere else."""
    none = np.empty(0, np.int64)
    if len(values) < 4:
        return none, none, none
    tree = SuffixTree(values)
    node, period = vocabulary(tree, *leftmost_squares(tree))
    if not len(node):
        return none, none, none
    low = tree.low[node]
    count = tree.high[node] - low + 1
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    width = np.int64(tree.n + 1)
    placed = np.sort(np.repeat(period, count) * width + tree.order[at])
    first = np.flatnonzero(np.concatenate([[True], np.diff(placed) != 1]))
    last = np.append(first[1:], len(placed)) - 1
    q = placed[first] // width
    return placed[first] % width, placed[last] - placed[first] + 2 * q, q
