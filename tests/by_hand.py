"""Whole graphs in one place, to hold the operators against."""

import numpy as np

from loamgraph.operators.kernels import hop_distances, transport_cost


def ricci_curvature(n: int, edges: list[tuple[int, int]], alpha: float = 0.0, weights: list[float] | None = None, mass: list[float] | None = None, power: float = 0.0) -> list[float]:
    """(1 - W1 / d) / (1 - alpha) of each edge: how much nearer the neighbourhoods are than their centres.

    A node spreads 1 - alpha over its neighbours, in proportion to edge `mass` (even without; divided by distance to the
    `power`), and keeps alpha.
    """
    distance = hop_distances(n, edges, weights)
    share = np.zeros((n, n))
    for k, (a, b) in enumerate(edges):
        value = 1.0 if mass is None else float(mass[k])
        if power:
            value /= distance[a, b] ** power
        share[a, b] += value
        share[b, a] += value
    total = share.sum(axis=1)
    spread = np.divide(share, total[:, None], out=np.zeros_like(share), where=total[:, None] > 0) * (1 - alpha)
    spread[np.arange(n), np.arange(n)] += np.where(total > 0, alpha, 1.0)
    out = []
    for k, (a, b) in enumerate(edges):
        x, y = np.flatnonzero(spread[a]), np.flatnonzero(spread[b])
        d = 1.0 if weights is None else float(weights[k])
        out.append((1 - transport_cost(spread[a, x], spread[b, y], distance[np.ix_(x, y)]) / d) / (1 - alpha))
    return out


def augmented_curvature(n: int, edges: list[tuple[int, int]], alpha: float = 0.0) -> list[float]:
    """Edge curvature where each end sees the other only through a copy of it that hangs on the end itself.

    The copy (x, y) lies d(x, y) beyond x, so the shares of x and y for each other travel over both ends.
    """
    distance = hop_distances(n, edges)
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    out = []
    for a, b in edges:
        sides = []
        for x, y in ((a, b), (b, a)):
            # Places as (node, extra length beyond it).
            places = [(z, 0.0) for z in near[x] if z != y] + [(x, distance[x, y])]
            masses = [(1 - alpha) / len(places)] * len(places)
            sides.append(([*places, (x, 0.0)], np.array([*masses, alpha])))
        cost = np.array([[distance[p, q] + s + t for q, t in sides[1][0]] for p, s in sides[0][0]])
        d = distance[a, b]
        out.append((1 - transport_cost(sides[0][1], sides[1][1], cost) / d) / (1 - alpha))
    return out


def vertex_cover(pairs: list[tuple]) -> list:
    """Greedy: again and again the end of most remaining pairs, the earliest seen of several."""
    left, out = list(pairs), []
    while left:
        count: dict = {}
        for a, b in left:
            count[a] = count.get(a, 0) + 1
            count[b] = count.get(b, 0) + 1
        best = max(count, key=count.__getitem__)
        out.append(best)
        left = [p for p in left if best not in p]
    return out


def set_cover(sets: dict, universe: set) -> list:
    """Greedy: again and again the set that adds most, the smallest name of several."""
    left, out = set(universe), []
    while left:
        best = max(sorted(sets), key=lambda k: len(sets[k] & left))
        if not sets[best] & left:
            break
        out.append(best)
        left -= sets[best]
    return out


def outer_border(points: np.ndarray, edges: list[tuple[int, int]]) -> list[tuple[float, float]]:
    """The outer border of a drawn graph: edges are cut where they cross, then the walk keeps to its rightmost turn.

    Only the component with the leftmost point is walked.
    """
    places = {tuple(p): i for i, p in enumerate(points.tolist())}
    nodes = [tuple(p) for p in points.tolist()]
    near: dict[int, set[int]] = {}
    for k, (a, b) in enumerate(edges):
        p, d = points[a], points[b] - points[a]
        cuts = [(0.0, a), (1.0, b)]
        for m, (c, e) in enumerate(edges):
            if m == k or {a, b} & {c, e}:
                continue
            r, f = points[c], points[e] - points[c]
            det = d[0] * f[1] - d[1] * f[0]
            if abs(det) < 1e-15:
                continue
            t = ((r[0] - p[0]) * f[1] - (r[1] - p[1]) * f[0]) / det
            u = ((r[0] - p[0]) * d[1] - (r[1] - p[1]) * d[0]) / det
            if 0 < t < 1 and 0 < u < 1:
                first = min(k, m)
                x = points[edges[first][0]]
                y = points[edges[first][1]] - x
                w = t if first == k else u
                spot = (round(float(x[0] + w * y[0]), 12), round(float(x[1] + w * y[1]), 12))
                if spot not in places:
                    places[spot] = len(nodes)
                    nodes.append(spot)
                cuts.append((t, places[spot]))
        cuts.sort()
        for (_, x), (_, y) in zip(cuts, cuts[1:]):
            if x != y:
                near.setdefault(x, set()).add(y)
                near.setdefault(y, set()).add(x)
    if not near:
        return []
    start = min(near, key=lambda i: nodes[i])
    at, heading, walk = start, np.pi, []
    first = None
    for _ in range(4 * sum(map(len, near.values())) + 4):
        def turn(j: int) -> float:
            angle = np.arctan2(nodes[j][1] - nodes[at][1], nodes[j][0] - nodes[at][0])
            return (angle - heading - 1e-12) % (2 * np.pi)

        after = min(near[at], key=lambda j: (turn(j), j))
        if first == (at, after):
            break
        first = first or (at, after)
        walk.append(nodes[at])
        heading = np.arctan2(nodes[at][1] - nodes[after][1], nodes[at][0] - nodes[after][0])
        at = after
    return walk
