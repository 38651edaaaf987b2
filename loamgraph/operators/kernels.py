"""Numerical kernels on numpy, each for one independent problem; the operators run them group by group."""

from __future__ import annotations

import heapq

import numpy as np


def transport_cost(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> float:
    """The least cost of moving `supply` to `demand` (equal sums), by successive shortest augmenting paths.

    Reduced costs stay non-negative under node potentials, so each path is a Dijkstra search over
    sources and sinks.
    """
    n, m = cost.shape
    left, need = supply.astype(float).copy(), demand.astype(float).copy()
    flow = np.zeros((n, m))
    pu, pv = np.zeros(n), cost.min(axis=0).astype(float)
    tol = 1e-12 * max(1.0, supply.sum())
    while left.max() > tol and need.max() > tol:
        du = np.where(left > tol, 0.0, np.inf)
        dv = np.full(m, np.inf)
        from_u, from_v = np.full(m, -1), np.full(n, -1)
        done_u, done_v = np.zeros(n, bool), np.zeros(m, bool)
        end = -1
        while True:
            a, b = np.where(done_u, np.inf, du), np.where(done_v, np.inf, dv)
            i, j = int(a.argmin()), int(b.argmin())
            if min(a[i], b[j]) == np.inf:
                break
            if b[j] <= a[i]:
                done_v[j] = True
                if need[j] > tol:
                    end = j
                    break
                step = dv[j] + np.where(flow[:, j] > tol, np.maximum(0, -(cost[:, j] + pu - pv[j])), np.inf)
                better = step < du
                du[better], from_v[better] = step[better], j
            else:
                done_u[i] = True
                step = du[i] + np.maximum(0, cost[i] + pu[i] - pv)
                better = step < dv
                dv[better], from_u[better] = step[better], i
        if end < 0:
            raise ValueError("supply and demand differ")
        far = dv[end]
        path, j = [], end
        while True:
            i = int(from_u[j])
            path.append((i, j, 1))
            if from_v[i] < 0 or left[i] > tol and du[i] == 0:
                break
            j = int(from_v[i])
            path.append((i, j, -1))
        amount = min([left[i], need[end], *(flow[x, y] for x, y, s in path if s < 0)])
        for x, y, s in path:
            flow[x, y] += s * amount
        left[i] -= amount
        need[end] -= amount
        pu += np.minimum(du, far)
        pv += np.minimum(dv, far)
    return float((flow * cost).sum())


def hop_distances(n: int, edges: list[tuple[int, int]], weights: list[float] | None = None) -> np.ndarray:
    """All-pairs shortest distances of an undirected graph; inf where there is no path."""
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for k, (a, b) in enumerate(edges):
        w = 1.0 if weights is None else float(weights[k])
        near[a].append((b, w))
        near[b].append((a, w))
    out = np.full((n, n), np.inf)
    for s in range(n):
        out[s, s] = 0
        queue = [(0.0, s)]
        while queue:
            d, v = heapq.heappop(queue)
            if d > out[s, v]:
                continue
            for x, w in near[v]:
                if d + w < out[s, x]:
                    out[s, x] = d + w
                    heapq.heappush(queue, (d + w, x))
    return out


def minimise(value_and_slope, start: np.ndarray, low=None, high=None, memory: int = 8, rounds: int = 200, tolerance: float = 1e-8) -> np.ndarray:
    """A minimum within bounds: limited-memory quasi-Newton steps, projected, with backtracking."""
    clip = lambda x: np.clip(x, low, high) if low is not None or high is not None else x
    x = clip(start.astype(float))
    f, g = value_and_slope(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(clip(x - g) - x).max() < tolerance:
            break
        free = np.ones(len(x), bool)
        if low is not None:
            free &= ~((x <= low) & (g > 0))
        if high is not None:
            free &= ~((x >= high) & (g < 0))
        q = np.where(free, g, 0)
        kept = []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            kept.append(a)
            q = q - a * y
        if pairs:
            s, y = pairs[-1]
            q = q * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept)):
            q = q + s * (a - (y @ q) / (s @ y))
        direction = -np.where(free, q, 0)
        if direction @ g >= 0:
            direction, pairs = -np.where(free, g, 0), []
        step = 1.0 if pairs else min(1.0, 1.0 / (np.abs(g).sum() + 1e-300))
        for _ in range(40):
            new = clip(x + step * direction)
            f2, g2 = value_and_slope(new)
            if f2 <= f + 1e-4 * (g @ (new - x)):
                break
            step /= 2
        else:
            if not pairs:
                break
            pairs = []
            continue
        s, y = new - x, g2 - g
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-memory:]
        moved = np.abs(s).max()
        x, f, g = new, f2, g2
        if moved < 1e-14:
            break
    return x


def bounded_least_squares(a: np.ndarray, b: np.ndarray, low: np.ndarray) -> np.ndarray:
    """x >= low with the least |a x - b|."""

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        r = a @ x - b
        return 0.5 * float(r @ r), a.T @ r

    return minimise(loss, low.copy(), low=low, rounds=500, tolerance=1e-9)


def traffic_from_links(routing: np.ndarray, links: np.ndarray, prior: np.ndarray, weight: float = 0.01) -> np.ndarray:
    """Traffic shares of routes that fit the links' shares and stay near a prior: squares plus weight**2 times relative entropy.

    The start is the normalised prior; the result sums to 1 and is never worse than the start.
    """
    start = np.clip(prior / prior.sum(), 1e-12, 1)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        r = routing @ x - links
        ratio = np.log2(x / start)
        return float(r @ r + weight**2 * (x @ ratio)), 2 * routing.T @ r + weight**2 * (ratio + 1 / np.log(2))

    x = minimise(loss, start, low=1e-12, high=1.0)
    return x / x.sum()


def complete_matrix(values: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Missing cells from column means, then `rounds` times from the matrix without its noise-sized singular values.

    A singular value is noise below 0.56 b**3 - 0.95 b**2 + 1.82 b + 1.43 medians, b being the sides' ratio.
    """
    gone = np.isnan(values)
    means = np.where((~gone).any(axis=0), np.nansum(np.where(gone, 0, values), axis=0) / np.maximum((~gone).sum(axis=0), 1), 0.0)
    full = np.where(gone, means[None, :], values)
    b = min(values.shape) / max(values.shape)
    factor = 0.56 * b**3 - 0.95 * b**2 + 1.82 * b + 1.43
    low = full
    for _ in range(rounds):
        u, s, v = np.linalg.svd(full, full_matrices=False)
        s = np.where(s > factor * np.median(s), s, 0.0)
        low = (u * s) @ v
        full = np.where(gone, low, values)
    return np.where(~gone & (values != 0), values, np.maximum(low, 0))


def changepoints(z: np.ndarray) -> list[int]:
    """Starts of segments, each Gaussian with its own mean and variance; of all numbers of segments, the least BIC.

    A single value has a log likelihood of 0, and longer segments of one value only are excluded.  BIC adds 2 ln n for each
    segment, so that one pass over the ends finds the least over all numbers, in time n * n and memory n.
    """
    n = len(z)
    if n < 2:
        return [0]
    z = z - z.mean()
    s, q = np.concatenate([[0], np.cumsum(z)]), np.concatenate([[0], np.cumsum(z * z)])
    same = np.concatenate([[0], np.maximum.accumulate(np.where(z[1:] != z[:-1], np.arange(1, n), 0))])
    best, back = np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for j in range(1, n + 1):
        i = np.arange(j)
        m = j - i
        var = (q[j] - q[:j]) / m - ((s[j] - s[:j]) / m) ** 2
        var[same[j - 1] :] = 0
        cost = np.where(var > 0, m * (np.log(2 * np.pi * np.where(var > 0, var, 1)) + 1), np.inf)
        cost[-1] = 0
        total = best[:j] + cost
        at = int(total.argmin())
        best[j], back[j] = total[at] + 2 * np.log(n), at
    cuts, j = [], n
    while j:
        j = int(back[j])
        cuts.append(j)
    return cuts[::-1]


def segment_means(z: np.ndarray) -> np.ndarray:
    cuts = changepoints(z)
    out = np.empty(len(z))
    for a, b in zip(cuts, [*cuts[1:], len(z)]):
        out[a:b] = z[a:b].mean()
    return out


def convex_hull(points: np.ndarray) -> list[int]:
    """Indices of the hull's corners, counter-clockwise from the lowest leftmost."""
    order = sorted(range(len(points)), key=lambda i: (points[i, 0], points[i, 1], i))
    if len(order) < 3:
        return order

    def chain(ids) -> list[int]:
        out: list[int] = []
        for i in ids:
            while len(out) > 1:
                a, b = points[out[-1]] - points[out[-2]], points[i] - points[out[-1]]
                if a[0] * b[1] - a[1] * b[0] > 0:
                    break
                out.pop()
            out.append(i)
        return out[:-1]

    return chain(order) + chain(order[::-1])


def _mesh_matrices(points: np.ndarray, faces: np.ndarray):
    """Cotangent Laplacian (negative semi-definite), vertex areas, and per-face gradients and divergences."""
    n = len(points)
    lap, area_of = np.zeros((n, n)), np.zeros(n)
    a, b, c = (points[faces[:, k]] for k in range(3))
    normal = np.cross(b - a, c - a)
    double = np.linalg.norm(normal, axis=1)
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        p, q, r = points[faces[:, i]], points[faces[:, j]], points[faces[:, k]]
        cot = ((p - r) * (q - r)).sum(1) / double
        np.add.at(lap, (faces[:, i], faces[:, j]), cot / 2)
        np.add.at(lap, (faces[:, j], faces[:, i]), cot / 2)
        np.add.at(lap, (faces[:, i], faces[:, i]), -cot / 2)
        np.add.at(lap, (faces[:, j], faces[:, j]), -cot / 2)
        np.add.at(area_of, faces[:, i], double / 6)
    return lap, area_of, normal / double[:, None], double


def heat_distances(points: np.ndarray, faces: np.ndarray, source: int) -> np.ndarray:
    """Geodesic distances from a vertex: a short flow of heat, its unit gradient, and the field with that gradient."""
    lap, area, unit, double = _mesh_matrices(points, faces)
    edge = np.concatenate([np.linalg.norm(points[faces[:, i]] - points[faces[:, j]], axis=1) for i, j in ((0, 1), (1, 2), (2, 0))])
    hot = np.zeros(len(points))
    hot[source] = 1
    u = np.linalg.solve(np.diag(area) - edge.mean() ** 2 * lap, hot)
    grad = np.zeros((len(faces), 3))
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        grad += u[faces[:, i]][:, None] * np.cross(unit, points[faces[:, k]] - points[faces[:, j]])
    grad /= double[:, None]
    field = -grad / np.maximum(np.linalg.norm(grad, axis=1), 1e-300)[:, None]
    div = np.zeros(len(points))
    for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
        p, q, r = points[faces[:, i]], points[faces[:, j]], points[faces[:, k]]
        cot_r, cot_q = ((p - r) * (q - r)).sum(1) / double, ((p - q) * (r - q)).sum(1) / double
        np.add.at(div, faces[:, i], 0.5 * (cot_r * ((q - p) * field).sum(1) + cot_q * ((r - p) * field).sum(1)))
    phi = np.linalg.lstsq(lap, div, rcond=None)[0]
    return phi - phi[source]


def grid_faces(side: int) -> np.ndarray:
    i, j = np.meshgrid(np.arange(side - 1), np.arange(side - 1), indexing="ij")
    v = (i * side + j).ravel()
    return np.concatenate([np.stack([v, v + side + 1, v + 1], 1), np.stack([v, v + side, v + side + 1], 1)])


def infer_routes(n: int, edges: list[tuple[int, int]], bounds: np.ndarray, rtts: dict[tuple[int, int], float], rounds: int = 10) -> tuple[dict[tuple[int, int], list[int]], np.ndarray, float]:
    """Routes and edge latencies that explain round trips.

    In turn, each pair takes the path whose latency is nearest its round trip, among paths that come closer to
    their end with each hop; then latencies of at least `bounds` fit the round trips by least squares.  The best
    fit (r2) of all rounds is kept; rounds end when latencies rest.
    """
    index = {e: k for k, e in enumerate(edges)} | {(b, a): k for k, (a, b) in enumerate(edges)}
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    latency = bounds.astype(float).copy()
    best: tuple[dict, np.ndarray, float] = ({}, latency, -np.inf)
    for _ in range(rounds):
        distance = hop_distances(n, edges, list(latency))
        routes: dict[tuple[int, int], list[int]] = {}
        for (s, t), rtt in sorted(rtts.items()):
            if not np.isfinite(distance[s, t]):
                continue
            miss, found = np.inf, None
            stack = [([s], 0.0)]
            while stack:
                path, total = stack.pop()
                v = path[-1]
                if v == t:
                    if abs(total - rtt) < miss:
                        miss, found = abs(total - rtt), path
                    continue
                if total + distance[v, t] - rtt >= miss:
                    continue
                for x in sorted(near[v], reverse=True):
                    if distance[x, t] < distance[v, t]:
                        stack.append(([*path, x], total + latency[index[v, x]]))
            if found:
                routes[s, t] = found
        if not routes:
            return best
        keys = sorted(routes)
        a = np.zeros((len(keys), len(edges)))
        for r, key in enumerate(keys):
            for u, v in zip(routes[key], routes[key][1:]):
                a[r, index[u, v]] += 1
        b = np.array([rtts[k] for k in keys])
        new = bounded_least_squares(a, b, bounds)
        fit = a @ new
        r2 = float(np.corrcoef(fit, b)[0, 1] ** 2) if len(b) > 1 and fit.std() > 0 and b.std() > 0 else 0.0
        if r2 > best[2]:
            best = (routes, new, r2)
        if np.allclose(new, latency, rtol=1e-9):
            break
        latency = new
    return best


def commute_distances(n: int, edges: list[tuple[int, int]], weights: list[float] | None = None) -> np.ndarray:
    """Mean steps of a random walk from each node to each other and back, by the Laplacian's pseudo-inverse; inf if apart."""
    lap = np.zeros((n, n))
    for k, (a, b) in enumerate(edges):
        w = 1.0 if weights is None else float(weights[k])
        lap[a, a] += w
        lap[b, b] += w
        lap[a, b] -= w
        lap[b, a] -= w
    inverse = np.linalg.pinv(lap)
    spread = np.diag(inverse)[:, None] + np.diag(inverse)[None, :] - 2 * inverse
    return np.where(np.isfinite(hop_distances(n, edges)), spread * np.trace(lap), np.inf)
