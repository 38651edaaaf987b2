"""Curvature, distances and criticality of random graphs against whole-graph and brute-force versions."""

import itertools
import random

import pytest

from loamgraph.operators import paths as P
from loamgraph.operators import transport as W

from . import by_hand


def graph(rng, n, m):
    pairs = rng.sample(list(itertools.combinations(range(n), 2)), m)
    return [(a, b, rng.choice([1, 2, 3, 5])) for a, b in sorted(pairs)]


def tables(spark, edges, n):
    e = spark.createDataFrame(edges, "a long, b long, rtt_us long")
    return e, spark.range(n), P.adjacency(e, "rtt_us")


@pytest.mark.parametrize("alpha, weighted", [(0.0, False), (0.5, False), (0.25, True)])
def test_ricci_of_several_graphs(spark, alpha, weighted):
    rng = random.Random(4)
    graphs = {k: graph(rng, 9, rng.randint(8, 20)) for k in range(4)}
    rows = spark.createDataFrame([(k, *e) for k, g in graphs.items() for e in g], "g long, a long, b long, rtt_us long")
    got = {(r.g, r.a, r.b): r.curvature for r in W.ricci(rows, ["g"], alpha=alpha, weighted=weighted).collect()}
    for k, g in graphs.items():
        want = by_hand.ricci_curvature(9, [e[:2] for e in g], alpha, [e[2] for e in g] if weighted else None)
        assert [got.pop((k, a, b)) for a, b, _ in g] == pytest.approx(want)
    assert not got


def test_ricci_by_mass_and_power(spark):
    g = graph(random.Random(7), 8, 14)
    e = spark.createDataFrame([(*x, 1 + (x[0] * 3 + x[1]) % 5) for x in g], "a long, b long, rtt_us long, throughput long")
    got = {(r.a, r.b): r.curvature for r in W.ricci(e, weighted=True, mass="throughput").collect()}
    want = by_hand.ricci_curvature(8, [x[:2] for x in g], 0.0, [x[2] for x in g], [1 + (x[0] * 3 + x[1]) % 5 for x in g])
    assert [got[x[:2]] for x in g] == pytest.approx(want)


def test_augmented(spark):
    g = [(a, b, 1) for a, b, _ in graph(random.Random(9), 9, 18)]
    for alpha in (0.0, 0.3):
        got = {(r.a, r.b): r.curvature for r in W.ricci(tables(spark, g, 9)[0], alpha=alpha, augmented=True).collect()}
        assert [got[x[:2]] for x in g] == pytest.approx(by_hand.augmented_curvature(9, [x[:2] for x in g], alpha))


def places_by_hand(route, near, length, u, v):
    """The pair of places of the first kind that the route has for (u, v), nearest to each other, the first of several."""
    kinds = [(lambda x: x != v and u in near[x], lambda x: x != u and v in near[x]), (lambda x: x != v and u in near[x], lambda x: x == v), (lambda x: x == u, lambda x: x != u and v in near[x]), (lambda x: x == u, lambda x: x == v)]
    at = [0]
    for a, b in zip(route, route[1:]):
        at.append(at[-1] + length[a, b])
    for k, (left, right) in enumerate(kinds):
        fits = [(at[j] - at[i], j, -i) for i in range(len(route)) for j in range(i, len(route)) if left(route[i]) and right(route[j])]
        if fits:
            gap, j, i = min(fits)
            return k, gap, route[-i], route[j]
    return None


@pytest.mark.parametrize("seed", range(3))
def test_traffic_curvatures(spark, seed):
    """Volumes are small, so the least cost is that of the best of all orders of unit loads."""
    rng = random.Random(seed)
    g = graph(rng, 7, 10)
    near, length = {x: set() for x in range(7)}, {}
    for a, b, w in g:
        near[a].add(b)
        near[b].add(a)
        length[a, b] = length[b, a] = w
    routes = []
    for k in range(6):
        walk = [rng.randrange(7)]
        while len(walk) < rng.randint(1, 7) and near[walk[-1]]:
            walk.append(rng.choice(sorted(near[walk[-1]])))
        routes.append((k, walk, rng.choice([0, 1, 1, 2])))
    e, nodes, adjacent = tables(spark, g, 7)
    distances = P.closure(adjacent, nodes)
    d = {(r.s, r.t): r.d for r in distances.collect()}
    paths = spark.createDataFrame(routes, "route_id long, route array<long>, volume long")
    pairs = adjacent.select("u", "v")
    plain = {(r.u, r.v): r.curvature for r in P.traffic_curvature(pairs, adjacent, distances, paths).collect()}
    moved = {(r.u, r.v): r.curvature for r in W.transport_curvature(pairs, adjacent, distances, paths).collect()}
    want_plain, want_moved = {}, {}
    for u, v in length:
        found = [(p, volume) for _, route, volume in routes if volume and (p := places_by_hand(route, near, length, u, v))]
        if not found:
            continue
        whole = sum(q for _, q in found)
        want_plain[u, v] = 1 - sum(q * (p[1] + (0, 1, 1, 2)[p[0]] * d[u, v]) for p, q in found) / whole / d[u, v]
        x = [p[2] for p, q in found for _ in range(q)]
        y = [p[3] for p, q in found for _ in range(q)]
        want_moved[u, v] = 1 - min(sum(d[a, b] for a, b in zip(x, order)) for order in set(itertools.permutations(y))) / whole / d[u, v]
    assert plain == pytest.approx(want_plain)
    assert moved == pytest.approx(want_moved)
    # A least cost is never above the routes' own, and equals it where all loads start or end at one node.
    assert all(moved[k] >= plain[k] - 1e-9 for k in plain)


def test_closure_and_criticality(spark):
    rng = random.Random(21)
    g = graph(rng, 9, 12)
    e, nodes, adjacent = tables(spark, g, 9)
    far = lambda edges: by_hand.hop_distances(9, [x[:2] for x in edges], [x[2] for x in edges])
    whole = far(g)
    got = {(r.s, r.t): r.d for r in P.closure(adjacent, nodes).collect()}
    assert got == {(s, t): whole[s, t] for s in range(9) for t in range(9) if whole[s, t] < float("inf")}
    loads = [(s, t, rng.randint(1, 9)) for s in range(9) for t in range(9) if s != t and rng.random() < 0.6]
    mean = lambda d: sum(q * d[s, t] for s, t, q in loads if d[s, t] < float("inf")) / sum(q for s, t, q in loads if d[s, t] < float("inf"))
    want = {x[:2]: mean(far([y for y in g if y != x])) - mean(whole) for x in g}
    found = {(r.a, r.b): r.growth for r in P.criticality(e, nodes, spark.createDataFrame(loads, "source long, target long, throughput long")).collect()}
    assert found == pytest.approx(want)
