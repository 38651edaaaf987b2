"""Numerical kernels against closed forms and brute force."""

import itertools

import numpy as np
import pytest

from loamgraph.operators import kernels as K

from . import by_hand


@pytest.mark.parametrize("n", [3, 4, 5, 7])
def test_complete_graphs(n):
    edges = list(itertools.combinations(range(n), 2))
    assert np.allclose(by_hand.ricci_curvature(n, edges), (n - 2) / (n - 1))
    assert np.allclose(by_hand.ricci_curvature(n, edges, alpha=0.9999), n / (n - 1), atol=1e-3)


def test_two_islands():
    edges = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (1, 4)]
    assert np.allclose(by_hand.ricci_curvature(6, edges), [1 / 3, 1 / 3, 1 / 2, 1 / 3, 1 / 3, 1 / 2, -2 / 3])


@pytest.mark.parametrize("seed", range(20))
def test_transport_is_least(seed):
    rng = np.random.default_rng(seed)
    n = 5
    cost = rng.random((n, n))
    even = np.full(n, 1 / n)
    least = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) / n
    assert abs(K.transport_cost(even, even, cost) - least) < 1e-9
    a, b = rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n))
    assert abs(K.transport_cost(a, b, cost) - K.transport_cost(b, a, cost.T)) < 1e-9


def test_changepoints_and_matrix():
    rng = np.random.default_rng(1)
    z = np.concatenate([rng.normal(0, 1, 40), rng.normal(9, 1, 40), rng.normal(3, 1, 40)])
    cuts = K.changepoints(z)
    assert 0 in cuts and any(abs(c - 40) <= 1 for c in cuts) and any(abs(c - 80) <= 1 for c in cuts)
    m = np.outer(rng.random(12) + 1, rng.random(10) + 1)
    holes = m.copy()
    holes[rng.random(m.shape) < 0.15] = np.nan
    gone = np.isnan(holes)
    assert np.array_equal(K.complete_matrix(holes)[~gone], m[~gone])
    assert np.abs(K.complete_matrix(holes) - m)[gone].mean() < np.abs(np.nanmean(holes, axis=0) - m)[gone].mean() + 0.2


def test_bounds_are_kept():
    rng = np.random.default_rng(2)
    a, low = rng.random((20, 5)), np.full(5, 0.5)
    b = a @ np.array([0.2, 1.0, 2.0, 0.1, 3.0])
    x = K.bounded_least_squares(a, b, low)
    assert (x >= low - 1e-12).all()
    assert ((a @ x - b) ** 2).sum() <= ((a @ low - b) ** 2).sum()
    routing = np.array([[1, 1, 0], [0, 1, 1]], float)
    prior = np.array([0.2, 0.3, 0.5])
    share = K.traffic_from_links(routing, routing @ np.array([0.6, 0.1, 0.3]), prior)
    assert abs(share.sum() - 1) < 1e-9 and (share > 0).all()


def test_heat():
    side = 16
    i, j = np.divmod(np.arange(side * side), side)
    flat = np.column_stack([i, j, 0 * i]) / (side - 1)
    d = K.heat_distances(flat, K.grid_faces(side), 100)
    true = np.linalg.norm(flat - flat[100], axis=1)
    assert np.corrcoef(d, true)[0, 1] > 0.98 and abs(d[100]) < 1e-12


def test_planar():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]])
    assert K.convex_hull(square) == [0, 1, 2, 3]
    walk = by_hand.outer_border(np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float), [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3)])
    assert set(walk) == {(0, 0), (2, 0), (2, 2), (0, 2)}
    assert by_hand.vertex_cover([(1, 2), (1, 3), (4, 5)]) == [1, 4]
    assert by_hand.set_cover({"a": {1, 2}, "b": {2, 3}, "c": {3}}, {1, 2, 3}) == ["a", "b"]


def test_routes_explain_round_trips():
    edges = [(0, 1), (1, 2), (0, 2)]
    routes, latency, r2 = K.infer_routes(3, edges, np.array([1.0, 1.0, 5.0]), {(0, 1): 2.0, (1, 2): 3.0, (0, 2): 5.0})
    assert (latency >= np.array([1.0, 1.0, 5.0]) - 1e-9).all() and r2 > 0.99 and routes[0, 1] == [0, 1]


@pytest.mark.parametrize("n", [4, 5, 6])
def test_augmented_complete_graphs(n):
    edges = list(itertools.combinations(range(n), 2))
    assert np.allclose(by_hand.augmented_curvature(n, edges), (n - 4) / (n - 1))


def test_commute_on_a_path():
    d = K.commute_distances(3, [(0, 1), (1, 2)])
    assert np.allclose(d, [[0, 4, 8], [4, 0, 4], [8, 4, 0]])


def _bic(z, cuts):
    total = 0.0
    for a, b in zip(cuts, [*cuts[1:], len(z)]):
        v = z[a:b].var()
        total += 0 if b - a == 1 else (b - a) * (np.log(2 * np.pi * v) + 1) if v > 0 else np.inf
    return total + 2 * len(cuts) * np.log(len(z))


@pytest.mark.parametrize("seed", range(8))
def test_changepoints_have_the_least_bic(seed):
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 1, 9) + 40 * rng.integers(0, 3, 9)
    every = [[0, *c] for k in range(9) for c in itertools.combinations(range(1, 9), k)]
    assert abs(_bic(z, K.changepoints(z)) - min(_bic(z, c) for c in every)) < 1e-6


def test_more_than_ten_levels():
    rng = np.random.default_rng(5)
    levels = np.repeat(np.arange(16) % 2 * 500.0 + np.arange(16) * 40, 20)
    z = levels + rng.normal(0, 1, len(levels))
    assert set(range(0, 320, 20)) <= set(K.changepoints(z))
    assert np.abs(K.segment_means(z) - levels).max() < 4
    assert K.changepoints(np.full(4, 7.0)) == [0, 1, 2, 3] and K.segment_means(np.full(4, 7.0)).tolist() == [7.0] * 4
