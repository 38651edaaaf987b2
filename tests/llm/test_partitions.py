import numpy as np
import pytest

from loamgraph.llm.partitions import band_edge, differences, plan, signatures


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_alike_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    pairs = 0
    for _ in range(800):
        x = np.unique(rng.integers(0, 2**64, int(np.exp(rng.uniform(0, 6.5))), dtype=np.uint64))
        gone = rng.integers(0, max(1, len(x) * (100 - percent) // 100) + 1)
        y = rng.permutation(x)[: len(x) - gone]
        more = 0
        while 100 * len(y) >= percent * (len(x) + more + 1) and rng.random() > 0.02:
            more += 1
        y = np.unique(np.concatenate([y, rng.integers(0, 2**64, more, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or np.array_equal(x, y) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        pairs += 1
        owner, value = signatures([x, y], percent)
        assert len(np.intersect1d(value[owner == 0], value[owner == 1]))
    assert pairs > 100


def test_small_and_empty_sets():
    one, two = np.array([5], np.uint64), np.array([5, 2**63], np.uint64)
    assert all(len(x) == 0 for x in signatures([], 80))
    assert all(len(x) == 0 for x in signatures([np.empty(0, np.uint64)], 80))
    # Sets of one or two elements are alike at 80 % only when equal.
    assert all(len(x) == 0 for x in signatures([one, two], 80))
    owner, value = signatures([one, two], 50)
    assert len(np.intersect1d(value[owner == 0], value[owner == 1]))


def test_unlike_sets_rarely_meet():
    rng = np.random.default_rng(9)
    # Each two sets share a third of their elements.
    common = rng.integers(0, 2**64, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(0, 2**64, 200, dtype=np.uint64)])) for _ in range(200)]
    owner, value = signatures(sets, 90)
    assert len(np.unique(value)) > 0.98 * len(value)
    assert len(value) < 0.4 * sum(map(len, sets))


def test_bands():
    edges = [band_edge(i) for i in range(30)]
    assert edges == sorted(set(edges)) and edges[0] == 1
    assert differences(100, 100, 90) == 10
    assert all(plan(i, 80)[0] > differences(edges[i + 1] - 1, edges[i + 1] - 1, 80) for i in range(29))
