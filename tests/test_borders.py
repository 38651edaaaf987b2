"""Outer borders of random drawings against a walk around the whole drawing."""

import random

import numpy as np
import pytest

from loamgraph.operators.borders import outer_rings

from . import by_hand


def rings_of(spark, segments):
    rows = [(k, *map(float, (*u, *v))) for k, (u, v) in enumerate(segments)]
    found = {}
    for r in outer_rings(spark.createDataFrame(rows, "sid long, ux double, uy double, vx double, vy double"), 0.3).collect():
        found.setdefault(r.ring, {})[r.pos] = (r.x, r.y)
    assert all(sorted(p) == list(range(len(p))) for p in found.values())
    return [[p[k] for k in range(len(p))] for p in found.values()]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def near(ring):
    return sorted({(round(x, 6), round(y, 6)) for x, y in ring})


@pytest.mark.parametrize("seed", range(3))
def test_random_drawing(spark, seed):
    rng = random.Random(seed)
    spots = [(rng.random(), rng.random()) for _ in range(9)]
    pairs = {tuple(sorted((k, rng.randrange(k)))) for k in range(1, 9)} | {tuple(sorted(rng.sample(range(9), 2))) for _ in range(6)}
    rings = rings_of(spark, [(spots[a], spots[b]) for a, b in pairs])
    want = by_hand.outer_border(np.array(spots), sorted(pairs))
    assert len(rings) == 1 and near(rings[0]) == near(want)
    assert area(rings[0]) == pytest.approx(abs(area(list(want)))) and area(rings[0]) > 0


def test_parts(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    around = list(zip(square, square[1:] + square[:1]))
    lone = [((3, 3), (4, 3))]
    inside = [((0.4, 0.4), (0.6, 0.6)), ((0.4, 0.6), (0.6, 0.4))]
    rings = rings_of(spark, [*around, around[0], ((0, 0), (1, 1)), *lone, *inside, ((5, 5), (5, 5))])
    assert len(rings) == 2
    big = max(rings, key=area)
    assert near(big) == near(square) and area(big) == 1
    assert near(min(rings, key=area)) == [(3.0, 3.0), (4.0, 3.0)]
    apart = rings_of(spark, [*around, *inside])
    assert sorted(map(len, apart)) == [4, 8]
