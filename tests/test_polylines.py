"""Lines on meshes: straight on a plane, never longer than the trace, never shorter than the chord."""

import heapq
import itertools
import random

import numpy as np
import pytest

from loamgraph.operators import mesh as M
from loamgraph.operators.kernels import grid_faces
from loamgraph.operators.polylines import polylines, taut
from loamgraph.functions.geo import lit
from pyspark.sql import functions as F


def shortest(near, s, t):
    far, before, queue = {s: 0.0}, {}, [(0.0, s)]
    while queue:
        d, a = heapq.heappop(queue)
        if d > far[a]:
            continue
        for b, w in near[a].items():
            if d + w < far.get(b, float("inf")):
                far[b], before[b] = d + w, a
                heapq.heappush(queue, (d + w, b))
    path = [t]
    while path[-1] != s:
        path.append(before[path[-1]])
    return far[t], path[::-1]


@pytest.mark.parametrize("seed", range(30))
def test_taut_lines(seed):
    rng, fine = random.Random(seed), np.random.default_rng(seed)
    side = rng.choice([3, 5, 8])
    i, j = np.divmod(np.arange(side * side), side)
    flat = seed % 2 == 0
    points = np.column_stack([i, j, 0 * i if flat else fine.random(side * side) * side / 3]) / (side - 1)
    inner = (i > 0) & (j > 0) & (i < side - 1) & (j < side - 1)
    points[inner, :2] += fine.uniform(-0.2, 0.2, (inner.sum(), 2)) / (side - 1)
    faces = grid_faces(side)
    near = {}
    for a, b in itertools.chain.from_iterable(itertools.permutations(f.tolist(), 2) for f in faces):
        near.setdefault(a, {})[b] = float(np.linalg.norm(points[a] - points[b]))
    s, t = rng.sample(range(side * side), 2)
    trace, path = shortest(near, s, t)
    line = np.array(taut(path, faces, dict(enumerate(points))))
    length = np.linalg.norm(np.diff(line, axis=0), axis=1).sum()
    chord = np.linalg.norm(points[s] - points[t])
    assert np.allclose(line[[0, -1]], points[[s, t]])
    assert chord - 1e-9 <= length <= trace + 1e-9
    if flat:
        assert length == pytest.approx(chord)


def test_routes(spark):
    v = M.grid(spark, 5, 5, lit(0.2) * F.col("x") * F.col("y"))
    ways = spark.createDataFrame([(1, [0, 24]), (2, [0, 12, 3]), (3, [7, 7]), (4, [0, 99])], "route_id long, stops array<long>")
    got = {r.route_id: r for r in polylines(ways, M.faces(spark, 5, 5).select("u", "v", "w"), v.select("vid", "x", "y", "z")).collect()}
    assert sorted(got) == [1, 2, 3] and len(got[3].points) == 1 and got[3].length == 0
    for k, (a, b) in ((1, ((0, 0, 0), (1, 1, 0.2))), (2, ((0, 0, 0), (0, 0.75, 0)))):
        first, last = got[k].points[0], got[k].points[-1]
        assert tuple(first) == pytest.approx(a) and tuple(last) == pytest.approx(b)
        assert np.linalg.norm(np.subtract(a, b)) - 1e-9 <= got[k].length <= got[k].trace + 1e-9
    # Waypoints only shape the trace: the line between the ends is straight where the surface is.
    assert got[2].length == pytest.approx(0.75)
