"""Vertices put into meshes: the surface, its area and Euler's number stay, and the given mesh comes back."""

import random

import pytest

from loamgraph.functions.geo import lit
from loamgraph.operators import insertion as I
from loamgraph.operators import mesh as M
from pyspark.sql import functions as F


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


@pytest.mark.parametrize("epsilon", [0.0, 1e-6])
def test_insertion(spark, epsilon):
    rng = random.Random(8)
    side = 5
    v = M.grid(spark, side, side, F.col("x") * F.col("x") - lit(0.5) * F.col("y"))
    f = M.faces(spark, side, side)
    # Many in one face, repeated, on sides (of both kinds), at corners, on the border, and nowhere.
    spots = [(rng.uniform(0.26, 0.49), rng.uniform(0.01, 0.24)) for _ in range(12)]
    spots += [spots[0], (0.375, 0.25), (0.375, 0.25), (0.375, 0.375), (0.5, 0.5), (0.0, 0.125), (1.0, 1.0), (0.3125, 0.3125)]
    spots += [(rng.random(), rng.random()) for _ in range(15)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate([*spots, (1.5, 0.5)])], "pid long, x double, y double")
    made = I.insert(points.join(M.locate(points, f, v, side, side), "pid"), f, v, epsilon)
    faces = {r.fid: (r.u, r.v, r.w) for r in made.faces.collect()}
    at = {r.vid: (r.x, r.y, r.z) for r in made.vertices.collect()}
    placed = {r.pid: r.vid for r in made.placed.collect()}
    assert set(placed) == set(range(len(spots)))
    for k, p in enumerate(spots):
        assert at[placed[k]][:2] == pytest.approx(p, abs=1e-6)
    assert placed[0] == placed[12] and placed[13] == placed[14] and placed[16] == 12 and placed[18] == 24
    areas = [turn(*(at[c] for c in corners)) / 2 for corners in faces.values()]
    assert min(areas) > 0 and sum(areas) == pytest.approx(1.0)
    edges = {tuple(sorted(e)) for a, b, c in faces.values() for e in ((a, b), (b, c), (c, a))}
    assert len(at) - len(edges) + len(faces) == 1
    assert len(at) == side * side + len({tuple(p) for p in spots}) - 2
    # Each side has a face or two, and none on the inside is left open.
    used = [tuple(e) for a, b, c in faces.values() for e in ((a, b), (b, c), (c, a))]
    assert len(used) == len(set(used))
    for x, y, z in at.values():
        i, j = min(int(x * 4), 3), min(int(y * 4), 3)
        p, q = x * 4 - i, y * 4 - j
        h = lambda a, b: ((i + a) / 4) ** 2 - 0.5 * (j + b) / 4  # noqa: B023, E731
        flat = h(0, 0) + (p * (h(1, 0) - h(0, 0)) + q * (h(1, 1) - h(1, 0)) if p >= q else q * (h(0, 1) - h(0, 0)) + p * (h(1, 1) - h(0, 1)))
        assert z == pytest.approx(flat, abs=1e-6)
    back = {(r.fid, r.u, r.v, r.w) for r in made.removed().collect()}
    assert back == {tuple(r) for r in f.collect()}


def test_no_points(spark):
    v, f = M.grid(spark, 3, 3), M.faces(spark, 3, 3)
    made = I.insert(spark.createDataFrame([], "pid long, x double, y double, fid long"), f, v)
    assert made.faces.count() == 8 and made.vertices.count() == 9 and made.placed.count() == 0 and made.removed().count() == 8
