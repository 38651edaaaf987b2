"""Snapshots put together: names over all snapshots, one scale, and the animation's files."""

import math

import pytest

from loamgraph.operators import collate as C


def test_names_chain_over_snapshots(spark):
    rows = [(1, 5, 5), (1, 7, 5), (2, 7, 7), (2, 9, 7), (3, 2, 2), (3, 11, 11), (4, 5, 5)]
    got = {r.id: (r.name, r.label) for r in C.unified(spark.createDataFrame(rows, "snapshot int, id int, rep int")).collect()}
    assert got == {5: (5, "5/7/9"), 7: (5, "5/7/9"), 9: (5, "5/7/9"), 2: (2, "2"), 11: (11, "11")}
    names = C.unified(spark.createDataFrame(rows, "snapshot int, id int, rep int"))
    edges = spark.createDataFrame([(1, 7, 2, 3, 0.5), (1, 2, 9, 4, 1.0), (1, 5, 7, 9, 1.0), (2, 2, 11, 1, -1.0), (2, 2, 99, 1, -1.0)], "snapshot int, a int, b int, throughput long, curvature double")
    got = sorted(map(tuple, C.relabelled(edges, names, ["throughput"], ["curvature"]).collect()))
    assert got == [(1, 2, 5, 7, 0.75), (2, 2, 11, 1, -1.0)]


def test_one_scale_for_all_snapshots(spark):
    final = [(s, v, float(z)) for s, zs in ((1, (3, 5, 9)), (2, (2, 2, 2)), (3, (7, 8, 9))) for v, z in enumerate(zs)]
    initial = [(0, 1.0), (1, 1.0), (2, 1.0)]
    near = [(1, 0, 0.0), (1, 1, 0.01), (1, 2, 0.06), (2, 0, 0.0), (2, 1, 0.0)]
    args = (spark.createDataFrame(final, "snapshot int, vid long, z double"), spark.createDataFrame(initial, "vid long, z double"), spark.createDataFrame(near, "snapshot int, vid long, distance double"), 0.02)
    got = {(r.snapshot, r.vid): r.height for r in C.collated_heights(*args).collect()}
    # Inside: 2 and 4 (level 3) in snapshot 1, 1 and 1 in snapshot 2: from -1 to 1.
    level = lambda z: (z + 1) / 2 * 0.15
    want = {(1, 0): level(-1), (1, 1): level(1), (1, 2): (level(5) + 0.05) * math.exp(-1000 * 0.04**2) - 0.05, (2, 0): level(0), (2, 1): level(0)}
    assert got == pytest.approx({**{(s, v): -0.05 for s in (1, 2, 3) for v in range(3)}, **want})
    plain = {(r.snapshot, r.vid): r.height for r in C.collated_heights(*args, scale=None).collect()}
    assert plain[1, 1] == pytest.approx(2.0) and plain[3, 0] == -0.05


def test_animation_in_parts(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "1/2", 0.0, 1.0), (4, "4", 0.5, 0.5)], "name long, label string, x double, y double")
    edges = spark.createDataFrame([(1, 1, 4, 2), (2, 1, 4, 8)], "snapshot int, a long, b long, weight long")
    heights = spark.createDataFrame([(1, 0, 0.1)], "snapshot int, vid long, height double")
    rows = C.animation(nodes, edges, heights)
    C.write_animation(rows, str(tmp_path / "film"))
    back = spark.read.json(str(tmp_path / "film"))
    assert {r["kind"]: r["count"] for r in back.groupBy("kind").count().collect()} == {"node": 2, "edge": 2, "height": 1, "map": 1}
    assert sorted(r.value for r in rows.where("kind = 'edge'").collect()) == [0.25, 1.0]
    assert [(r.x, r.y, r.value) for r in rows.where("kind = 'map'").collect()] == [(0.25, 0.75, 2.0)]
    empty = C.animation(nodes.limit(0), edges.limit(0), heights.limit(0))
    assert empty.count() == 0
