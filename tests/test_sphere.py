"""Meshes of the sphere against plain numpy: numbers, closedness, nearest vertices, faces, arcs."""

import numpy as np
import pytest

from loamgraph.operators import sphere as S


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def mesh(spark, f):
    v = S.sphere_vertices(spark, f).toPandas().sort_values("vid")
    t = S.sphere_faces(spark, f).toPandas().sort_values("fid")
    return v.vid.to_numpy(), v[["x", "y", "z"]].to_numpy(), t.fid.to_numpy(), t[["u", "v", "w"]].to_numpy()


def table(spark, points):
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "pid long, x double, y double, z double")


@pytest.mark.parametrize("f", [1, 2, 3, 5])
def test_closed(spark, f):
    vid, at, fid, corners = mesh(spark, f)
    assert vid.tolist() == list(range(10 * f * f + 2)) and len(set(fid)) == len(fid) == 20 * f * f
    np.testing.assert_allclose(np.linalg.norm(at, axis=1), 1)
    turns = [(c[i], c[(i + 1) % 3]) for c in corners.tolist() for i in range(3)]
    assert len(set(turns)) == len(turns) and {(b, a) for a, b in turns} == set(turns)
    p, q, r = (at[corners[:, k]] for k in range(3))
    assert (np.einsum("ij,ij->i", p, np.cross(q, r)) > 0).all()
    # No face is obtuse: what the search for nearest vertices relies on.
    for a, b, c in ((p, q, r), (q, r, p), (r, p, q)):
        assert (np.einsum("ij,ij->i", b - a, c - a) > 0).all()
    assert len({tuple(x) for x in np.round(at, 9).tolist()}) == len(at)


@pytest.mark.parametrize("f", [1, 2, 4, 7])
def test_nearest_and_faces(spark, f):
    vid, at, fid, corners = mesh(spark, f)
    rng = np.random.default_rng(f)
    # Any length; on vertices, sides and axes too.
    points = np.concatenate([rng.normal(size=(200, 3)) * 5, at[:20], (at[corners[:20, 0]] + at[corners[:20, 1]]) / 2, np.eye(3), -np.eye(3)])
    got = S.nearest_on_sphere(table(spark, points), f).toPandas().set_index("pid").sort_index()
    cosine = unit(points) @ at.T
    assert len(got) == len(points)
    np.testing.assert_allclose(got.cosine, cosine.max(axis=1), atol=1e-12)
    np.testing.assert_allclose(cosine[np.arange(len(points)), got.vid], cosine.max(axis=1), atol=1e-12)
    held = S.locate_on_sphere(table(spark, points), f).toPandas().set_index("pid").sort_index()
    by_id = dict(zip(fid.tolist(), corners.tolist()))
    for k, face in held.fid.items():
        weights = np.linalg.solve(at[by_id[face]].T, unit(points)[k])
        assert (weights > -1e-9).all()


def test_centre_and_nulls(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, None, 1.0, 0.0), (2, 0.0, 0.0, 2.0)], "pid long, x double, y double, z double")
    assert [r.pid for r in S.nearest_on_sphere(rows, 3).collect()] == [2]
    assert S.locate_on_sphere(rows.limit(0), 3).count() == 0


@pytest.mark.parametrize("epsilon", [0.05, 0.3, 1.0])
def test_arcs(spark, epsilon):
    f = 6
    _, at, _, _ = mesh(spark, f)
    rng = np.random.default_rng(3)
    ends = unit(rng.normal(size=(24, 3)))
    pairs = [(k, k + 1) for k in range(0, 22, 2)] + [(5, 5)]
    arcs = spark.createDataFrame([(s, *map(float, ends[a]), *map(float, ends[b])) for s, (a, b) in enumerate(pairs)], "sid long, ux double, uy double, uz double, vx double, vy double, vz double")
    got = {(r.vid, r.sid) for r in S.near_arcs(S.sphere_vertices(spark, f), arcs, epsilon).collect()}
    expected = set()
    for s, (a, b) in enumerate(pairs):
        # The arc itself, finely cut.
        share = np.linspace(0, 1, 20001)[:, None]
        line = unit(ends[a] * (1 - share) + ends[b] * share)
        expected |= {(int(k), s) for k in np.flatnonzero((at @ line.T).max(axis=1) > np.cos(epsilon))}
    assert got == expected
