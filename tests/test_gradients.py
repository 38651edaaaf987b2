"""Slopes of the losses against difference quotients, and descent."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import gradients as G
from loamgraph.operators import mesh as M

SIDE, STEP = 4, 1e-5
FAT = [(5, 1), (6, 1), (9, 2), (10, 2), (6, 3)]
TARGETS = [(1, 0.5, 1.0), (2, -1.0, 2.0), (3, None, 0.5)]


def tables(spark):
    return M.faces(spark, SIDE, SIDE), spark.createDataFrame(FAT, "vid long, sid long"), spark.createDataFrame(TARGETS, "sid long, target double, length double")


def test_slopes_of_both_losses(spark):
    """One mesh for each height moved up or down, all side by side; the loss with and without smoothness, and smoothness alone by their difference."""
    rng = random.Random(3)
    base = [(r.vid, r.x, r.y, r.border) for r in M.grid(spark, SIDE, SIDE).collect()]
    z = {v: 0.2 * rng.random() for v, *_ in base}
    moves = [(None, 0.0), *((v, s * STEP) for v, *_ in base for s in (1, -1))]
    rows = [(k + len(moves) * j, vid, x, y, z[vid] + (d if vid == v else 0), b) for j in range(2) for k, (v, d) in enumerate(moves) for vid, x, y, b in base]
    meshes = spark.createDataFrame(rows, "run long, vid long, x double, y double, z double, border boolean")
    smooth = spark.range(2 * len(moves)).select(F.col("id").alias("run"), F.when(F.col("id") < len(moves), 0.0).otherwise(0.3).alias("smooth"))
    f, fat, targets = tables(spark)
    value, slope = G.losses(f, meshes, fat, targets, smooth, ["run"])
    loss = {r.run: r.loss for r in value.collect()}
    found = {(r.run, r.vid): r.slope for r in slope.where(F.col("run") % len(moves) == 0).collect()}
    for j in (0, len(moves)):
        for k, (v, *_) in enumerate(base):
            assert found[j, v] == pytest.approx((loss[j + 1 + 2 * k] - loss[j + 2 + 2 * k]) / (2 * STEP), rel=1e-4, abs=1e-4)


def test_geodesic_slope(spark):
    rng = random.Random(5)
    points = [(k, rng.random(), rng.random()) for k in range(12)]

    def loss(p):
        n = len(p)
        mx, my = sum(x for _, x, _ in p) / n, sum(y for *_, y in p) / n
        c, vx, vy = (sum(f(x - mx, y - my) for _, x, y in p) for f in (lambda a, b: a * b, lambda a, b: a * a, lambda a, b: b * b))
        return 1 - c * c / vx / vy

    got = {r.k: r.slope for r in G.geodesic_loss(spark.createDataFrame(points, "k long, x double, y double"), "y", "x", []).collect()}
    for k, x, y in points:
        up, down = ([(j, a + (d if j == k else 0), b) for j, a, b in points] for d in (STEP, -STEP))
        assert got[k] == pytest.approx((loss(up) - loss(down)) / (2 * STEP), rel=1e-4, abs=1e-6)
    flat = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0)], "k long, x double, y double")
    assert [r.slope for r in G.geodesic_loss(flat, "y", "x", []).collect()] == [0.0, 0.0]


def test_descent(spark):
    f, fat, targets = tables(spark)
    dome = M.grid(spark, SIDE, SIDE, F.sqrt(F.lit(2.0) - F.col("x") * F.col("x") - F.col("y") * F.col("y")))
    settings = spark.createDataFrame([(0, 0.0), (1, 0.01)], "run long, smooth double")
    value, heights = G.fit(f, dome.crossJoin(settings.select("run")), fat, targets, settings, 2)
    rows = value.collect()
    assert len(rows) == 2 and all(r.loss_after < r.loss_before for r in rows)
    still = heights.where("border").join(dome.select("vid", F.col("z").alias("z0")), "vid").where("z <> z0")
    assert heights.count() == 2 * SIDE * SIDE and still.count() == 0
