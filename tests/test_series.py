"""Series operators against plain loops on seeded random input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import clusters, paths, series


def automaton(values, centre, half):
    low, high, side, out = max(0.0, centre - half), centre + half, None, []
    for z in values:
        if z is None:
            side = None
            out.append(None)
            continue
        if z > high:
            side = "H"
        elif z <= low:
            side = "L"
        elif side is None:
            side = "H" if z > centre else "L"
        out.append(max(z, high) if side == "H" else min(z, low))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hysteresis(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for k in range(8):
        values = [None if rng.random() < 0.2 else float(rng.randint(0, 12)) for _ in range(60)]
        rows += [(k, i, v) for i, v in enumerate(values)]
        expected |= {(k, i): v for i, v in enumerate(automaton(values, 6.0, 2.0))}
    out = series.hysteresis(spark.createDataFrame(rows, "key int, sec long, value double"), "key", "sec", "value", F.lit(6.0), 2.0)
    assert {(r.key, r.sec): r.smooth for r in out.collect()} == expected


def test_ewma(spark):
    rng = random.Random(4)
    at = sorted(rng.sample(range(1000), 30))
    v = [rng.random() for _ in at]
    smooth = [v[0]]
    for i in range(1, 30):
        a = 1 - math.exp(-0.5 * 2 * 29 * (at[i] - at[i - 1]) / (at[-1] - at[0]))
        smooth.append(a * v[i] + (1 - a) * smooth[-1])
    rows = [(1, t, x) for t, x in zip(at, v)] + [(2, 5, 9.0)]
    rng.shuffle(rows)
    out = series.ewma(spark.createDataFrame(rows, "key int, sec long, value double"), "key", "sec", "value").orderBy("key", "sec").collect()
    assert all(abs(r.ewma - e) < 1e-12 for r, e in zip(out, [*smooth, 9.0]))


def test_loops(spark):
    rng = random.Random(6)
    rows = [(i, [rng.randint(0, 5) for _ in range(rng.randint(1, 12))]) for i in range(200)]
    out = spark.createDataFrame(rows, "i int, path array<int>").select("i", paths.remove_loops(F.col("path")).alias("p")).collect()
    for r in out:
        plain = []
        for x in rows[r.i][1]:
            if x in plain:
                plain = plain[: plain.index(x) + 1]
            else:
                plain.append(x)
        assert list(r.p) == plain


def test_components_of_a_long_path(spark):
    n = 300
    nodes = spark.range(n)
    edges = spark.range(n - 1).where("id <> 150").select(((F.col("id") * 7919) % n).alias("x"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = {r.id: r.component for r in clusters.components(nodes, edges.select("a", "b")).collect()}
    assert out == {i: 0 if i <= 150 else 151 for i in range(n)}
