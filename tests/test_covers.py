"""Covers in rounds against the one-by-one greedy method; numbering; lookups with missing values."""

import random

import pytest
from pyspark.sql import functions as F

from loamgraph.operators import covers as V
from loamgraph.operators import mesh as M
from loamgraph.operators import stats
from loamgraph.operators import traces as T

from . import by_hand


@pytest.mark.parametrize("seed", range(4))
def test_same_choices_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(rng.randint(1, 26))})
    got = V.vertex_cover(spark.createDataFrame(pairs, "a long, b long")).orderBy("step").collect()
    assert [r.step for r in got] == list(range(len(got)))
    assert [r.id for r in got] == by_hand.vertex_cover(pairs)
    sets = {f"s{k:02}": set(rng.sample(range(15), rng.randint(1, 6))) for k in range(10)}
    rows = [(k, x) for k, v in sets.items() for x in v]
    chosen = V.set_cover(spark.createDataFrame(rows + rows[:3], "name string, item long")).orderBy("step").collect()
    assert [r.name for r in chosen] == by_hand.set_cover(sets, set().union(*sets.values()))


def test_no_pairs(spark):
    assert V.vertex_cover(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    got = stats.numbered(rows, [F.col("k").desc(), F.col("id").asc()], 0).collect()
    assert [r.place for r in sorted(got, key=lambda r: (-r.k, r.id))] == list(range(1000))


def test_missing_codes_and_names(spark):
    rows = [(1, "A", "Rome"), (2, None, "rome"), (3, None, "Oslo"), (4, "B", None), (5, "C", None), (6, None, None), (7, "D", "Bern")]
    got = T.first_of_places(spark.createDataFrame(rows, "at long, code string, city string"), "at", "code", "city")
    assert sorted(r.at for r in got.collect()) == [1, 4, 7]
    by = spark.createDataFrame([(g, *r) for g in (1, None) for r in rows], "g long, at long, code string, city string")
    assert sorted((str(r.g), r.at) for r in T.first_of_places(by, "at", "code", "city", "g").collect()) == [(g, k) for g in ("1", "None") for k in (1, 4, 7)]


def test_octets(spark):
    rows = spark.createDataFrame([("1.2.3.4",), ("300.1.1.1",), ("1.2.3",), ("1.2.3.-4",), ("a.b.c.d",), (None,)], "address string")
    assert [r[0] for r in rows.select(T.address_number(F.col("address"))).collect()] == [16909060, None, None, None, None, None]


def test_points_in_bands(spark):
    ring = [(0, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.1), (1.0, 1.0), (2.0, 3.0), (0.0, 2.0)])]
    ring += [(1, k, x, y) for k, (x, y) in enumerate([(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)])]
    rng = random.Random(2)
    spots = [(k, rng.uniform(-1, 7), rng.uniform(-1, 7)) for k in range(200)] + [(900, 0.0, 1.0), (901, 9.0, 90.0)]

    def inside(x, y):
        for g in (0, 1):
            corners = [(a, b) for i, _, a, b in ring if i == g]
            odd = False
            for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
                if (ay > y) != (by > y) and ax + (y - ay) / (by - ay) * (bx - ax) > x:
                    odd = not odd
            if odd:
                return True
        return False

    got = {r.pid: r.inside for r in M.in_polygons(spark.createDataFrame(spots, "pid long, x double, y double"), spark.createDataFrame(ring, "gid int, pos int, x double, y double"), 0.3).collect()}
    assert got == {k: inside(x, y) or k == 900 for k, x, y in spots}
