"""Stored documents: what is pushed, what is read, and the same rows as without pushing."""

import datetime

import pytest
from pyspark.sql import functions as F

from loamgraph.sources import search as S

FIELDS = {"id": ("test.id", "long"), "kind": ("test.kind", "string"), "ts": ("at", "timestamp_ntz"), "value": ("result.value", "double")}
DAY = datetime.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "documents")
    rows = [(k, None if k % 7 == 0 else "xyz"[k % 3] * (k % 4 + 1), None if k % 11 == 0 else DAY + datetime.timedelta(hours=5 * k), None if k % 5 == 0 else k / 4) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, kind string, ts timestamp_ntz, value double")
    document = F.struct(F.struct("id", "kind").alias("test"), F.col("ts").alias("at"), F.struct("value", F.lit("unread").alias("more")).alias("result"))
    S.write_documents(df.repartition(1), document, F.col("ts"), path)
    return df, path


FILTERS = {
    "none": "true",
    "range": "ts >= timestamp_ntz'2024-03-04 05:00:00' AND ts < timestamp_ntz'2024-03-06 00:00:00'",
    "instant": "ts = timestamp_ntz'2024-03-03 02:00:00'",
    "not instant": "ts <> timestamp_ntz'2024-03-03 02:00:00'",
    "from day": "ts > timestamp_ntz'2024-03-09 00:00:00'",
    "none left": "ts > timestamp_ntz'2025-01-01 00:00:00'",
    "no time": "ts IS NULL",
    "in": "kind IN ('x', 'yy', 'zzz')",
    "not in": "kind NOT IN ('x', 'yy', 'zzz')",
    "in with null": "kind IN ('x', NULL)",
    "equal": "kind = 'xx'",
    "unequal": "kind <> 'xx'",
    "null safe": "kind <=> 'xx'",
    "not null safe": "NOT kind <=> 'xx'",
    "starts": "kind LIKE 'xx%'",
    "not ends": "kind NOT LIKE '%z'",
    "contains": "kind LIKE '%yy%'",
    "null": "value IS NULL",
    "not null": "value IS NOT NULL AND value <= 7.25D",
    "either": "kind = 'x' OR value > 10",
    "computed": "value * 2 > 15",
}


@pytest.mark.parametrize("name", FILTERS)
def test_same_as_unpushed(spark, store, name):
    df, path = store
    rows = lambda d: sorted(map(str, d.where(FILTERS[name]).select("id", "kind", "ts", "value").collect()))
    assert rows(S.search(spark, path, FIELDS, FILTERS[name], time="ts")) == rows(df)


def test_fewer_files(spark, store):
    df, path = store
    whole = S.search(spark, path, FIELDS, time="ts")
    some = S.search(spark, path, FIELDS, FILTERS["range"], time="ts")
    days = df.where(FILTERS["range"]).select(F.to_date("ts")).distinct().count()
    assert some.rdd.getNumPartitions() == days < whole.rdd.getNumPartitions()
    # What the reader has taken on isn't tested again by Spark.
    assert "2024-03" not in some._jdf.queryExecution().executedPlan().toString()
    # Without the name of the time nothing is left out.
    assert S.search(spark, path, FIELDS, FILTERS["range"]).rdd.getNumPartitions() == whole.rdd.getNumPartitions()


def test_searches_stay_apart(spark, store):
    df, path = store
    some = S.search(spark, path, FIELDS, "id < 40", time="ts")
    rows = some.where(FILTERS["range"]).union(some).union(some.where("kind = 'xx'")).union(S.search(spark, path, FIELDS, time="ts"))
    few = df.where("id < 40")
    assert rows.count() == few.where(FILTERS["range"]).count() + few.count() + few.where("kind = 'xx'").count() + df.count()
    assert some.alias("p").join(some.alias("q"), F.expr("p.id = q.id + 1")).count() == 39


def test_absent_fields_and_projection(spark, store):
    _, path = store
    rows = S.search(spark, path, {"id": ("test.id", "long"), "no": ("result.never.there", "string")})
    assert rows.count() == 60 and rows.where("no is not null").count() == 0
