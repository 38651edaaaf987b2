"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import numpy as np
import pytest

from loamgraph.plans import load

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = load()


def plain(frame):
    def cell(x):
        if x is None or (isinstance(x, (float, np.floating)) and np.isnan(x)):
            return "null"
        if isinstance(x, (float, np.floating)):
            return f"{x + 0.0:.6f}"
        return str(bool(x)) if isinstance(x, (bool, np.bool_)) else str(x)

    return sorted(map(tuple, frame[sorted(frame.columns)].map(cell).values.tolist()))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, oracle, name):
    got, expected = QUERIES[name](spark, FOLDER).toPandas(), oracle.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(expected)
    assert plain(got) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
