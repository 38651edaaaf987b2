"""Run configurations: parameter grids, batches, duplicate outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def expand(spark: SparkSession, arguments: dict[str, list], groups: list[list[str]] | None = None, defaults: dict | None = None) -> DataFrame:
    """All settings: parameters of a group go together, groups and other parameters multiply, defaults fill the rest."""
    groups = [list(g) for g in groups or []]
    named = {p for g in groups for p in g}
    if unknown := named - arguments.keys():
        raise ValueError(f"no values for {sorted(unknown)}")
    groups += [[p] for p in arguments if p not in named]
    tables = []
    for g in groups:
        sizes = {len(arguments[p]) for p in g}
        if len(sizes) != 1:
            raise ValueError(f"parameters {g} have different numbers of values")
        tables.append(spark.createDataFrame(list(zip(*(arguments[p] for p in g))), g))
    grid = reduce(lambda a, b: a.crossJoin(b), tables) if tables else spark.range(1).drop("id")
    return grid.withColumns({k: F.lit(v) for k, v in (defaults or {}).items() if k not in arguments})


def batches(grid: DataFrame, order_by: str | None) -> DataFrame:
    """One row for each batch: the other parameters, and the values of `order_by` in ascending order."""
    if order_by is None:
        return grid
    if order_by not in grid.columns:
        raise ValueError(f"no parameter {order_by}")
    rest = [c for c in grid.columns if c != order_by]
    return grid.groupBy(*rest).agg(F.array_sort(F.collect_list(order_by)).alias("batch"))


def duplicates(runs: DataFrame, column: str) -> DataFrame:
    return runs.groupBy(column).agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")
