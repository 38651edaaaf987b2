"""Statistics: distribution functions, regression, histograms, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import stage


def ecdf(rows: DataFrame, column: str) -> DataFrame:
    """The share of rows at or below each distinct value.

    Values are counted first; the running sum then goes over ranges of values, each with the
    total of those before it, so that no single task sees all values.
    """
    counted = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where(F.col(column).isNotNull())
    return running_share(counted, column, "n")


def running_share(counted: DataFrame, column: str, n: str) -> DataFrame:
    # Written, so that both uses see the same ranges.
    ranged = stage(counted.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum(n).alias("own"))
    whole = totals.agg(F.sum("own").alias("whole"))
    # One row for each range.
    before = totals.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    inner = Window.partitionBy("part").orderBy(column)
    return ranged.join(before, "part").crossJoin(whole).select(column, ((F.sum(n).over(inner) + F.col("before")) / F.col("whole")).alias("share"))


def regression(rows: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """Least squares of y on x: slope, intercept, r2, correlation, n."""
    return rows.groupBy(*(by or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(y, x).alias("r"), F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(column) - low) / ((high - low) / bins)).cast("int")))
    return rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top(rows: DataFrame, order: list, k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def numbered(rows: DataFrame, order: list, start: int = 1) -> DataFrame:
    """`rows` with `place` counted from `start` in this order: sorted in written ranges, numbered in each, moved on by the ranges before."""
    ranges = stage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranges.groupBy("_part").agg(F.count(F.lit(1)).alias("_own"))
    # One row for each range.
    before = totals.select("_part", (F.sum("_own").over(Window.orderBy("_part")) - F.col("_own")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + start
    return ranges.join(before, "_part").withColumn("place", inner + F.col("_before")).drop("_part", "_before")
