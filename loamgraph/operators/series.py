"""Time series: binning, interpolation, smoothing, bracketing, differences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a time without zone."""
    return F.unix_seconds(ts.cast("timestamp"))


def hourly_median(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The median of each hour since the key's first sample."""
    firsts = rows.groupBy(key).agg(F.min(at).alias("first"))
    hour = F.floor((F.col(at) - F.col("first")) / 3600).alias("hour")
    return rows.join(firsts, key).select(key, hour, value).groupBy(key, "hour").agg(F.median(value).alias("median"), F.count(F.lit(1)).alias("n"))


def bracket(grid: DataFrame, samples: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """For each grid place its last sample at or before and its first after: t0, v0, t1, v1.

    Grid and samples are sorted together; no range join.  Both frames start at their order's begin, so that
    each row adds to one running value: what comes after is what came before in descending order.
    """
    both = grid.select(key, at, F.lit(None).cast("double").alias(value), F.lit(True).alias("wanted")).unionByName(samples.select(key, at, F.col(value).cast("double").alias(value), F.lit(False).alias("wanted")))
    point = F.when(~F.col("wanted"), F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    back = Window.partitionBy(key).orderBy(F.col(at), F.col("wanted")).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col("wanted").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumns({"p": F.last(point, ignorenulls=True).over(back), "q": F.last(point, ignorenulls=True).over(ahead)})
    return placed.where("wanted").select(key, at, F.col("p.t").alias("t0"), F.col("p.v").alias("v0"), F.col("q.t").alias("t1"), F.col("q.v").alias("v1"))


def lerp(rows: DataFrame, at: str) -> Column:
    """The value between both neighbours, or the only neighbour's beyond the ends."""
    share = (F.col(at) - F.col("t0")) / (F.col("t1") - F.col("t0"))
    return F.when(F.col("v0").isNull(), F.col("v1")).when(F.col("v1").isNull(), F.col("v0")).otherwise(F.col("v0") + share * (F.col("v1") - F.col("v0")))


def hourly_grid(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Each key's hours (in seconds) from its first to its last sample."""
    ends = rows.groupBy(key).agg(F.ceil(F.min(at) / 3600).alias("a"), F.floor(F.max(at) / 3600).alias("b"))
    return ends.where("a <= b").select(key, F.explode(F.sequence("a", "b")).alias("h")).select(key, (F.col("h") * 3600).alias(at))


def hysteresis(rows: DataFrame, key: str, at: str, value: str, centre: Column, half: float) -> DataFrame:
    """Values held below or above a band until they cross its other side; a null value starts anew.

    A value above the upper bound switches to high, one at or below the lower bound to low; the first value of a run
    starts by the centre.  The state is the last switch of the run, so one window replaces the automaton.
    """
    lower, upper = F.greatest(F.lit(0.0), centre - half), centre + half
    order = Window.partitionBy(key).orderBy(at)
    run = F.sum(F.when(F.col(value).isNull(), 1).otherwise(0)).over(order)
    inner = Window.partitionBy(key, "run").orderBy(at)
    valued = rows.withColumn("run", run)
    first = F.row_number().over(Window.partitionBy(key, "run", F.col(value).isNull()).orderBy(at)) == 1
    switch = F.when(F.col(value) > upper, "H").when(F.col(value) <= lower, "L").when(F.col("first") & F.col(value).isNotNull(), F.when(F.col(value) > centre, "H").otherwise("L"))
    marked = valued.withColumn("first", first).withColumn("switch", switch)
    state = marked.withColumn("state", F.last("switch", ignorenulls=True).over(inner))
    smooth = F.when(F.col(value).isNull(), F.lit(None)).when(F.col("state") == "L", F.least(F.col(value), lower)).otherwise(F.greatest(F.col(value), upper))
    return state.withColumn("smooth", smooth).drop("run", "first", "switch")


def islands(rows: DataFrame, key: str, at: str, missing: Column) -> DataFrame:
    """Runs of present or missing values: key, island, missing, n, first, last."""
    order = Window.partitionBy(key).orderBy(at)
    change = F.when(F.lag("missing").over(order).isNull() | (F.lag("missing").over(order) != F.col("missing")), 1).otherwise(0)
    marked = rows.withColumn("missing", missing).withColumn("change", change).withColumn("island", F.sum("change").over(order))
    return marked.groupBy(key, "island", "missing").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def ewma(rows: DataFrame, key: str, at: str, value: str, rate: float = 0.5) -> DataFrame:
    """key, at, value, ewma: exponential smoothing with uneven steps, alpha = 1 - exp(-rate * 2 (n - 1) step / span).

    The value of a series with one sample is that sample; without a span all have the first one's.  Unrolled, a smoothed
    value is the sum of alpha * value * exp(-(age of each earlier sample)), ages in units of 1 / rate.  The sum runs within stretches
    of 256 units, so that no factor overflows, and takes over the stretch before; what is older weighs less than exp(-256), nothing in a double.
    """
    spans = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    width = (F.col("last") - F.col("first")).cast("double")
    unit = F.when(width > 0, F.lit(2.0 * rate) * (F.col("n") - 1) / width).otherwise(0.0)
    aged = rows.join(spans, key).select(key, at, F.col(value).cast("double").alias(value), (unit * (F.col(at) - F.col("first")).cast("double")).alias("age"))
    order = [at, value]
    step = F.col("age") - F.lag("age").over(Window.partitionBy(key).orderBy(*order))
    weighed = aged.withColumn("part", F.floor(F.col("age") / 256)).withColumn("own", F.when(step.isNull(), F.col(value)).otherwise((1 - F.exp(-step)) * F.col(value)))
    grown = weighed.withColumn("own", F.col("own") * F.exp(F.col("age") - F.col("part") * 256))
    totals = grown.groupBy(key, (F.col("part") + 1).alias("part")).agg(F.sum("own").alias("before"))
    so_far = F.sum("own").over(Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    summed = grown.withColumn("sum", so_far).join(totals, [key, "part"], "left")
    older = F.coalesce(F.col("before"), F.lit(0.0)) * F.lit(math.exp(-256))
    return summed.select(key, at, value, ((F.col("sum") + older) * F.exp(F.col("part") * 256 - F.col("age"))).alias("ewma"))


def snapshot_changes(edges: DataFrame, snapshot: str) -> DataFrame:
    """a, b, snapshot, change: edges that come or go from one snapshot to the next."""
    order = edges.select(snapshot).distinct()
    following = order.withColumn("next_snapshot", F.lead(snapshot).over(Window.orderBy(snapshot)))  # one row for each snapshot
    now = edges.select("a", "b", snapshot).distinct().join(following, snapshot)
    after = edges.select("a", "b", F.col(snapshot).alias("next_snapshot")).distinct()
    gone = now.where("next_snapshot is not null").join(after, ["a", "b", "next_snapshot"], "left_anti").select("a", "b", F.col("next_snapshot").alias(snapshot), F.lit("removed").alias("change"))
    before = now.select("a", "b", "next_snapshot")
    first = order.agg(F.min(snapshot).alias("first"))
    new = after.join(before, ["a", "b", "next_snapshot"], "left_anti").join(F.broadcast(first), F.col("next_snapshot") != F.col("first")).select("a", "b", F.col("next_snapshot").alias(snapshot), F.lit("added").alias("change"))
    return gone.unionByName(new)


def out_now(edges: DataFrame, snapshot: str) -> DataFrame:
    """Edges that some snapshot has and the given one lacks, for every snapshot."""
    every = edges.select("a", "b").distinct().crossJoin(F.broadcast(edges.select(snapshot).distinct()))
    return every.join(edges.select("a", "b", snapshot).distinct(), ["a", "b", snapshot], "left_anti")


def blended(left: DataFrame, right: DataFrame, share: float) -> DataFrame:
    """Edge weights between two snapshots: common edges blend, others fade out in the first half or in during the second."""
    both = left.select("a", "b", F.col("weight").alias("l")).join(right.select("a", "b", F.col("weight").alias("r")), ["a", "b"], "full")
    s = F.lit(share)
    value = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), (1 - s) * F.col("l") + s * F.col("r")).when(F.col("l").isNull() & (s > 0.5), (2 * s - 1) * F.col("r")).when(F.col("r").isNull() & (s <= 0.5), (1 - 2 * s) * F.col("l"))
    return both.select("a", "b", value.alias("weight")).where("weight is not null")
