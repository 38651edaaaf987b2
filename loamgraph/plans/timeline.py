"""Queries over time series and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import edges as E
from ..operators import series as S
from ..operators import stats
from . import network as net
from .basic import r6
from .network import NET
from .registry import Tables, query
from .stage import stage


def latency(t: Tables) -> DataFrame:
    """key, sec (seconds), event_id, value; every seventh value is missing."""
    return t.events.select(F.col("event_type").alias("key"), S.seconds(F.col("ts")).alias("sec"), "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


def settled(t: Tables) -> DataFrame:
    """One value a key and second: the least; the latest of equal seconds can't be told apart."""
    return latency(t).groupBy("key", "sec").agg(F.min("value").alias("value"))


LAT = "WITH RECURSIVE lat AS (SELECT event_type AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events), one AS (SELECT key, sec, min(value) AS value FROM lat GROUP BY 1, 2), known AS (SELECT * FROM one WHERE value IS NOT NULL)\n"


@query(LAT + "SELECT key, CAST(floor((sec - f)/3600) AS BIGINT) AS hour, round(median(value), 6) AS median, count(*) AS n FROM (SELECT *, min(sec) OVER (PARTITION BY key) AS f FROM lat WHERE value IS NOT NULL) GROUP BY 1, 2")
def hourly_median(t: Tables) -> DataFrame:
    return S.hourly_median(latency(t).where("value is not null"), "key", "sec", "value").select("key", "hour", r6(F.col("median")).alias("median"), "n")


LERP = "CASE WHEN p.sec IS NULL THEN q.value WHEN q.sec IS NULL THEN p.value ELSE p.value + (g.sec - p.sec)/CAST(q.sec - p.sec AS DOUBLE)*(q.value - p.value) END"


@query(LAT + f", g AS (SELECT key, unnest(range(a, b + 1))*3600 AS sec FROM (SELECT key, CAST(ceil(min(sec)/3600.0) AS BIGINT) AS a, CAST(floor(max(sec)/3600.0) AS BIGINT) AS b FROM known GROUP BY key)) SELECT g.key, g.sec, round({LERP}, 6) AS value FROM g ASOF LEFT JOIN known p ON p.key = g.key AND g.sec >= p.sec ASOF LEFT JOIN known q ON q.key = g.key AND g.sec < q.sec")
def hourly_interp(t: Tables) -> DataFrame:
    known = settled(t).where("value is not null")
    rows = S.bracket(S.hourly_grid(known, "key", "sec"), known, "key", "sec", "value")
    return rows.select("key", "sec", r6(S.lerp(rows, "sec")).alias("value"))


@query(LAT + ", g AS (SELECT DISTINCT key, sec + 1800 AS sec FROM known) SELECT g.key, g.sec, p.sec AS t0, q.sec AS t1, round(" + LERP + ", 6) AS value FROM g ASOF LEFT JOIN known p ON p.key = g.key AND g.sec >= p.sec ASOF LEFT JOIN known q ON q.key = g.key AND g.sec < q.sec")
def asof_lerp(t: Tables) -> DataFrame:
    known = settled(t).where("value is not null")
    rows = S.bracket(known.select("key", (F.col("sec") + 1800).alias("sec")), known, "key", "sec", "value")
    return rows.select("key", "sec", "t0", "t1", r6(S.lerp(rows, "sec")).alias("value"))


@query(
    LAT
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sec) AS k FROM one),
dfa AS (SELECT key, k, sec, value, CASE WHEN value IS NULL THEN NULL WHEN value > 50 THEN 'H' ELSE 'L' END AS state FROM o WHERE k = 1
UNION ALL SELECT o.key, o.k, o.sec, o.value, CASE WHEN o.value IS NULL THEN NULL WHEN dfa.state IS NULL THEN CASE WHEN o.value > 50 THEN 'H' ELSE 'L' END WHEN o.value > 60 THEN 'H' WHEN o.value <= 40 THEN 'L' ELSE dfa.state END FROM dfa JOIN o ON o.key = dfa.key AND o.k = dfa.k + 1)
SELECT key, sec, state, round(CASE state WHEN 'L' THEN least(value, 40) WHEN 'H' THEN greatest(value, 60) END, 6) AS smooth FROM dfa WHERE value IS NOT NULL"""
)
def hysteresis(t: Tables) -> DataFrame:
    return S.hysteresis(settled(t), "key", "sec", "value", F.lit(50.0), 10.0).where("value is not null").select("key", "sec", "state", r6(F.col("smooth")).alias("smooth"))


@query(LAT + "SELECT key, CAST(island AS BIGINT) AS island, missing, count(*) AS n, min(sec) AS first, max(sec) AS last FROM (SELECT *, sum(change) OVER (PARTITION BY key ORDER BY sec) AS island FROM (SELECT key, sec, value IS NULL AS missing, CASE WHEN lag(value IS NULL) OVER w IS NOT DISTINCT FROM (value IS NULL) THEN 0 ELSE 1 END AS change FROM one WINDOW w AS (PARTITION BY key ORDER BY sec))) GROUP BY 1, 2, 3")
def gap_islands(t: Tables) -> DataFrame:
    return S.islands(settled(t), "key", "sec", F.col("value").isNull())


HOURS = ", hours AS (SELECT key, sec//21600 AS sec, avg(value) AS value FROM known GROUP BY 1, 2), num AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sec) AS k, 2.0*(count(*) OVER (PARTITION BY key) - 1)/CAST(nullif(max(sec) OVER (PARTITION BY key) - min(sec) OVER (PARTITION BY key), 0) AS DOUBLE) AS scale FROM hours), ew AS (SELECT key, k, sec, value, value AS e FROM num WHERE k = 1 UNION ALL SELECT n.key, n.k, n.sec, n.value, (1 - exp(-0.5*n.scale*(n.sec - w.sec)))*n.value + exp(-0.5*n.scale*(n.sec - w.sec))*w.e FROM ew w JOIN num n ON n.key = w.key AND n.k = w.k + 1)\n"


def _hours(t: Tables) -> DataFrame:
    # Decimals add up alike in any order of the rows.
    exact = F.col("value").cast("decimal(20,8)")
    return settled(t).where("value is not null").groupBy("key", F.floor(F.col("sec") / 21600).alias("sec")).agg(F.avg(exact).cast("double").alias("value"))


@query(LAT + HOURS + "SELECT key, sec, round(e, 5) AS ewma FROM ew")
def ewma(t: Tables) -> DataFrame:
    return S.ewma(_hours(t), "key", "sec", "value").select("key", "sec", F.round("ewma", 5).alias("ewma"))


@query(LAT + HOURS + "SELECT key, sec, abs(value - e) > 12 AS flagged FROM ew")
def change_flags(t: Tables) -> DataFrame:
    return S.ewma(_hours(t), "key", "sec", "value").select("key", "sec", (F.abs(F.col("value") - F.col("ewma")) > 12).alias("flagged"))


SNAP = ", snap AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, CAST(12 * year(ts) + month(ts) - 1 AS INTEGER) AS m FROM raw WHERE source <> target)\n"


def snapshots(t: Tables) -> DataFrame:
    """All links of each month, counted from the year 0."""
    links = E.drop_self_loops(net.raw_links(t))
    return E.canonical(links.select("source", "target", (12 * F.year("ts") + F.month("ts") - 1).alias("m"))).distinct()


@query(NET + SNAP + ", ord AS (SELECT m, lead(m) OVER (ORDER BY m) AS n FROM (SELECT DISTINCT m FROM snap)) SELECT a, b, n AS m, 'removed' AS change FROM snap JOIN ord USING (m) WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM snap z WHERE z.a = snap.a AND z.b = snap.b AND z.m = n) UNION ALL SELECT z.a, z.b, z.m, 'added' FROM snap z JOIN ord ON ord.n = z.m WHERE NOT EXISTS (SELECT 1 FROM snap x WHERE x.a = z.a AND x.b = z.b AND x.m = ord.m)")
def snapshot_diff(t: Tables) -> DataFrame:
    return S.snapshot_changes(snapshots(t), "m")


@query(NET + SNAP + "SELECT e.a, e.b, s.m FROM (SELECT DISTINCT a, b FROM snap) e CROSS JOIN (SELECT DISTINCT m FROM snap) s WHERE NOT EXISTS (SELECT 1 FROM snap z WHERE z.a = e.a AND z.b = e.b AND z.m = s.m)")
def currently_out(t: Tables) -> DataFrame:
    return S.out_now(snapshots(t), "m")


YEARLY = ", yearly AS (SELECT least(source, target) AS a, greatest(source, target) AS b, CAST(year(ts) AS INTEGER) AS y, CAST(sum(throughput) AS BIGINT) AS weight, min(throughput) AS low, max(throughput) AS high FROM raw WHERE source <> target GROUP BY 1, 2, 3), span AS (SELECT min(y) AS lo, min(y) + 1 AS hi FROM yearly)\n"


def yearly(t: Tables) -> DataFrame:
    links = E.drop_self_loops(net.raw_links(t))
    return E.canonical(links.select("source", "target", F.year("ts").alias("y"), "throughput")).groupBy("a", "b", "y").agg(F.sum("throughput").alias("weight"), F.min("throughput").alias("low"), F.max("throughput").alias("high"))


@query(NET + YEARLY + "SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, round(CASE WHEN r.weight IS NULL THEN NULL WHEN l.weight IS NULL THEN CAST(0.5 AS DOUBLE)*r.weight ELSE CAST(0.25 AS DOUBLE)*l.weight + CAST(0.75 AS DOUBLE)*r.weight END, 6) AS weight FROM (SELECT yearly.* FROM yearly, span WHERE y = lo) l FULL JOIN (SELECT yearly.* FROM yearly, span WHERE y = hi) r ON l.a = r.a AND l.b = r.b WHERE r.weight IS NOT NULL")
def snapshot_blend(t: Tables) -> DataFrame:
    rows = yearly(t)
    first = rows.agg(F.min("y").alias("lo"))
    here = rows.join(F.broadcast(first), F.col("y") <= F.col("lo") + 1)
    return S.blended(here.where("y = lo"), here.where("y = lo + 1"), 0.75).select("a", "b", r6(F.col("weight")).alias("weight"))


@query(NET + YEARLY + "SELECT a, b, min(weight) AS least, round(ln(var_pop(weight) + 1), 6) AS log_variance, round((max(weight) - min(weight))/CAST(CASE WHEN median(weight) = 0 THEN 1 ELSE median(weight) END AS DOUBLE), 6) AS spread FROM yearly GROUP BY 1, 2")
def log_variance(t: Tables) -> DataFrame:
    mid = F.median("weight")
    return yearly(t).groupBy("a", "b").agg(F.min("weight").alias("least"), r6(F.ln(F.var_pop("weight") + 1)).alias("log_variance"), r6((F.max("weight") - F.min("weight")) / F.when(mid == 0, 1.0).otherwise(mid)).alias("spread"))


@query(NET + YEARLY + "SELECT a, b, min(weight) AS low, max(weight) AS high FROM yearly GROUP BY 1, 2 HAVING min(weight) < 60 AND max(weight) > 60")
def threshold_straddle(t: Tables) -> DataFrame:
    return yearly(t).groupBy("a", "b").agg(F.min("weight").alias("low"), F.max("weight").alias("high")).where("low < 60 and high > 60")


@query(NET + "SELECT threshold, count(*) AS edges FROM (SELECT a, b, min(e) AS threshold FROM edges, (SELECT unnest([1000, 5000, 10000, 20000, 50000]) AS e) WHERE rtt_us - gcl_us <= e GROUP BY 1, 2) GROUP BY 1")
def first_threshold(t: Tables) -> DataFrame:
    steps = t.spark.createDataFrame([(x,) for x in (1000, 5000, 10000, 20000, 50000)], "e int")
    kept = net.undirected(t).join(F.broadcast(steps), F.col("rtt_us") - F.col("gcl_us") <= F.col("e"))
    return kept.groupBy("a", "b").agg(F.min("e").alias("threshold")).groupBy("threshold").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT user_id, round(max(value) - min(value), 6) AS score FROM events GROUP BY user_id ORDER BY round(max(value) - min(value), 6) DESC, user_id LIMIT 20")
def range_topk(t: Tables) -> DataFrame:
    scored = t.events.groupBy("user_id").agg(r6(F.max("value") - F.min("value")).alias("score"))
    return stats.top(scored, [F.desc("score"), "user_id"], 20)


@query(NET + "SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 3) AS intercept, round(regr_r2(y, x), 6) AS r2, round(corr(y, x), 6) AS r, count(*) AS n FROM (SELECT CAST(rtt_us AS DOUBLE) AS y, CAST(gcl_us AS DOUBLE) AS x FROM edges)")
def ols_fit(t: Tables) -> DataFrame:
    rows = net.undirected(t).select(F.col("rtt_us").cast("double").alias("y"), F.col("gcl_us").cast("double").alias("x"))
    return stats.regression(rows, "y", "x").select(r6(F.col("slope")).alias("slope"), F.round("intercept", 3).alias("intercept"), r6(F.col("r2")).alias("r2"), r6(F.col("r")).alias("r"), "n")


@query(NET + "SELECT round(corr(ln(throughput + 1), ln(rtt_us + 1)), 6) AS r, round(corr(ln(throughput + 1), ln(rtt_us + 1))*corr(ln(throughput + 1), ln(rtt_us + 1)), 6) AS r2 FROM dedges")
def corr_log(t: Tables) -> DataFrame:
    r = F.corr(F.ln(F.col("throughput") + 1), F.ln(F.col("rtt_us") + 1))
    return net.directed(t).agg(r6(r).alias("r"), r6(r * r).alias("r2"))


@query(NET + ", fit AS (SELECT regr_slope(CAST(rtt_us AS DOUBLE), CAST(gcl_us AS DOUBLE)) AS m, regr_intercept(CAST(rtt_us AS DOUBLE), CAST(gcl_us AS DOUBLE)) AS c FROM edges) SELECT a, b, round(abs(rtt_us - m*gcl_us - c), 3) AS residual FROM edges, fit ORDER BY round(abs(rtt_us - m*gcl_us - c), 3) DESC, a, b LIMIT 10")
def residual_topk(t: Tables) -> DataFrame:
    rows = net.undirected(t)
    fit = stats.regression(rows.select(F.col("rtt_us").cast("double").alias("y"), F.col("gcl_us").cast("double").alias("x")), "y", "x")
    residual = F.round(F.abs(F.col("rtt_us") - F.col("slope") * F.col("gcl_us") - F.col("intercept")), 3)
    return stats.top(rows.crossJoin(F.broadcast(fit)).select("a", "b", residual.alias("residual")), [F.desc("residual"), "a", "b"], 10)


@query("SELECT CAST(least(19, greatest(0, CAST(floor((value - 0)/CAST(5 AS DOUBLE)) AS INTEGER))) AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    return stats.histogram(t.events, "value", 0.0, 100.0, 20)


@query(NET + YEARLY + "SELECT a, b, round((max(weight) - min(weight))/avg(weight), 6) AS change, count(*) AS members FROM yearly GROUP BY 1, 2 HAVING count(*) >= 2")
def rel_change(t: Tables) -> DataFrame:
    return yearly(t).groupBy("a", "b").agg(r6((F.max("weight") - F.min("weight")) / F.avg("weight")).alias("change"), F.count(F.lit(1)).alias("members")).where("members >= 2")


@query("SELECT rn AS place, value FROM (SELECT round(value, 6) AS value, row_number() OVER (ORDER BY round(value, 6), event_id) - 1 AS rn, count(*) OVER () AS n FROM events) WHERE rn % greatest(1, n//100) = 0")
def quantile_stride(t: Tables) -> DataFrame:
    """Every k-th value in order: places come from range totals and each range's own order."""
    rows = t.events.select(r6(F.col("value")).alias("value"), "event_id").repartitionByRange("value", "event_id").withColumn("part", F.spark_partition_id())
    rows = stage(rows)  # both uses see the same ranges
    totals = rows.groupBy("part").agg(F.count(F.lit(1)).alias("own"))
    whole = totals.agg(F.sum("own").alias("n"))
    before = totals.select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("value", "event_id")) - 1 + F.col("before")
    placed = rows.join(before, "part").crossJoin(whole).withColumn("place", place)
    return placed.where(F.col("place") % F.greatest(F.lit(1), F.expr("n div 100")) == 0).select("place", "value")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS numeric_id, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END ASC NULLS LAST, o_orderkey) AS place FROM orders ORDER BY 3 LIMIT 25")
def nulls_last(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("numeric_id"))
    first = rows.orderBy(F.asc_nulls_last("numeric_id"), "o_orderkey").limit(25)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("numeric_id"), "o_orderkey")))


@query("SELECT l_orderkey, votes FROM (SELECT l_orderkey, count(DISTINCT l_suppkey) AS votes, count(DISTINCT l_linestatus) AS opinions FROM lineitem GROUP BY 1) WHERE votes > 1 AND opinions = 1")
def unanimous_votes(t: Tables) -> DataFrame:
    """Keys that several sources vote on, all alike."""
    return t.lineitem.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("votes"), F.countDistinct("l_linestatus").alias("opinions")).where("votes > 1 and opinions = 1").select("l_orderkey", "votes")


@query("SELECT user_id, event_type, min(value) AS least FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1, 2")
def nested_minimum(t: Tables) -> DataFrame:
    """Least value by two keys over the last day."""
    last = t.events.agg(F.max("ts").alias("last"))
    return t.events.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("INTERVAL 24 HOURS")).groupBy("user_id", "event_type").agg(F.min("value").alias("least"))
