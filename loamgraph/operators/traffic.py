"""Traffic on links and between nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .edges import node_totals
from .paths import hops


def link_traffic(paths: DataFrame) -> DataFrame:
    """u, v, volume: the sum over the routes through each directed link.  paths: route_id, route, volume."""
    return hops(paths, ["volume"]).groupBy("u", "v").agg(F.sum("volume").alias("volume"))


def od_matrix(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """s, t, volume for all pairs; 0 where there is no route."""
    ends = paths.select(F.element_at("route", 1).alias("s"), F.element_at("route", -1).alias("t"), "volume").groupBy("s", "t").agg(F.sum("volume").alias("volume"))
    ids = nodes.select("id")
    return ids.select(F.col("id").alias("s")).crossJoin(ids.select(F.col("id").alias("t"))).join(ends, ["s", "t"], "left").select("s", "t", F.coalesce("volume", F.lit(0).cast("long")).alias("volume"))


def gravity(links: DataFrame) -> DataFrame:
    """s, t, share: traffic in proportion to what s sends and t receives, over pairs of different nodes that do."""
    totals = node_totals(links)
    out = totals.where("total_out > 0").select(F.col("id").alias("s"), "total_out")
    into = totals.where("total_in > 0").select(F.col("id").alias("t"), "total_in")
    pairs = out.join(into, F.col("s") != F.col("t")).withColumn("mass", F.col("total_out").cast("double") * F.col("total_in"))
    return pairs.crossJoin(F.broadcast(pairs.agg(F.sum("mass").alias("whole")))).select("s", "t", (F.col("mass") / F.col("whole")).alias("share"))


def active_routes(paths: DataFrame, links: DataFrame) -> DataFrame:
    """Routes between different ends whose origin sends and whose destination receives."""
    totals = node_totals(links)
    ends = paths.withColumns({"s": F.element_at("route", 1), "t": F.element_at("route", -1)}).where("s <> t")
    return ends.join(totals.where("total_out > 0").select(F.col("id").alias("s")), "s", "left_semi").join(totals.where("total_in > 0").select(F.col("id").alias("t")), "t", "left_semi").select("route_id", "s", "t")


def stable_fp(nodes: DataFrame, f: float = 0.25) -> DataFrame:
    """(f a_s p_d + (1 - f) a_d p_s) / sum of p over all ordered pairs of different nodes.  nodes: id, activity, preference."""
    whole = nodes.agg(F.sum("preference").alias("whole"))
    a = nodes.select(F.col("id").alias("s"), F.col("activity").alias("as"), F.col("preference").alias("ps"))
    b = nodes.select(F.col("id").alias("t"), F.col("activity").alias("at"), F.col("preference").alias("pt"))
    return a.join(b, F.col("s") != F.col("t")).crossJoin(F.broadcast(whole)).select("s", "t", ((F.lit(f) * F.col("as") * F.col("pt") + F.lit(1 - f) * F.col("at") * F.col("ps")) / F.col("whole")).alias("volume"))


def volume_sweep(paths: DataFrame, route_id: int, steps: int = 20) -> DataFrame:
    """Copies of all volumes in which one route's grows by equal steps to its full size."""
    grid = paths.sparkSession.range(1, steps + 1).withColumnRenamed("id", "step")
    return grid.crossJoin(paths.select("route_id", "volume")).select("step", "route_id", F.when(F.col("route_id") == route_id, F.col("volume").cast("double") * F.col("step") / steps).otherwise(F.col("volume").cast("double")).alias("volume"))


def top_routes(paths: DataFrame, k: int = 100, colours: int = 10) -> DataFrame:
    """The k routes with most traffic between different ends, with a colour by rank."""
    text = F.array_join(F.transform("route", lambda x: F.lpad(x.cast("string"), 6, "0")), "-")
    best = paths.where(F.element_at("route", 1) != F.element_at("route", -1)).withColumn("name", text).orderBy(F.desc("volume"), F.desc("name")).limit(k)
    # k rows at most.
    rank = F.row_number().over(Window.orderBy(F.desc("volume"), F.desc("name")))
    return best.select("name", "volume", rank.alias("rank"), ((rank - 1) % colours).alias("colour"))
