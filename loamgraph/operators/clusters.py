"""Connected components, single-linkage clusters on the sphere, representatives, contraction."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.stage import stage
from .edges import quotient


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (the smallest id): labels go to neighbours, then to the label's label, until they rest."""
    both = stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")))
    now = stage(nodes.select("id", F.col("id").alias("component")))
    for _ in range(most_rounds):
        heard = both.join(now, F.col("v") == F.col("id")).groupBy("u").agg(F.min("component").alias("m"))
        moved = now.join(heard, F.col("id") == F.col("u"), "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("c"))
        jump = moved.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        after = stage(moved.join(jump, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("component"), (F.least("c", F.coalesce("cc", "c")) != F.col("component")).alias("changed")))
        now = after.select("id", "component")
        if after.where("changed").isEmpty():
            return now
    raise RuntimeError("components did not settle")


def close_pairs(nodes: DataFrame, radians: float) -> DataFrame:
    """a < b with a great-circle angle below `radians`.

    Unit vectors fall into cubes as wide as the chord; only cubes that touch are compared, by an
    equi-join, so that pairs far apart are never made.
    """
    x, y, z = geo.sphere_point(F.col("lat"), F.col("lon"))
    chord = max(2 * math.sin(min(radians, math.pi) / 2) * (1 + 1e-9), 1e-9)
    cell = lambda c: F.floor(c / chord)
    placed = nodes.select("id", "lat", "lon", cell(x).alias("i"), cell(y).alias("j"), cell(z).alias("k"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = placed
    for c in "ijk":
        spread = spread.withColumn(f"d{c}", F.explode(near)).withColumn(c, F.col(c) + F.col(f"d{c}"))
    a = placed.select(F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "i", "j", "k")
    b = spread.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "i", "j", "k")
    angle = geo.spherical_distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return a.join(b, ["i", "j", "k"]).where("a < b").where(angle < radians).select("a", "b")


def single_linkage(nodes: DataFrame, radians: float) -> DataFrame:
    """id, component: clusters of nodes that chains of close pairs connect."""
    return components(nodes, close_pairs(nodes, radians))


def representatives(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """id, component, rep: the member nearest the cluster's mean direction; ties (to 12 digits) go to the smallest id."""
    x, y, z = geo.sphere_point(F.col("lat"), F.col("lon"))
    placed = nodes.select("id", x.alias("x"), y.alias("y"), z.alias("z")).join(clusters, "id")
    centre = placed.groupBy("component").agg(*[F.sum(c).alias(f"c{c}") for c in "xyz"])
    scored = placed.join(centre, "component").withColumn("dot", F.round(F.col("x") * F.col("cx") + F.col("y") * F.col("cy") + F.col("z") * F.col("cz"), 12))
    best = scored.groupBy("component").agg(F.min(F.struct((-F.col("dot")).alias("m"), "id")).alias("best")).select("component", F.col("best.id").alias("rep"))
    return clusters.join(best, "component").select("id", "component", "rep")


def contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    return quotient(edges, mapping.select("id", "rep"))


def contract_all(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """`contract` with the least bound between two clusters."""
    a, b = (mapping.select(F.col("id").alias(c), F.col("rep").alias(f"r{c}")) for c in "ab")
    moved = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "rtt_us", "throughput", "gcl_us")
    return moved.groupBy("a", "b").agg(F.min("rtt_us").alias("rtt_us"), F.sum("throughput").alias("throughput"), F.min("gcl_us").alias("gcl_us"))


def relabel_routes(paths: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes replaced by their representatives, equal neighbours once.  paths: route_id, route."""
    placed = paths.select("route_id", F.posexplode("route").alias("pos", "id")).join(mapping.select("id", "rep"), "id")
    listed = placed.groupBy("route_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rep"))), lambda x: x["rep"]).alias("route"))
    return listed.select("route_id", F.filter("route", lambda x, i: (i == 0) | (x != F.get("route", i - 1))).alias("route"))
