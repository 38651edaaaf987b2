"""A network derived from the star-schema tables: nations are nodes, orders between them are links.

Round trips are whole microseconds, so that path sums are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import edges as E
from .registry import Tables

#: Microseconds above the great-circle bound that an edge may take, for paths and for components.
NEAR_US = 20_000
TIGHT_US = 5_000


def nodes(t: Tables) -> DataFrame:
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(
        F.col("n_nationkey").alias("id"),
        (F.lit(-60) + (F.col("n_nationkey") * 37) % 121).cast("double").alias("lat"),
        (F.lit(-180) + (F.col("n_nationkey") * 97) % 360).cast("double").alias("lon"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("country"),
    )


def raw_links(t: Tables) -> DataFrame:
    """One row for each line item: supplier's nation to customer's nation."""
    items = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_quantity").cast("long").alias("throughput"), F.col("l_shipdate").alias("ts"))
    customers = t.orders.select("o_orderkey", "o_custkey").join(t.customer.select("c_custkey", F.col("c_nationkey").alias("target")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "target")
    suppliers = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("source"))
    return items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(customers, F.col("l_orderkey") == F.col("o_orderkey")).select("source", "target", "throughput", "ts")


def located(links: DataFrame, places: DataFrame) -> DataFrame:
    """Links with gcl_us, the great-circle bound between their ends."""
    a = places.select(F.col("id").alias("source"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = places.select(F.col("id").alias("target"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    bound = F.round(geo.gcl_ms(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) * 1000).cast("long")
    return links.join(a, "source").join(b, "target").select(*links.columns, bound.alias("gcl_us"))


def directed(t: Tables) -> DataFrame:
    """source, target, throughput, gcl_us, rtt_us for each ordered pair of different nations."""
    summed = E.drop_self_loops(raw_links(t)).groupBy("source", "target").agg(F.sum("throughput").alias("throughput"))
    rtt = F.col("gcl_us") + (F.col("source") * 31 + F.col("target") * 17 + F.col("throughput") * 7919) % 100000
    return located(summed, nodes(t)).withColumn("rtt_us", rtt)


def undirected(t: Tables) -> DataFrame:
    """a < b, rtt_us (least), throughput (sum), gcl_us."""
    return E.dedupe_edges(directed(t))


def near(t: Tables) -> DataFrame:
    return E.threshold(undirected(t), NEAR_US)


def _gcl(x: str, y: str) -> str:
    dot = f"cos(radians({x}.lon))*cos(radians({x}.lat))*cos(radians({y}.lon))*cos(radians({y}.lat))+sin(radians({x}.lon))*cos(radians({x}.lat))*sin(radians({y}.lon))*cos(radians({y}.lat))+sin(radians({x}.lat))*sin(radians({y}.lat))"
    return f"(CASE WHEN {x}.lat={y}.lat AND {x}.lon={y}.lon THEN CAST(0 AS DOUBLE) ELSE CAST(2000 AS DOUBLE)*acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), {dot})))*CAST({geo.RADIUS!r} AS DOUBLE)/CAST({2 * geo.LIGHT / 3!r} AS DOUBLE) END)"


GCL = _gcl
ANGLE = lambda x, y: f"({_gcl(x, y)}*CAST({(2 * geo.LIGHT / 3) / 2000 / geo.RADIUS!r} AS DOUBLE))"
PI = f"CAST({math.pi!r} AS DOUBLE)"

#: The same tables as common table expressions.
NET = f"""WITH RECURSIVE nodes AS (
  SELECT n_nationkey AS id, CAST(-60 + (n_nationkey*37)%121 AS DOUBLE) AS lat, CAST(-180 + (n_nationkey*97)%360 AS DOUBLE) AS lon, n_name AS city, r_name AS country
  FROM nation JOIN region ON n_regionkey = r_regionkey),
raw AS (
  SELECT s_nationkey AS source, c_nationkey AS target, CAST(l_quantity AS BIGINT) AS throughput, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
dsum AS (SELECT source, target, CAST(sum(throughput) AS BIGINT) AS throughput FROM raw WHERE source <> target GROUP BY 1, 2),
dgcl AS (SELECT d.*, CAST(round({_gcl('x', 'y')}*1000) AS BIGINT) AS gcl_us FROM dsum d JOIN nodes x ON x.id = d.source JOIN nodes y ON y.id = d.target),
dedges AS (SELECT *, gcl_us + (source*31 + target*17 + throughput*7919) % 100000 AS rtt_us FROM dgcl),
edges AS (SELECT least(source, target) AS a, greatest(source, target) AS b, min(rtt_us) AS rtt_us, CAST(sum(throughput) AS BIGINT) AS throughput, min(gcl_us) AS gcl_us FROM dedges GROUP BY 1, 2),
near AS (SELECT * FROM edges WHERE rtt_us - gcl_us <= {NEAR_US}),
tight AS (SELECT * FROM edges WHERE rtt_us - gcl_us <= {TIGHT_US})
"""
