"""Queries over edges, geometry and triangles."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import edges as E
from ..operators import triangles as T
from . import network as net
from .network import ANGLE, GCL, NET, PI
from .registry import Tables, query

r6 = lambda c: F.round(c, 6)


@query(NET + "SELECT * FROM dedges")
def base_edges(t: Tables) -> DataFrame:
    return net.directed(t)


@query(NET + f"SELECT x.id AS source, y.id AS target, round({GCL('x', 'y')}, 6) AS gcl_ms FROM nodes x, nodes y")
def gcl_pairs(t: Tables) -> DataFrame:
    n = net.nodes(t)
    a, b = (n.select(F.col("id").alias(i), F.col("lat").alias(f"{i}_lat"), F.col("lon").alias(f"{i}_lon")) for i in ("source", "target"))
    return a.crossJoin(b).select("source", "target", r6(geo.gcl_ms(F.col("source_lat"), F.col("source_lon"), F.col("target_lat"), F.col("target_lon"))).alias("gcl_ms"))


@query(NET + f"SELECT x.id AS source, y.id AS target, round({ANGLE('x', 'y')}, 6) AS angle FROM nodes x, nodes y WHERE x.id < y.id")
def spherical_distances(t: Tables) -> DataFrame:
    n = net.nodes(t)
    a, b = (n.select(F.col("id").alias(i), F.col("lat").alias(f"{i}_lat"), F.col("lon").alias(f"{i}_lon")) for i in ("source", "target"))
    return a.join(b, F.col("source") < F.col("target")).select("source", "target", r6(geo.spherical_distance(F.col("source_lat"), F.col("source_lon"), F.col("target_lat"), F.col("target_lon"))).alias("angle"))


@query(NET + "SELECT id, round(cos(radians(lon))*cos(radians(lat)), 6) + 0 AS x, round(sin(radians(lon))*cos(radians(lat)), 6) + 0 AS y, round(sin(radians(lat)), 6) + 0 AS z, round(degrees(asin(sin(radians(lat)))), 6) AS lat_back FROM nodes")
def sphere_points(t: Tables) -> DataFrame:
    x, y, z = geo.sphere_point(F.col("lat"), F.col("lon"))
    return net.nodes(t).select("id", (r6(x) + 0).alias("x"), (r6(y) + 0).alias("y"), (r6(z) + 0).alias("z"), r6(geo.lat_long(x, y, z)[0]).alias("lat_back"))


@query(NET + f"SELECT id, round(lon/360, 6) AS x, round(ln(tan({PI}/4 + lat*{PI}/360))/(2*{PI}), 6) + 0 AS y, round(lon, 6) AS lon_back, round(lat, 6) + 0 AS lat_back FROM nodes")
def mercator_nodes(t: Tables) -> DataFrame:
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    lon, lat = geo.inverse_mercator(x, y)
    return net.nodes(t).select("id", r6(x).alias("x"), (r6(y) + 0).alias("y"), r6(lon).alias("lon_back"), (r6(lat) + 0).alias("lat_back"))


@query(NET + "SELECT * FROM near")
def threshold_edges(t: Tables) -> DataFrame:
    return net.near(t)


@query(NET + "SELECT a, b, rtt_us, gcl_us + 50000 AS gcl_us FROM edges WHERE rtt_us < gcl_us + 50000")
def residual_violations(t: Tables) -> DataFrame:
    return E.violations(net.undirected(t).withColumn("gcl_us", F.col("gcl_us") + 50000)).select("a", "b", "rtt_us", "gcl_us")


@query(NET + "SELECT d.source AS s, d.target AS t, d.rtt_us + e.rtt_us AS round_trip, abs(d.rtt_us - e.rtt_us) AS difference FROM dedges d JOIN dedges e ON d.source = e.target AND d.target = e.source WHERE d.source < d.target")
def rtt_symmetry(t: Tables) -> DataFrame:
    return E.symmetric_rtt(net.directed(t), "rtt_us").select("s", "t", (F.col("there") + F.col("back")).alias("round_trip"), F.abs(F.col("there") - F.col("back")).alias("difference"))


@query(NET + "SELECT a, b, rtt_us, throughput, gcl_us FROM edges")
def canonical_pairs(t: Tables) -> DataFrame:
    return net.undirected(t)


@query(NET + "SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM nodes")
def bounding_box(t: Tables) -> DataFrame:
    return net.nodes(t).agg(F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"))


def support(t: Tables, factor: float = 0.8) -> DataFrame:
    """Nodes on the mesh's support (Mercator plane, centred, scaled)."""
    x, y = geo.mercator(F.col("lon"), F.col("lat"))
    p = net.nodes(t).select("id", x.alias("mx"), y.alias("my"))
    box = p.agg(F.min("mx").alias("x0"), F.max("mx").alias("x1"), F.min("my").alias("y0"), F.max("my").alias("y1"))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    # The box is a single row.
    return p.crossJoin(F.broadcast(box)).select("id", geo.to_support(F.col("mx"), F.col("x0"), F.col("x1"), side, factor).alias("x"), geo.to_support(F.col("my"), F.col("y0"), F.col("y1"), side, factor).alias("y"))


SUPPORT = f""", merc AS (SELECT id, lon/360 AS mx, ln(tan({PI}/4 + lat*{PI}/360))/(2*{PI}) AS my FROM nodes),
box AS (SELECT min(mx) AS x0, max(mx) AS x1, min(my) AS y0, max(my) AS y1 FROM merc),
support AS (SELECT id, CAST(0.8 AS DOUBLE)*(mx - (x0+x1)/2)/greatest(x1-x0, y1-y0) + CAST(0.5 AS DOUBLE) AS x, CAST(0.8 AS DOUBLE)*(my - (y0+y1)/2)/greatest(x1-x0, y1-y0) + CAST(0.5 AS DOUBLE) AS y FROM merc, box)
"""


@query(NET + SUPPORT + "SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM support")
def support_coords(t: Tables) -> DataFrame:
    return support(t).select("id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(NET + "SELECT id, CAST(sum(o) AS BIGINT) AS total_out, CAST(sum(i) AS BIGINT) AS total_in FROM (SELECT source AS id, throughput AS o, 0 AS i FROM dedges UNION ALL SELECT target, 0, throughput FROM dedges) GROUP BY id")
def node_totals(t: Tables) -> DataFrame:
    return E.node_totals(net.directed(t))


@query(
    NET
    + """, m AS (SELECT least(source, target) AS a, greatest(source, target) AS b, min(rtt_us) AS rtt_us FROM dedges WHERE (source + target) % 3 <> 0 GROUP BY 1, 2),
w AS (SELECT a, b, coalesce(m.rtt_us, gcl_us) AS rtt_us FROM edges LEFT JOIN m USING (a, b))
SELECT a AS source, b AS target, rtt_us FROM w UNION ALL SELECT b, a, rtt_us FROM w"""
)
def missing_delay_completion(t: Tables) -> DataFrame:
    links = net.directed(t)
    return E.complete_delays(links, links.where((F.col("source") + F.col("target")) % 3 != 0))


@query(NET + "SELECT CASE WHEN gcl_us < 40000 THEN 'near' WHEN gcl_us < 120000 THEN 'mid' ELSE 'far' END AS band, count(*) AS edges, min(rtt_us) AS least, max(rtt_us) AS most FROM edges GROUP BY 1")
def distance_bands(t: Tables) -> DataFrame:
    return E.distance_band(net.undirected(t), 40000, 120000).groupBy("band").agg(F.count(F.lit(1)).alias("edges"), F.min("rtt_us").alias("least"), F.max("rtt_us").alias("most"))


@query(NET + "SELECT d.source, d.target, d.throughput FROM dsum d WHERE d.source IN (SELECT id FROM nodes WHERE country <> 'ASIA') AND d.target IN (SELECT id FROM nodes WHERE country <> 'ASIA')")
def known_endpoints(t: Tables) -> DataFrame:
    return E.known_ends(net.directed(t), net.nodes(t).where("country <> 'ASIA'")).select("source", "target", "throughput")


@query("SELECT user_id, min(CASE WHEN value > 50 THEN value END) AS least, count(*) AS n FROM events GROUP BY user_id")
def positive_minimum(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.min(F.when(F.col("value") > 50, F.col("value"))).alias("least"), F.count(F.lit(1)).alias("n"))


TRI = ", tri AS (SELECT e.a AS u, e.b AS v, f.b AS w, e.rtt_us AS uv, g.rtt_us AS uw, f.rtt_us AS vw FROM edges e JOIN edges f ON e.b = f.a JOIN edges g ON g.a = e.a AND g.b = f.b),\ngood AS (SELECT *, CAST(greatest(uv, uw, vw) AS DOUBLE)/CAST(uv+uw+vw-greatest(uv, uw, vw) AS DOUBLE) AS goodness FROM tri),\nlong_edges AS (SELECT DISTINCT CASE WHEN uv > uw AND uv > vw THEN u WHEN uw >= uv AND uw > vw THEN u ELSE v END AS a, CASE WHEN uv > uw AND uv > vw THEN v ELSE w END AS b FROM good WHERE goodness > 1)\n"


@query(NET + TRI + "SELECT * FROM tri")
def triangles(t: Tables) -> DataFrame:
    return T.triangles(net.undirected(t))


@query(NET + TRI + "SELECT u, v, w, round(goodness, 6) AS goodness, round(goodness*(1 + 2*greatest(uv, uw, vw) - (uv+uw+vw)), 4) AS variant FROM good")
def goodness(t: Tables) -> DataFrame:
    top = F.greatest("uv", "uw", "vw")
    return T.with_goodness(T.triangles(net.undirected(t))).select("u", "v", "w", r6(F.col("goodness")).alias("goodness"), F.round(F.col("goodness") * (1 + 2 * top - (F.col("uv") + F.col("uw") + F.col("vw"))), 4).alias("variant"))


@query(NET + TRI + "SELECT country, count(*) AS edges, CAST(sum(throughput) AS BIGINT) AS throughput FROM edges e JOIN nodes ON id = e.a WHERE NOT EXISTS (SELECT 1 FROM long_edges l WHERE l.a = e.a AND l.b = e.b) GROUP BY country")
def tiv_edges(t: Tables) -> DataFrame:
    """Edges that no violated triangle inequality removes, by region of their first end."""
    left = T.remove_violations(net.undirected(t))
    return left.join(net.nodes(t), F.col("a") == F.col("id")).groupBy("country").agg(F.count(F.lit(1)).alias("edges"), F.sum("throughput").alias("throughput"))


@query(NET + TRI + "SELECT round(avg(CASE WHEN goodness > 1 THEN 1 ELSE 0 END), 6) AS violating, round((SELECT count(*) FROM long_edges)/CAST((SELECT count(*) FROM edges) AS DOUBLE), 6) AS long_share, round(max(goodness), 6) AS worst FROM good")
def tiv_proportions(t: Tables) -> DataFrame:
    e = net.undirected(t)
    found = T.triangles(e)
    a = T.with_goodness(found).agg(r6(F.avg(F.when(F.col("goodness") > 1, 1.0).otherwise(0.0))).alias("violating"), r6(F.max("goodness")).alias("worst"))
    b = T.long_edges(found).agg(F.count(F.lit(1)).alias("n"))
    c = e.agg(F.count(F.lit(1)).alias("m"))
    return a.crossJoin(b).crossJoin(c).select("violating", r6(F.col("n") / F.col("m")).alias("long_share"), "worst")


@query(NET + TRI + "SELECT goodness, round(max(share), 6) AS share FROM (SELECT round(goodness, 6) AS goodness, cume_dist() OVER (ORDER BY round(goodness, 6)) AS share FROM good) GROUP BY goodness")
def goodness_ecdf(t: Tables) -> DataFrame:
    from ..operators.stats import ecdf

    return ecdf(T.with_goodness(T.triangles(net.undirected(t))).select(r6(F.col("goodness")).alias("goodness")), "goodness").select("goodness", r6(F.col("share")).alias("share"))


@query(NET + "SELECT id, round(CASE WHEN gap IS NULL THEN NULL ELSE lon + gap/2 END, 6) AS cut, round(gap, 6) AS gap FROM (SELECT id, lon, coalesce(lead(lon) OVER (ORDER BY lon, id), (SELECT min(lon) FROM nodes) + 360) - lon AS gap FROM nodes) ORDER BY gap DESC, lon LIMIT 1")
def longitude_cut(t: Tables) -> DataFrame:
    """The middle of the widest gap between longitudes, around the circle."""
    from pyspark.sql import Window

    n = net.nodes(t)
    first = n.agg(F.min("lon").alias("first"))
    gap = (F.coalesce(F.lead("lon").over(Window.orderBy("lon", "id")), F.col("first") + 360) - F.col("lon")).alias("gap")
    return n.crossJoin(F.broadcast(first)).select("id", "lon", gap).orderBy(F.desc("gap"), "lon").limit(1).select("id", r6(F.col("lon") + F.col("gap") / 2).alias("cut"), r6(F.col("gap")).alias("gap"))


@query("SELECT i, round(h, 6) AS h FROM (SELECT i, (2*(CAST(0.1 AS DOUBLE) + CAST(0.3 AS DOUBLE) - 2*CAST(0.9 AS DOUBLE))*(i/CAST(32 AS DOUBLE) - 0.5)*(i/CAST(32 AS DOUBLE) - 0.5) + (CAST(0.3 AS DOUBLE) - CAST(0.1 AS DOUBLE))*(i/CAST(32 AS DOUBLE) - 0.5) + CAST(0.9 AS DOUBLE)) AS h FROM (SELECT unnest(range(33)) AS i))")
def arc_points(t: Tables) -> DataFrame:
    return t.spark.range(33).select(F.col("id").alias("i"), r6(geo.arc_height(geo.lit(0.1), geo.lit(0.9), geo.lit(0.3), F.col("id") / geo.lit(32))).alias("h"))


