"""Queries over augmented graphs, scenarios, lookups and the remaining losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import augment as A
from ..operators import mesh as M
from ..operators import numeric as N
from ..operators import paths as P
from ..operators import stats
from ..operators import traffic as X
from ..operators import transport as W
from . import network as net
from .basic import r6, support
from .graph import DIST, ROUTES, TOT, loaded_routes
from .graph import parts as graph_parts
from .network import NET
from .registry import Tables, query
from .stage import stage
from .surface import EPS, FAT, MESH, SEG, segments
from .surface import parts as mesh_parts


@query(NET + "SELECT CAST(a AS VARCHAR) AS u, CAST(b AS VARCHAR) AS v, rtt_us AS w FROM near UNION ALL SELECT CAST(a AS VARCHAR), concat(a, ':', b), rtt_us FROM near UNION ALL SELECT CAST(b AS VARCHAR), concat(b, ':', a), rtt_us FROM near")
def augmented_graph(t: Tables) -> DataFrame:
    return A.augmented_edges(net.near(t))


@query(NET + DIST + ", ends AS (SELECT id AS node, CAST(id AS VARCHAR) AS name, 0 AS extra FROM nodes UNION ALL SELECT u, concat(u, ':', v), d FROM (SELECT DISTINCT u, v FROM adj) JOIN dist ON s = u AND t = v) SELECT x.name AS u, y.name AS v, CAST(d + x.extra + y.extra AS BIGINT) AS d FROM dist JOIN ends x ON x.node = s JOIN ends y ON y.node = t")
def augmented_distance(t: Tables) -> DataFrame:
    _, adjacent, distances = graph_parts(t)
    return A.augmented_distances(distances, adjacent)


@query()
def augmented_ricci(t: Tables) -> DataFrame:
    return W.ricci(net.near(t), augmented=True).select("a", "b", r6(F.col("curvature")).alias("curvature"))


@query(NET + ", adj AS (SELECT a AS u, b AS v, throughput AS w FROM near UNION ALL SELECT b, a, throughput FROM near) SELECT u AS x, v AS y, round(CAST(0.75 AS DOUBLE)*w/(sum(w) OVER (PARTITION BY u)), 6) AS mass FROM adj UNION ALL SELECT id, id, CASE WHEN id IN (SELECT u FROM adj) THEN CAST(0.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END FROM nodes")
def neighbour_mass(t: Tables) -> DataFrame:
    adjacent = P.adjacency(net.near(t), "throughput")
    return A.distributions(adjacent, net.nodes(t), 0.25).select("x", "y", r6(F.col("mass")).alias("mass"))


@query()
def commute_times(t: Tables) -> DataFrame:
    return N.commute(net.near(t).withColumn("graph", F.lit(0)), "graph").select("s", "t", r6(F.col("steps")).alias("steps"))


OUT = DIST.replace("FROM near", "FROM near WHERE (a + b) % 5 <> 0")


@query(NET + OUT + "SELECT * FROM dist")
def outage_distance(t: Tables) -> DataFrame:
    """Distances after an outage of a set of edges."""
    edges = net.near(t)
    left = A.without(edges, edges.where("(a + b) % 5 = 0"))
    return P.closure(stage(P.adjacency(left, "rtt_us")), stage(net.nodes(t)))


RANDOM = DIST.replace("rtt_us AS w", "(a*7919 + b*104729) % 1009 + 1 AS w").replace("rtt_us FROM near", "(a*7919 + b*104729) % 1009 + 1 FROM near")


@query(NET + RANDOM + "SELECT * FROM dist")
def random_distance(t: Tables) -> DataFrame:
    """Distances under weights hashed from the ends."""
    edges = net.near(t).withColumn("weight", (F.col("a") * 7919 + F.col("b") * 104729) % 1009 + 1)
    return P.closure(stage(P.adjacency(edges, "weight")), stage(net.nodes(t)))


@query("WITH ad AS (SELECT c_custkey, CAST(100000 + (c_custkey*7919) % 900000 AS VARCHAR) AS address FROM customer), pf AS (SELECT DISTINCT left(CAST(100000 + (s_suppkey*104729) % 900000 AS VARCHAR), CAST(2 + s_suppkey % 3 AS INTEGER)) AS prefix FROM supplier) SELECT c_custkey, ad.address, (SELECT concat('as', prefix) FROM pf WHERE starts_with(ad.address, prefix) ORDER BY length(prefix) DESC LIMIT 1) AS owner FROM ad")
def prefix_match(t: Tables) -> DataFrame:
    addresses = t.customer.select("c_custkey", (100000 + (F.col("c_custkey") * 7919) % 900000).cast("string").alias("address"))
    prefixes = t.supplier.select(F.expr("left(cast(100000 + (s_suppkey*104729) % 900000 as string), cast(2 + s_suppkey % 3 as int))").alias("prefix")).distinct().withColumn("owner", F.concat(F.lit("as"), F.col("prefix")))
    return A.longest_prefix(addresses, prefixes).select("c_custkey", "address", "owner")


@query(NET + "SELECT a, b, rtt_us, w.throughput, n AS orders FROM near w JOIN (SELECT least(source, target) AS a, greatest(source, target) AS b, count(*) AS n FROM raw WHERE source <> target GROUP BY 1, 2) USING (a, b)")
def parallel_lists(t: Tables) -> DataFrame:
    near = net.near(t)
    counts = net.raw_links(t).where("source <> target").groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.count(F.lit(1)).alias("orders"))
    return A.common_keys(near.select("a", "b", "rtt_us"), near.select("a", "b", "throughput"), counts, key=["a", "b"])


@query(NET + ROUTES + TOT + "SELECT q.source AS s, q.target AS t, throughput AS truth, coalesce(v.volume, 0) AS estimate FROM dsum q LEFT JOIN (SELECT u, v AS w, CAST(sum(volume) AS BIGINT) AS volume FROM hop GROUP BY 1, 2) v ON v.u = q.source AND v.w = q.target")
def truth_and_estimate(t: Tables) -> DataFrame:
    """Each pair's own traffic beside what its direct link carries; 0 where there is no link."""
    carried = X.link_traffic(loaded_routes(t)[3]).withColumnsRenamed({"u": "s", "v": "t", "volume": "estimate"})
    own = net.directed(t).select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("throughput").alias("truth"))
    return own.join(carried, ["s", "t"], "left").withColumn("estimate", F.coalesce("estimate", F.lit(0).cast("long")))


@query(NET + "SELECT round(1 - regr_r2(CAST(rtt_us AS DOUBLE), CAST(gcl_us AS DOUBLE)), 6) AS loss FROM edges")
def geodesic_loss(t: Tables) -> DataFrame:
    """Unexplained share of round trips by distance."""
    rows = net.undirected(t).select(F.col("rtt_us").cast("double").alias("y"), F.col("gcl_us").cast("double").alias("x"))
    return stats.regression(rows, "y", "x").select(r6(1 - F.col("r2")).alias("loss"))


@query(NET + SEG + ", " + MESH + FAT + ", keep AS (SELECT DISTINCT pid AS vid FROM fat) SELECT fid, u, v, w FROM face WHERE u IN (SELECT vid FROM keep) AND v IN (SELECT vid FROM keep) AND w IN (SELECT vid FROM keep)")
def trimmed_mesh(t: Tables) -> DataFrame:
    """The mesh near the network only."""
    v, f, _, _ = mesh_parts(t)
    fat = M.points_near_segments(v.withColumnRenamed("vid", "pid"), segments(t).drop("rtt_us"), EPS)
    return A.trimmed(f, fat.select(F.col("pid").alias("vid")).distinct())


@query(NET + SEG + "SELECT id AS cluster, i AS member, round(cos(2*pi()*i/6)*CAST(0.02 AS DOUBLE) + x, 6) + 0 AS x, round(sin(2*pi()*i/6)*CAST(0.02 AS DOUBLE) + y, 6) + 0 AS y FROM support, (SELECT unnest(range(6)) AS i)")
def synthetic_clusters(t: Tables) -> DataFrame:
    """Rings of made-up nodes around the network's places."""
    turn = 2 * F.pi() * F.col("member") / 6
    rings = support(t).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return rings.select(F.col("id").alias("cluster"), "member", (r6(F.cos(turn) * 0.02 + F.col("x")) + 0).alias("x"), (r6(F.sin(turn) * 0.02 + F.col("y")) + 0).alias("y"))


@query(NET + "SELECT file_name, rank FROM (SELECT concat('snap_', CAST(y AS VARCHAR)) AS file_name, CAST(row_number() OVER (ORDER BY y) AS INTEGER) AS rank FROM (SELECT DISTINCT year(ts) AS y FROM raw)) WHERE rank <= 3")
def first_files(t: Tables) -> DataFrame:
    """The first few snapshots in order of their names."""
    from pyspark.sql import Window

    names = net.raw_links(t).select(F.concat(F.lit("snap_"), F.year("ts").cast("string")).alias("file_name")).distinct().orderBy("file_name").limit(3)
    return names.withColumn("rank", F.row_number().over(Window.orderBy("file_name")))


@query(NET + "SELECT id, concat('node ', id, ' ', lower(city), ' @', CAST(CAST(lat AS INTEGER) AS VARCHAR)) AS line FROM nodes")
def config_lines(t: Tables) -> DataFrame:
    """One configuration line for each node."""
    return net.nodes(t).select("id", F.concat(F.lit("node "), F.col("id").cast("string"), F.lit(" "), F.lower("city"), F.lit(" @"), F.col("lat").cast("int").cast("string")).alias("line"))


