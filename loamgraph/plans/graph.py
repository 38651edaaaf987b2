"""Queries over paths, clusters and traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import edges as E
from ..operators import paths as P
from ..operators import traffic as X
from ..operators import transport as W
from . import network as net
from .basic import r6
from .network import ANGLE, NET
from .registry import Tables, query
from .stage import stage


def _closure_sql(weight: str, prefix: str = "d") -> str:
    out = f""", adj AS (SELECT a AS u, b AS v, rtt_us AS w FROM near UNION ALL SELECT b, a, rtt_us FROM near),
{prefix}0 AS MATERIALIZED (SELECT s, t, min(d) AS d FROM (SELECT u AS s, v AS t, {weight} AS d FROM adj UNION ALL SELECT id, id, 0 FROM nodes) GROUP BY 1, 2)"""
    for i in range(5):
        out += f",\n{prefix}{i + 1} AS MATERIALIZED (SELECT x.s, y.t, min(x.d + y.d) AS d FROM {prefix}{i} x JOIN {prefix}{i} y ON x.t = y.s GROUP BY 1, 2)"
    return out


DIST = _closure_sql("w") + ", dist AS (SELECT s, t, CAST(d AS BIGINT) AS d FROM d5)\n"
ROUTES = DIST + """, pred AS (SELECT s, v, u FROM (SELECT x.s, j.v, j.u, row_number() OVER (PARTITION BY x.s, j.v ORDER BY x.d, j.u) AS k FROM dist x JOIN adj j ON x.t = j.u JOIN dist y ON y.s = x.s AND y.t = j.v WHERE x.d + j.w = y.d AND x.s <> j.v) WHERE k = 1),
walk AS (SELECT id AS s, id AS t, [id] AS route FROM nodes UNION ALL SELECT w.s, p.v, list_append(w.route, p.v) FROM walk w JOIN pred p ON p.s = w.s AND p.u = w.t),
vol AS (SELECT w.s*1000 + w.t AS route_id, w.s, w.t, w.route, coalesce(q.throughput, 0) AS volume FROM walk w LEFT JOIN dsum q ON q.source = w.s AND q.target = w.t),
hop AS (SELECT route_id, volume, i AS pos, route[i] AS u, route[i+1] AS v FROM (SELECT *, unnest(range(1, len(route))) AS i FROM vol))
"""


def parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, near edges' adjacency and distances; the derived tables are written, as several steps read them."""
    nodes = stage(net.nodes(t))
    adjacent = stage(P.adjacency(net.near(t), "rtt_us"))
    return nodes, adjacent, P.closure(adjacent, nodes)


def loaded_routes(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """parts() and route_id, s, t, route, volume."""
    nodes, adjacent, distances = parts(t)
    walks = P.routes(P.predecessors(distances, adjacent), nodes)
    demand = net.directed(t).select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("throughput").alias("volume"))
    paths = stage(walks.join(demand, ["s", "t"], "left").select((F.col("s") * 1000 + F.col("t")).cast("long").alias("route_id"), "s", "t", "route", F.coalesce("volume", F.lit(0).cast("long")).alias("volume")))
    return nodes, adjacent, distances, paths


def dashed(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), "-")


DASH = "array_to_string(list_transform({}, lambda x: CAST(x AS VARCHAR)), '-')".format


@query(NET + _closure_sql("1", "h") + "SELECT s, t, CAST(d AS BIGINT) AS hops FROM h5")
def hop_distance(t: Tables) -> DataFrame:
    nodes = stage(net.nodes(t))
    return P.closure(stage(P.adjacency(net.near(t), "rtt_us")).withColumn("w", F.lit(1)), nodes).withColumnRenamed("d", "hops")


@query(NET + DIST + "SELECT * FROM dist")
def weighted_distance(t: Tables) -> DataFrame:
    return parts(t)[2]


@query(NET + ROUTES + "SELECT s, t, route[2] AS next_hop FROM walk WHERE len(route) > 1")
def canonical_next_hop(t: Tables) -> DataFrame:
    return loaded_routes(t)[3].where(F.size("route") > 1).select("s", "t", F.col("route")[1].alias("next_hop"))


@query(NET + ROUTES + f"SELECT s, t, {DASH('route')} AS route FROM walk")
def shortest_routes(t: Tables) -> DataFrame:
    return loaded_routes(t)[3].select("s", "t", dashed("route").alias("route"))


@query(NET + ROUTES + "SELECT s, t, d AS weight FROM dist WHERE s <> t")
def route_rtt(t: Tables) -> DataFrame:
    """The sum along each route; it must equal the distance."""
    _, adjacent, _, paths = loaded_routes(t)
    return P.route_weights(paths, adjacent, ["s", "t"])


@query(
    NET
    + ROUTES
    + f""", want AS (SELECT x.id*100 + y.id AS route_id, [x.id, (x.id*7 + y.id) % 25, y.id] AS route FROM nodes x, nodes y WHERE x.id < y.id),
leg AS (SELECT route_id, i, w.route[1:] AS rest FROM (SELECT route_id, i, route[i] AS u, route[i+1] AS v FROM (SELECT *, unnest(range(1, len(route))) AS i FROM want)) JOIN walk w ON w.s = u AND w.t = v)
SELECT a.route_id, {DASH('list_concat(a.rest, b.rest[2:])')} AS route FROM leg a JOIN leg b ON a.route_id = b.route_id AND a.i = 1 AND b.i = 2"""
)
def fix_routes(t: Tables) -> DataFrame:
    nodes, _, _, paths = loaded_routes(t)
    x, y = nodes.select(F.col("id").alias("x")), nodes.select(F.col("id").alias("y"))
    wanted = x.join(y, F.col("x") < F.col("y")).select((F.col("x") * 100 + F.col("y")).alias("route_id"), F.array(F.col("x"), (F.col("x") * 7 + F.col("y")) % 25, F.col("y")).alias("route"))
    return P.fix_routes(wanted, paths).select("route_id", dashed("route").alias("route"))


@query(
    NET
    + DIST
    + """, gone AS (SELECT a AS ra, b AS rb FROM near),
k0 AS MATERIALIZED (SELECT ra, rb, s, t, min(d) AS d FROM (SELECT ra, rb, u AS s, v AS t, w AS d FROM gone JOIN adj ON NOT (least(u, v) = ra AND greatest(u, v) = rb) UNION ALL SELECT ra, rb, id, id, 0 FROM gone, nodes) GROUP BY ALL),
"""
    + ",\n".join(f"k{i + 1} AS MATERIALIZED (SELECT x.ra, x.rb, x.s, y.t, min(x.d + y.d) AS d FROM k{i} x JOIN k{i} y ON x.ra = y.ra AND x.rb = y.rb AND x.t = y.s GROUP BY ALL)" for i in range(5))
    + "\nSELECT ra AS a, rb AS b, round(sum(CAST(throughput*d AS DOUBLE))/sum(throughput) - (SELECT sum(CAST(throughput*d AS DOUBLE))/sum(throughput) FROM dist JOIN dsum ON source = s AND target = t), 4) AS growth FROM k5 JOIN dsum ON source = s AND target = t GROUP BY 1, 2"
)
def edge_criticality(t: Tables) -> DataFrame:
    edges = stage(net.near(t))
    return P.criticality(edges, stage(net.nodes(t)), stage(net.directed(t).select("source", "target", "throughput"))).select("a", "b", F.round("growth", 4).alias("growth"))


@query(NET + ROUTES + "SELECT round(sum(CAST(volume*(len(route)-1) AS DOUBLE))/sum(volume), 6) AS mean_hops FROM vol")
def mean_route_length(t: Tables) -> DataFrame:
    paths = loaded_routes(t)[3]
    return paths.agg(r6(F.sum((F.col("volume") * (F.size("route") - 1)).cast("double")) / F.sum("volume")).alias("mean_hops"))


@query(NET + ROUTES + "SELECT u AS node, v AS next_node, count(*) AS routes, CAST(sum(volume) AS BIGINT) AS bytes FROM hop GROUP BY 1, 2")
def next_hop_counters(t: Tables) -> DataFrame:
    paths = loaded_routes(t)[3]
    return P.hops(paths, ["volume"]).groupBy(F.col("u").alias("node"), F.col("v").alias("next_node")).agg(F.count(F.lit(1)).alias("routes"), F.sum("volume").alias("bytes"))


@query(NET + DIST + "SELECT s, t, CASE WHEN e.rtt_us IS NULL THEN dist.d WHEN e.rtt_us < dist.d THEN dist.d ELSE e.rtt_us END AS rtt_us FROM dist LEFT JOIN dedges e ON e.source = s AND e.target = t WHERE s <> t")
def rtt_repair(t: Tables) -> DataFrame:
    """Round trips below the shortest path, or missing, become the shortest path's."""
    d = parts(t)[2].where("s <> t")
    m = net.directed(t).select(F.col("source").alias("s"), F.col("target").alias("t"), "rtt_us")
    return d.join(m, ["s", "t"], "left").select("s", "t", F.when(F.col("rtt_us").isNull() | (F.col("rtt_us") < F.col("d")), F.col("d")).otherwise(F.col("rtt_us")).alias("rtt_us"))


REACH = ", sides AS (SELECT a AS u, b AS v FROM tight UNION SELECT b, a FROM tight), reach AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, v FROM reach r JOIN sides ON u = r.other)\n"


@query(NET + REACH + "SELECT id, min(other) AS component FROM reach GROUP BY id")
def components(t: Tables) -> DataFrame:
    return C.components(net.nodes(t), E.threshold(net.undirected(t), net.TIGHT_US))


@query(NET + REACH + "SELECT component, count(*) AS size FROM (SELECT id, min(other) AS component FROM reach GROUP BY id) GROUP BY 1 HAVING count(*) > 1")
def large_components(t: Tables) -> DataFrame:
    found = C.components(net.nodes(t), E.threshold(net.undirected(t), net.TIGHT_US))
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")


TAU = 0.6
LINK = f""", close AS (SELECT x.id AS u, y.id AS v FROM nodes x JOIN nodes y ON x.id <> y.id WHERE {ANGLE('x', 'y')} < CAST({TAU} AS DOUBLE)),
linked AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, v FROM linked r JOIN close ON u = r.other),
cluster AS (SELECT id, min(other) AS component FROM linked GROUP BY id),
vec AS (SELECT c.id, component, cos(radians(lon))*cos(radians(lat)) AS x, sin(radians(lon))*cos(radians(lat)) AS y, sin(radians(lat)) AS z FROM cluster c JOIN nodes n ON n.id = c.id),
cen AS (SELECT component, sum(x) AS cx, sum(y) AS cy, sum(z) AS cz FROM vec GROUP BY 1),
rep AS (SELECT component, id AS rep FROM (SELECT v.component, id, row_number() OVER (PARTITION BY v.component ORDER BY round(x*cx + y*cy + z*cz, 12) DESC, id) AS k FROM vec v JOIN cen ON cen.component = v.component) WHERE k = 1),
mapping AS (SELECT id, cluster.component, rep FROM cluster JOIN rep ON rep.component = cluster.component)
"""


def _mapping(t: Tables) -> tuple[DataFrame, DataFrame]:
    nodes = stage(net.nodes(t))
    return nodes, stage(C.representatives(nodes, C.single_linkage(nodes, TAU)))


@query(NET + LINK + "SELECT * FROM cluster")
def single_linkage(t: Tables) -> DataFrame:
    return C.single_linkage(net.nodes(t), TAU)


@query(NET + LINK + "SELECT * FROM mapping")
def cluster_reps(t: Tables) -> DataFrame:
    return _mapping(t)[1]


@query(NET + LINK + "SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, min(rtt_us) AS rtt_us, CAST(sum(throughput) AS BIGINT) AS throughput FROM edges e JOIN mapping x ON x.id = e.a JOIN mapping y ON y.id = e.b WHERE x.rep <> y.rep GROUP BY 1, 2")
def contracted_edges(t: Tables) -> DataFrame:
    return C.contract(net.undirected(t), _mapping(t)[1])


@query(
    NET
    + ROUTES
    + LINK
    + f", named AS (SELECT route_id, pos, rep, lag(rep) OVER (PARTITION BY route_id ORDER BY pos) AS last_rep FROM (SELECT route_id, unnest(range(1, len(route)+1)) AS pos, unnest(route) AS id FROM vol) JOIN mapping USING (id))\nSELECT route_id, string_agg(CAST(rep AS VARCHAR), '-' ORDER BY pos) AS route FROM named WHERE last_rep IS NULL OR last_rep <> rep GROUP BY 1"
)
def route_relabel(t: Tables) -> DataFrame:
    return C.relabel_routes(loaded_routes(t)[3], _mapping(t)[1]).select("route_id", dashed("route").alias("route"))


@query("SELECT o_orderkey, CASE WHEN x = y THEN CAST(x AS VARCHAR) ELSE concat(x, '-', y) END || CASE WHEN z <> x AND z <> y THEN concat('-', z) ELSE '' END AS path FROM (SELECT o_orderkey, o_orderkey % 3 AS x, CASE WHEN o_custkey % 4 = o_orderkey % 3 THEN o_orderkey % 3 ELSE o_custkey % 4 END AS y, 9 AS z FROM orders)")
def loop_removal(t: Tables) -> DataFrame:
    x, y = F.col("o_orderkey") % 3, F.col("o_custkey") % 4
    path = F.array(x, y, x, y, F.lit(9).cast("long"))
    return t.orders.select("o_orderkey", dashed(P.remove_loops(path)).alias("path"))


@query(NET + ROUTES + "SELECT u, v, CAST(sum(volume) AS BIGINT) AS volume FROM hop GROUP BY 1, 2")
def link_traffic(t: Tables) -> DataFrame:
    return X.link_traffic(loaded_routes(t)[3])


@query(NET + ROUTES + "SELECT x.id AS s, y.id AS t, coalesce(volume, 0) AS volume FROM nodes x CROSS JOIN nodes y LEFT JOIN vol ON vol.s = x.id AND vol.t = y.id")
def od_matrix(t: Tables) -> DataFrame:
    nodes, _, _, paths = loaded_routes(t)
    return X.od_matrix(paths, nodes)


REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(
    NET
    + "SELECT x.country AS origin, "
    + ", ".join(f"CAST(coalesce(sum(CASE WHEN y.country = '{r}' AND x.country <> y.country THEN throughput END), 0) AS BIGINT) AS to_{r.split()[0].lower()}" for r in REGIONS)
    + " FROM dedges JOIN nodes x ON x.id = source JOIN nodes y ON y.id = target GROUP BY 1"
)
def cluster_traffic_pivot(t: Tables) -> DataFrame:
    n = net.nodes(t)
    a, b = n.select(F.col("id").alias("source"), F.col("country").alias("origin")), n.select(F.col("id").alias("target"), F.col("country").alias("goal"))
    rows = net.directed(t).join(a, "source").join(b, "target").withColumn("throughput", F.when(F.col("origin") != F.col("goal"), F.col("throughput")))
    wide = rows.groupBy("origin").pivot("goal", REGIONS).agg(F.sum("throughput"))
    return wide.select("origin", *[F.coalesce(F.col(f"`{r}`"), F.lit(0).cast("long")).alias(f"to_{r.split()[0].lower()}") for r in REGIONS])


TOT = ", tot AS (SELECT id, CAST(sum(o) AS BIGINT) AS o, CAST(sum(i) AS BIGINT) AS i FROM (SELECT source AS id, throughput AS o, 0 AS i FROM dedges UNION ALL SELECT target, 0, throughput FROM dedges) GROUP BY id)\n"


@query(NET + TOT + "SELECT x.id AS s, y.id AS t, round(CAST(x.o AS DOUBLE)*y.i/(SELECT sum(CAST(p.o AS DOUBLE)*q.i) FROM tot p JOIN tot q ON p.id <> q.id WHERE p.o > 0 AND q.i > 0), 8) AS share FROM tot x JOIN tot y ON x.id <> y.id WHERE x.o > 0 AND y.i > 0")
def gravity_traffic(t: Tables) -> DataFrame:
    return X.gravity(net.directed(t)).select("s", "t", F.round("share", 8).alias("share"))


@query(NET + ROUTES + TOT + "SELECT route_id, s, t FROM vol JOIN tot x ON x.id = s JOIN tot y ON y.id = t WHERE s <> t AND x.o > 0 AND y.i > 0")
def active_routes(t: Tables) -> DataFrame:
    return X.active_routes(loaded_routes(t)[3].select("route_id", "route"), net.directed(t))


@query(NET + TOT + "SELECT x.id AS s, y.id AS t, round((CAST(0.25 AS DOUBLE)*x.o*y.i + CAST(0.75 AS DOUBLE)*y.o*x.i)/(SELECT sum(i) FROM tot), 6) AS volume FROM tot x JOIN tot y ON x.id <> y.id")
def stable_fp(t: Tables) -> DataFrame:
    n = E.node_totals(net.directed(t)).select("id", F.col("total_out").cast("double").alias("activity"), F.col("total_in").cast("double").alias("preference"))
    return X.stable_fp(n).select("s", "t", r6(F.col("volume")).alias("volume"))


@query(NET + ROUTES + "SELECT step, route_id, round(CASE WHEN route_id = 1 THEN CAST(volume AS DOUBLE)*step/20 ELSE CAST(volume AS DOUBLE) END, 6) AS volume FROM vol, (SELECT unnest(range(1, 21)) AS step)")
def volume_sweep(t: Tables) -> DataFrame:
    return X.volume_sweep(loaded_routes(t)[3], 1).select("step", "route_id", r6(F.col("volume")).alias("volume"))


@query(NET + ROUTES + "SELECT name, volume, CAST(k AS INTEGER) AS rank, CAST((k-1) % 10 AS INTEGER) AS colour FROM (SELECT name, volume, row_number() OVER (ORDER BY volume DESC, name DESC) AS k FROM (SELECT volume, array_to_string(list_transform(route, lambda x: lpad(CAST(x AS VARCHAR), 6, '0')), '-') AS name FROM vol WHERE s <> t)) WHERE k <= 100")
def top_routes(t: Tables) -> DataFrame:
    return X.top_routes(loaded_routes(t)[3])


@query(
    NET
    + ROUTES
    + """, place AS (SELECT route_id, volume, pos, route[pos] AS node FROM (SELECT *, unnest(range(1, len(route)+1)) AS pos FROM vol WHERE volume <> 0)),
pre AS (SELECT p.route_id, p.volume, p.pos, p.node, coalesce(sum(j.w) OVER (PARTITION BY p.route_id ORDER BY p.pos), 0) AS prefix FROM place p LEFT JOIN place q ON q.route_id = p.route_id AND q.pos = p.pos - 1 LEFT JOIN adj j ON j.u = q.node AND j.v = p.node),
pair AS (SELECT DISTINCT u, v FROM adj),
lft AS (SELECT a.u, a.v, pre.*, CASE WHEN node = a.u THEN 'u' ELSE 'p' END AS k FROM pair a JOIN pre ON node = a.u OR (node <> a.v AND EXISTS (SELECT 1 FROM pair b WHERE b.u = node AND b.v = a.u))),
rgt AS (SELECT a.u, a.v, pre.*, CASE WHEN node = a.v THEN 'v' ELSE 's' END AS k FROM pair a JOIN pre ON node = a.v OR (node <> a.u AND EXISTS (SELECT 1 FROM pair b WHERE b.u = a.v AND b.v = node))),
opt AS (SELECT l.u, l.v, l.route_id, l.volume, CASE l.k || r.k WHEN 'ps' THEN 0 WHEN 'pv' THEN 1 WHEN 'us' THEN 2 ELSE 3 END AS rank, min(r.prefix - l.prefix) AS gap FROM lft l JOIN rgt r ON l.u = r.u AND l.v = r.v AND l.route_id = r.route_id AND l.pos <= r.pos GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u, v, route_id ORDER BY rank) AS k FROM opt) WHERE k = 1)
SELECT u, v, round(1 - (sum(CAST(volume*(gap + CASE rank WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END * d) AS DOUBLE))/sum(volume))/d, 6) AS curvature FROM best JOIN dist ON s = u AND t = v GROUP BY u, v, d"""
)
def flow_curvature(t: Tables) -> DataFrame:
    _, adjacent, distances, paths = loaded_routes(t)
    return P.traffic_curvature(adjacent.select("u", "v"), adjacent, distances, paths).select("u", "v", r6(F.col("curvature")).alias("curvature"))


@query()
def transport_curvature(t: Tables) -> DataFrame:
    """Curvature of the traffic by the least cost of moving it, whatever its routes."""
    _, adjacent, distances, paths = loaded_routes(t)
    return W.transport_curvature(adjacent.select("u", "v"), adjacent, distances, paths).select("u", "v", r6(F.col("curvature")).alias("curvature"))


@query(NET + "SELECT a, b, round(avg(curvature), 6) AS curvature FROM (SELECT least(source, target) AS a, greatest(source, target) AS b, CAST((source*7 + target*3) % 11 AS DOUBLE)/10 AS curvature FROM dedges) GROUP BY 1, 2")
def merged_curvature(t: Tables) -> DataFrame:
    rows = net.directed(t).withColumn("curvature", ((F.col("source") * 7 + F.col("target") * 3) % 11).cast("double") / 10)
    return E.merge_curvatures(rows).select("a", "b", r6(F.col("curvature")).alias("curvature"))
