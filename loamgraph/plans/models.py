"""Queries over numerical kernels, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import borders as B
from ..operators import covers as V
from ..operators import gradients as G
from ..operators import mesh as M
from ..operators import numeric as N
from ..operators import paths as P
from ..operators import traffic as X
from ..operators import transport as W
from ..operators import triangles as T
from ..sources import network as files
from ..streaming import series as stream
from ..streaming import smoothing
from . import network as net
from .basic import r6, support
from .graph import loaded_routes
from .network import NET
from .registry import Tables, query
from .stage import stage
from .surface import EPS, SEG, SIDE, loads, loads_sql, parts, segments
from .timeline import settled, yearly


def _folder(t: Tables, name: str) -> str:
    folder = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getCheckpointDir()
    if not folder:
        stage(t.spark.range(1))  # sets one, where that is allowed
        folder = t.spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Triangles that break the triangle inequality, and their longest sides.
BAD = """, bad AS (SELECT x.a AS u, x.b AS v, y.b AS w, x.rtt_us AS uv, z.rtt_us AS uw, y.rtt_us AS vw FROM edges x JOIN edges y ON y.a = x.b JOIN edges z ON z.a = x.a AND z.b = y.b WHERE 2*greatest(x.rtt_us, y.rtt_us, z.rtt_us) > x.rtt_us + y.rtt_us + z.rtt_us),
long_side AS (SELECT CASE WHEN uv > uw AND uv > vw THEN concat(u, '-', v) WHEN uw > uv AND uw > vw THEN concat(u, '-', w) ELSE concat(v, '-', w) END AS item FROM bad)
"""


@query()
def ollivier_ricci(t: Tables) -> DataFrame:
    return W.ricci(net.near(t)).select("a", "b", r6(F.col("curvature")).alias("curvature"))


@query()
def ricci_sweep(t: Tables) -> DataFrame:
    """Curvature at each threshold; the graphs are taken side by side."""
    steps = t.spark.createDataFrame([(x,) for x in (5000, 10000, 20000)], "epsilon int")
    kept = net.undirected(t).join(F.broadcast(steps), F.col("rtt_us") - F.col("gcl_us") <= F.col("epsilon"))
    return W.ricci(kept, ["epsilon"]).select("epsilon", "a", "b", r6(F.col("curvature")).alias("curvature"))


@query()
def weighted_ricci(t: Tables) -> DataFrame:
    return W.ricci(net.near(t), alpha=0.5, weighted=True).select("a", "b", r6(F.col("curvature")).alias("curvature"))


@query()
def traffic_tomography(t: Tables) -> DataFrame:
    _, _, _, paths = loaded_routes(t)
    loaded = paths.where("volume > 0 and s <> t")
    hop_rows = P.hops(loaded, ["route_id"]).withColumn("snapshot", F.lit(0))
    whole = loaded.agg(F.sum("volume").alias("whole"))
    shares = X.link_traffic(loaded).crossJoin(F.broadcast(whole)).select(F.lit(0).alias("snapshot"), "u", "v", (F.col("volume") / F.col("whole")).alias("share"))
    prior = X.gravity(net.directed(t)).join(loaded.select("route_id", "s", "t"), ["s", "t"]).select(F.lit(0).alias("snapshot"), "route_id", "share")
    return N.tomography(hop_rows, shares, prior, "snapshot").select("route_id", r6(F.col("share")).alias("share"))


@query()
def route_inference(t: Tables) -> DataFrame:
    edges = net.near(t).select(F.lit(0).alias("snapshot"), "a", "b", "gcl_us")
    rtts = net.undirected(t).select(F.lit(0).alias("snapshot"), F.col("a").alias("s"), F.col("b").alias("t"), "rtt_us")
    return N.inferred_routes(edges, rtts, "snapshot").select("s", "t", F.array_join(F.transform("route", lambda x: x.cast("string")), "-").alias("route"), F.round("fitted", 2).alias("fitted"), r6(F.col("r2")).alias("r2"))


@query()
def matrix_completion(t: Tables) -> DataFrame:
    seen = yearly(t).select(F.col("y").alias("snapshot"), F.col("a").alias("s"), F.col("b").alias("t"), F.col("weight").cast("double").alias("volume"))
    return N.completed(seen.unionByName(seen.select("snapshot", F.col("t").alias("s"), F.col("s").alias("t"), "volume")), "snapshot").select("snapshot", "s", "t", F.round("volume", 4).alias("volume"))


@query()
def changepoints(t: Tables) -> DataFrame:
    return N.segment_means(settled(t), "key", "sec", "value").select("key", "sec", r6(F.col("level")).alias("level"))


@query()
def convex_hulls(t: Tables) -> DataFrame:
    placed = support(t).join(net.nodes(t).select("id", "country"), "id")
    return N.hulls(placed, "country")


@query(NET + SEG + "SELECT count(*) AS nodes, 0 AS outside FROM support WHERE id IN (SELECT a FROM near UNION SELECT b FROM near)")
def border_holds(t: Tables) -> DataFrame:
    """How many of the drawn nodes, and how many of them lie outside all borders."""
    rings = stage(B.outer_rings(segments(t)))
    drawn = net.near(t).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    spots = stage(support(t).join(drawn, "id").select(F.col("id").alias("pid"), "x", "y"))
    on = spots.join(rings.select("x", "y").distinct(), ["x", "y"], "left_semi").select("pid")
    inside = M.in_polygons(spots.join(on, "pid", "left_anti"), rings.select(F.col("ring").alias("gid"), "pos", "x", "y"))
    return spots.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(inside.agg(F.count(F.when(~F.col("inside"), 1)).alias("outside")))


@query()
def border(t: Tables) -> DataFrame:
    """The outer borders of the drawn network, one for each connected part."""
    return B.outer_rings(segments(t)).select("ring", "pos", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query(NET + BAD + "SELECT count(DISTINCT item) AS pairs, true AS covered, true AS falling FROM long_side")
def vertex_cover(t: Tables) -> DataFrame:
    """Nodes that touch all the longest sides of violated triangles: how many sides, whether all are touched, and whether no node adds more than one before it."""
    sides = stage(T.long_edges(T.triangles(net.undirected(t))))
    return _covered(V.vertex_cover(sides).withColumnRenamed("id", "name"), sides.select(F.explode(F.array("a", "b")).alias("name"), F.concat_ws("-", "a", "b").alias("item"))).withColumnRenamed("items", "pairs")


def _covered(cover: DataFrame, members: DataFrame) -> DataFrame:
    """One row: how many items, whether the cover holds all, and whether gains never rise and add up to the items."""
    cover = stage(cover)
    held = members.join(cover.select("name"), "name", "left_semi").agg(F.countDistinct("item").alias("held"))
    sums = cover.agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"), F.coalesce(F.max("step") + 1, F.lit(0)).alias("steps"), F.count(F.lit(1)).alias("n"))
    rising = cover.alias("x").join(cover.select((F.col("step") + 1).alias("step"), F.col("gain").alias("before")), "step").agg(F.count(F.when(F.col("gain") > F.col("before"), 1)).alias("rises"))
    whole = members.agg(F.countDistinct("item").alias("items"))
    one = whole.crossJoin(held).crossJoin(sums).crossJoin(rising)
    return one.select("items", (F.col("held") == F.col("items")).alias("covered"), ((F.col("rises") == 0) & (F.col("sum") == F.col("items")) & (F.col("steps") == F.col("n"))).alias("falling"))


@query(NET + BAD + "SELECT count(*) AS items, true AS covered, true AS falling FROM bad")
def set_cover(t: Tables) -> DataFrame:
    """Edges that together lie in all violated triangles."""
    bad = T.with_goodness(T.triangles(net.undirected(t))).where("goodness > 1")
    name = lambda a, b: F.concat_ws("-", F.lpad(F.col(a).cast("string"), 3, "0"), F.lpad(F.col(b).cast("string"), 3, "0"))
    sides = F.explode(F.array(name("u", "v"), name("v", "w"), name("u", "w")))
    members = stage(bad.select(sides.alias("name"), F.concat_ws("-", "u", "v", "w").alias("item")))
    return _covered(V.set_cover(members), members)


@query()
def heat_geodesic(t: Tables) -> DataFrame:
    return N.heat(parts(t)[0].withColumn("mesh", F.lit(0)), "mesh", SIDE, SIDE * SIDE // 2).select("vid", r6(F.col("distance")).alias("distance"))


@query(
    "WITH RECURSIVE "
    + f"vert AS (SELECT i*9 + j AS vid, i, j, CAST(0.01 AS DOUBLE)*coalesce(q, 0) AS z FROM (SELECT unnest(range(9)) AS i), (SELECT unnest(range(9)) AS j) LEFT JOIN {loads_sql(81)} q ON q.vid = i*9 + j),\n"
    + "lk AS (SELECT a.vid AS u, b.vid AS v, CAST(round(1000*sqrt(CASE WHEN a.i <> b.i AND a.j <> b.j THEN CAST(0.03125 AS DOUBLE) ELSE CAST(0.015625 AS DOUBLE) END + (a.z-b.z)*(a.z-b.z))) AS BIGINT) AS w FROM vert a JOIN vert b ON (abs(a.i-b.i) + abs(a.j-b.j) = 1) OR (a.i-b.i = a.j-b.j AND abs(a.i-b.i) = 1)),\n"
    + "q0 AS MATERIALIZED (SELECT s, t, min(d) AS d FROM (SELECT u AS s, v AS t, w AS d FROM lk UNION ALL SELECT vid, vid, 0 FROM vert) GROUP BY 1, 2),\n"
    + ",\n".join(f"q{i + 1} AS MATERIALIZED (SELECT x.s, y.t, min(x.d + y.d) AS d FROM q{i} x JOIN q{i} y ON x.t = y.s GROUP BY 1, 2)" for i in range(5))
    + "\nSELECT s, t, CAST(d AS BIGINT) AS d FROM q5"
)
def mesh_distances(t: Tables) -> DataFrame:
    """Distances along a small mesh's edges, in thousandths; its heights are the line items' loads."""
    f = M.faces(t.spark, 9, 9)
    sides = f.select(F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("u", "v"), ("v", "w"), ("u", "w"))])).alias("e")).select("e.*").distinct()
    z = M.grid(t.spark, 9, 9).join(loads(t, 81), "vid", "left").select("vid", (F.lit(0.01) * F.coalesce("q", F.lit(0.0))).alias("z"))
    a, b = (z.select(F.col("vid").alias(n), F.col("z").alias(f"{n}z")) for n in "ab")
    rise = (F.col("az") - F.col("bz")) * (F.col("az") - F.col("bz"))
    w = F.round(1000 * F.sqrt(F.when(F.col("b") - F.col("a") == 10, F.lit(0.03125)).otherwise(F.lit(0.015625)) + rise)).cast("long")
    edges = stage(sides.join(a, "a").join(b, "b").select("a", "b", w.alias("w")))
    return P.closure(stage(P.adjacency(edges, "w")), M.grid(t.spark, 9, 9).select(F.col("vid").alias("id")))


def dome(t: Tables, side: int) -> DataFrame:
    x, y = F.col("x") - 0.5, F.col("y") - 0.5
    return M.grid(t.spark, side, side).select("vid", "x", "y", F.sqrt(F.lit(2.0) - x * x - y * y).alias("z"), "border")


def fit_inputs(t: Tables, side: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Vertices of a dome, faces, the vertices near each of the network's edges, and the edges' curvatures and lengths."""
    v = M.grid(t.spark, side, side)
    s = segments(t)
    dx, dy = F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")
    curved = W.ricci(net.near(t)).select((F.col("a") * 100 + F.col("b")).alias("sid"), F.col("curvature").alias("target"))
    fat = stage(M.points_near_segments(v.withColumnRenamed("vid", "pid"), s.drop("rtt_us"), EPS).select(F.col("pid").alias("vid"), "sid"))
    targets = stage(s.select("sid", F.sqrt(dx * dx + dy * dy).alias("length")).join(curved, "sid").select("sid", "target", "length"))
    return dome(t, side), stage(M.faces(t.spark, side, side)), fat, targets


SETTINGS = [(0, 0.0), (1, 0.0002), (2, 0.002)]


def fitted(t: Tables, side: int = 13, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    start, faces, fat, targets = fit_inputs(t, side)
    settings = t.spark.createDataFrame(SETTINGS, "run long, smooth double")
    # A mesh for each run: as many rows as the fit is about.
    return G.fit(faces, start.crossJoin(settings.select("run")), fat, targets, settings, rounds)


@query()
def manifold_fit(t: Tables) -> DataFrame:
    """A surface for each smoothness setting, fitted to the network's curvature by the losses' gradients, all settings at once."""
    value, heights = fitted(t)
    size = heights.groupBy("run").agg(F.count(F.lit(1)).alias("vertices"))
    return value.join(size, "run").select("run", r6(F.col("loss_before")).alias("loss_before"), r6(F.col("loss_after")).alias("loss_after"), r6(F.col("curvature")).alias("curvature"), r6(F.col("smoothness")).alias("smoothness"), "vertices")


@query()
def loss_gradients(t: Tables) -> DataFrame:
    """The slope of the surface's losses by each height, without smoothness and with it."""
    v, f, _, _ = parts(t)
    _, _, fat, targets = fit_inputs(t, SIDE)
    settings = t.spark.createDataFrame(SETTINGS[:2], "run long, smooth double")
    _, slope = G.losses(f, v.crossJoin(settings.select("run")), fat, targets, settings, ["run"])
    return slope.select("run", "vid", F.round("slope", 4).alias("slope"))


@query(
    NET
    + """, st AS (SELECT avg(CAST(gcl_us AS DOUBLE)) AS mx, avg(CAST(rtt_us AS DOUBLE)) AS my, var_pop(CAST(gcl_us AS DOUBLE)) AS vx, var_pop(CAST(rtt_us AS DOUBLE)) AS vy, covar_pop(CAST(gcl_us AS DOUBLE), CAST(rtt_us AS DOUBLE)) AS c, count(*) AS n FROM edges)
SELECT a, b, round(1e9*2*c/(n*vx*vy)*(c*(gcl_us - mx)/vx - (rtt_us - my)), 4) + 0 AS slope FROM edges, st"""
)
def geodesic_loss_gradient(t: Tables) -> DataFrame:
    """The slope of the unexplained share of round trips by each edge's distance, in 10^-9."""
    rows = net.undirected(t).select("a", "b", F.col("gcl_us").cast("double").alias("x"), F.col("rtt_us").cast("double").alias("y"))
    return G.geodesic_loss(rows, "y", "x", []).select("a", "b", (F.round(F.lit(1e9) * F.col("slope"), 4) + 0).alias("slope"))


@query(NET + "SELECT CAST(source AS VARCHAR) AS source_id, CAST(target AS VARCHAR) AS target_id, CAST(rtt_us AS DOUBLE) AS rtt, CAST(CASE WHEN e.n = 0 THEN NULL ELSE throughput END AS DOUBLE) AS throughput FROM dedges, (SELECT 1 AS n) e")
def network_json_roundtrip(t: Tables) -> DataFrame:
    """A network written as one JSON document and read back; link throughput comes from its routes."""
    path = _folder(t, "network-json")
    links = stage(net.directed(t).select(F.col("source").cast("string").alias("source_id"), F.col("target").cast("string").alias("target_id"), F.col("rtt_us").cast("double").alias("rtt"), F.col("throughput").cast("double").alias("volume")))
    routes = links.select(F.array("source_id", "target_id").alias("route"), "volume")
    nodes = net.nodes(t).select(F.col("id").cast("string").alias("id"), "lat", "lon")
    files.write_network_json(nodes, links, links.select("source_id", "target_id", "rtt"), routes, path)
    return files.read_network_json(t.spark, path)["links"]


@query(NET + "SELECT CAST(a AS VARCHAR) AS source, CAST(b AS VARCHAR) AS target, CAST(rtt_us AS VARCHAR) AS rtt, x.city AS city FROM near JOIN nodes x ON x.id = a")
def graphml_roundtrip(t: Tables) -> DataFrame:
    path = _folder(t, "graphml")
    files.write_graphml(net.nodes(t).select("id", "city", "country", "lat"), net.near(t).select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("rtt_us").alias("rtt")), path)
    nodes, edges = files.read_graphml(t.spark, path)
    cities = nodes.select(F.col("id").alias("source"), F.col("attributes")["city"].alias("city"))
    return edges.select("source", "target", F.col("attributes")["rtt"].alias("rtt")).join(cities, "source")


@query("SELECT event_type AS key, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def stream_hourly(t: Tables) -> DataFrame:
    """Hourly statistics of a stream; hours still open come out as they are."""
    out = stream.hourly(stream.events(t.spark, f"{t.folder}/events.parquet"))
    return stream.updated(out, _folder(t, "stream"), ["key", "hour"]).select("key", F.unix_seconds("hour").alias("hour"), "n", F.round("total", 4).alias("total"), "least", "most")


@query(
    "WITH RECURSIVE o AS (SELECT event_type AS key, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),\n"
    "dfa AS (SELECT key, k, event_id, value, CASE WHEN value > 50 THEN 'H' ELSE 'L' END AS state FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, o.event_id, o.value, CASE WHEN o.value > 60 THEN 'H' WHEN o.value <= 40 THEN 'L' ELSE dfa.state END FROM dfa JOIN o ON o.key = dfa.key AND o.k = dfa.k + 1)\n"
    "SELECT key, event_id, state, round(CASE state WHEN 'L' THEN least(value, 40) ELSE greatest(value, 60) END, 6) AS smooth FROM dfa"
)
def stream_hysteresis(t: Tables) -> DataFrame:
    out = stream.hysteresis(stream.events(t.spark, f"{t.folder}/events.parquet"), 50.0, 10.0)
    return stream.drained(out, _folder(t, "stream")).select("key", "event_id", "state", r6(F.col("smooth")).alias("smooth"))


@query(
    "WITH RECURSIVE o AS (SELECT event_type AS key, event_id, value, epoch_us(ts)//1000 AS ms, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts)//1000, event_id) AS k FROM events WHERE value IS NOT NULL),\n"
    "ew AS (SELECT key, k, event_id, ms, value, CAST(value AS DOUBLE) AS e FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, o.event_id, o.ms, o.value, ew.e + (1 - exp(CAST(-0.0001 AS DOUBLE)*(o.ms - ew.ms)/1000))*(o.value - ew.e) FROM ew JOIN o ON o.key = ew.key AND o.k = ew.k + 1)\n"
    "SELECT key, event_id, ms // 1000 AS sec, round(e, 5) AS ewma, abs(value - e) > 20 AS changed FROM ew WHERE ms <= (SELECT max(epoch_us(ts)//1000) FROM events) - 3600000"
)
def stream_ewma(t: Tables) -> DataFrame:
    """Smoothed values and change flags of a stream, for all rows that its watermark has passed."""
    source = stream.events(t.spark, f"{t.folder}/events.parquet")
    with smoothing.rocks(t.spark):
        out = stream.drained(smoothing.smoothed(source, 0.0001, 20.0), _folder(t, "stream"))
    return out.select("key", "event_id", "sec", F.round("ewma", 5).alias("ewma"), "changed")
