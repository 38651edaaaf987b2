"""Queries over route traces, the composed graph, mesh holes, record files and the remaining geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import mesh as M
from ..operators import network as G
from ..operators import traces as R
from ..sources import network as files
from . import network as net
from .basic import TRI, r6
from .graph import LINK, TAU
from .models import _folder
from .network import NET
from .registry import Tables, query
from .stage import stage

ADDRESS = "concat_ws('.', 10 + {k} % 3, ({k} * 7919) % 4, ({k} * 104729) % 8, {k} % 250)".format
PREFIX = "CASE ({k} * 31) % 3 WHEN 0 THEN concat(10 + {k} % 3, '.0.0.0/8') WHEN 1 THEN concat(10 + {k} % 3, '.', ({k} * 7919) % 4, '.0.0/16') ELSE concat(10 + ({k} * 5) % 3, '.', ({k} * 7919) % 4, '.', ({k} * 104729) % 8, '.0/24') END".format


@query(
    f"WITH hop AS (SELECT c_custkey AS hop, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE {ADDRESS(k='c_custkey')} END AS address FROM customer),\n"
    f"member AS (SELECT address, max(k) AS asn, concat('ix', max(k) % 5) AS exchange FROM (SELECT {ADDRESS(k='(o_orderkey * 17)')} AS address, o_orderkey AS k FROM orders) GROUP BY 1),\n"
    f"prefix AS (SELECT prefix, max(s_suppkey) AS owner FROM (SELECT {PREFIX(k='s_suppkey')} AS prefix, s_suppkey FROM supplier) GROUP BY 1),\n"
    "place AS (SELECT address, min(city) AS city FROM (SELECT address, concat('c', hop % 7) AS city FROM hop WHERE hop % 2 = 0) GROUP BY 1),\n"
    "owned AS (SELECT hop, address, (SELECT p.owner FROM prefix p WHERE starts_with(h.address, CASE split_part(p.prefix, '/', 2) WHEN '8' THEN concat(split_part(p.prefix, '.', 1), '.') WHEN '16' THEN concat(split_part(p.prefix, '.', 1), '.', split_part(p.prefix, '.', 2), '.') ELSE concat(split_part(p.prefix, '.', 1), '.', split_part(p.prefix, '.', 2), '.', split_part(p.prefix, '.', 3), '.') END) ORDER BY CAST(split_part(p.prefix, '/', 2) AS INTEGER) DESC, owner DESC LIMIT 1) AS owner FROM hop h),\n"
    "located AS (SELECT hop, o.address, CASE WHEN m.address IS NOT NULL THEN m.asn ELSE owner END AS asn, coalesce(exchange, city) AS place FROM owned o LEFT JOIN member m ON m.address = o.address LEFT JOIN place p ON p.address = o.address)\n"
    "SELECT hop, address, CAST(asn AS BIGINT) AS asn, CASE WHEN asn % 4 = 0 THEN concat('org', asn) ELSE CAST(asn AS VARCHAR) END AS organisation, place FROM located"
)
def trace_owners(t: Tables) -> DataFrame:
    """Hops with their owners: exchange tables before prefixes."""
    hops = t.customer.select(F.col("c_custkey").alias("hop"), F.expr(f"CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE {ADDRESS(k='c_custkey')} END").alias("address"))
    members = t.orders.groupBy(F.expr(ADDRESS(k="(o_orderkey * 17)")).alias("address")).agg(F.max("o_orderkey").alias("asn")).withColumn("exchange", F.concat(F.lit("ix"), (F.col("asn") % 5).cast("string")))
    prefixes = t.supplier.groupBy(F.expr(PREFIX(k="s_suppkey")).alias("prefix")).agg(F.max("s_suppkey").alias("asn"))
    places = hops.where("hop % 2 = 0 and address is not null").groupBy("address").agg(F.min(F.concat(F.lit("c"), (F.col("hop") % 7).cast("string"))).alias("city"))
    names = t.orders.select(F.col("o_orderkey").alias("asn")).union(t.supplier.select("s_suppkey")).distinct().where("asn % 4 = 0").withColumn("organisation", F.concat(F.lit("org"), F.col("asn").cast("string")))
    return R.located_hops(hops, members, prefixes, places, names).select("hop", "address", F.col("asn").cast("long").alias("asn"), "organisation", "place")


@query("WITH r AS (SELECT c_custkey, concat('k', (c_custkey * 7919) % 97) AS code, concat(CASE WHEN c_custkey % 2 = 0 THEN 'City' ELSE 'CITY' END, (c_custkey * 104729) % 89) AS city FROM customer) SELECT c_custkey, code, city FROM r WHERE c_custkey = (SELECT min(c_custkey) FROM r x WHERE x.code = r.code) AND c_custkey = (SELECT min(c_custkey) FROM r x WHERE lower(x.city) = lower(r.city))")
def first_of_places(t: Tables) -> DataFrame:
    """The first row of each place in order of arrival, by either of two keys."""
    rows = t.customer.select("c_custkey", F.expr("concat('k', (c_custkey * 7919) % 97)").alias("code"), F.expr("concat(CASE WHEN c_custkey % 2 = 0 THEN 'City' ELSE 'CITY' END, (c_custkey * 104729) % 89)").alias("city"))
    return R.first_of_places(rows, "c_custkey", "code", "city")


@query(NET + TRI + LINK + f", kept AS (SELECT * FROM edges e WHERE NOT EXISTS (SELECT 1 FROM long_edges l WHERE l.a = e.a AND l.b = e.b) AND rtt_us - gcl_us <= {net.NEAR_US}) SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, min(rtt_us) AS rtt_us, CAST(sum(throughput) AS BIGINT) AS throughput, min(gcl_us) AS gcl_us FROM kept e JOIN mapping x ON x.id = e.a JOIN mapping y ON y.id = e.b WHERE x.rep <> y.rep GROUP BY 1, 2")
def measured_graph(t: Tables) -> DataFrame:
    """Links without violations, thresholded and clustered, in one call."""
    return G.measured_graph(net.nodes(t), net.directed(t), remove_violations=True, epsilon_us=net.NEAR_US, cluster_radians=TAU, curvature=False)[0]


@query()
def measured_curvature(t: Tables) -> DataFrame:
    """The same graph's curvature, by neighbours."""
    edges, _ = G.measured_graph(net.nodes(t), net.directed(t), remove_violations=True, epsilon_us=net.NEAR_US, cluster_radians=TAU)
    return edges.select("a", "b", r6(F.col("curvature")).alias("curvature"))


@query(
    "WITH RECURSIVE face AS (SELECT 2*(i*8 + j) + k AS fid, CASE k WHEN 0 THEN [i*9 + j, i*9 + j + 10, i*9 + j + 1] ELSE [i*9 + j, i*9 + j + 9, i*9 + j + 10] END AS corners FROM (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j), (SELECT unnest(range(2)) AS k)),\n"
    "corner AS (SELECT fid, unnest(corners) AS vid FROM face), open AS (SELECT DISTINCT fid FROM corner WHERE vid // 9 <> 4 AND vid % 9 <> 4),\n"
    "next AS (SELECT x.fid AS f, y.fid AS g FROM corner x JOIN corner y ON x.vid = y.vid AND x.fid <> y.fid WHERE x.fid IN (SELECT fid FROM open) AND y.fid IN (SELECT fid FROM open) GROUP BY 1, 2 HAVING count(*) = 2),\n"
    "reach AS (SELECT fid AS f, fid AS g FROM open UNION SELECT r.f, n.g FROM reach r JOIN next n ON n.f = r.g),\n"
    "hole AS (SELECT f AS fid, min(g) AS hole FROM reach GROUP BY 1)\n"
    "SELECT DISTINCT CAST(hole AS BIGINT) AS hole, CAST(vid AS BIGINT) AS vid, vid // 9 IN (0, 8) OR vid % 9 IN (0, 8) AS on_border FROM hole JOIN corner USING (fid)"
)
def mesh_holes(t: Tables) -> DataFrame:
    """What is left of a mesh beside a cross of kept vertices."""
    v = M.grid(t.spark, 9, 9)
    return M.holes(M.faces(t.spark, 9, 9), v, v.where("i = 4 or j = 4").select("vid")).select("hole", "vid", "on_border")


@query("SELECT u AS source, v AS destination, CAST(w AS DOUBLE) / 8 AS geodesic_distance FROM (SELECT n_nationkey AS u, (n_nationkey * 7) % 25 AS v, n_nationkey * 3 + 1 AS w FROM nation)")
def distance_files(t: Tables) -> DataFrame:
    """Distances written as a CSV of pairs and read back."""
    path = _folder(t, "distances")
    rows = t.nation.select(F.col("n_nationkey").alias("source"), ((F.col("n_nationkey") * 7) % 25).alias("destination"), ((F.col("n_nationkey") * 3 + 1).cast("double") / 8).alias("geodesic_distance"))
    files.write_distances(rows, path)
    return t.spark.read.csv(path, header=True, schema="source int, destination long, geodesic_distance double").select(F.col("source").cast("long").alias("source"), "destination", "geodesic_distance")


@query("SELECT run, 49 AS vertices, true AS same, true AS falls FROM (SELECT unnest([0, 1, 2]) AS run)")
def fit_records(t: Tables) -> DataFrame:
    """One JSON record for each fitted surface, written and read back: whether all heights are as fitted, and the loss no greater than before."""
    from .models import SETTINGS, dome, fitted

    path = _folder(t, "fits")
    side = 7
    value, heights = fitted(t, side, 1)
    before = dome(t, side).select("vid", F.col("z").alias("initial"))
    rows = stage(heights.select("run", "vid", F.col("z").alias("final")).join(before, "vid"))
    # One record holds one surface: its consumer's form.
    listed = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("vid", "initial", "final"))).alias("h"))
    settings = t.spark.createDataFrame(SETTINGS, "run long, smooth double")
    files.write_fits(listed.join(settings, "run").select("run", F.struct("smooth").alias("parameters"), F.col("h.initial").alias("initial"), F.col("h.final").alias("final")), path)
    back = files.read_fits(t.spark, path, "smooth double").join(settings.withColumnRenamed("smooth", "given"), "run").where("parameters.smooth = given")
    flat = back.select("run", F.posexplode(F.arrays_zip("initial", "final")).alias("vid", "h"))
    same = flat.join(rows, ["run", "vid"]).groupBy("run").agg(F.count(F.lit(1)).alias("vertices"), F.min((F.col("h.initial") == F.col("initial")) & (F.col("h.final") == F.col("final"))).alias("same"))
    return same.join(value, "run").select("run", "vertices", "same", (F.col("loss_after") <= F.col("loss_before")).alias("falls"))


@query(NET + """, p AS (SELECT id, lon/360 AS px, lat/180 AS py, CAST((id*13)%7 AS DOUBLE)/10 - CAST(0.3 AS DOUBLE) AS h FROM nodes),
s AS (SELECT *, (px + CAST(0.2 AS DOUBLE))*CAST(0.5 AS DOUBLE) + (py + CAST(0.1 AS DOUBLE))*CAST(0.3 AS DOUBLE) AS dot FROM p),
c AS (SELECT *, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), dot/CAST(0.34 AS DOUBLE))) AS share FROM s)
SELECT id, round(CAST(-0.2 AS DOUBLE) + share*CAST(0.5 AS DOUBLE), 6) + 0 AS x, round(CAST(-0.1 AS DOUBLE) + share*CAST(0.3 AS DOUBLE), 6) + 0 AS y, round(2/(1 + exp(-h)), 6) AS height, round(2*exp(-h)/((1 + exp(-h))*(1 + exp(-h))), 6) AS slope, CAST(floor(256*least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (h + 1)/2)) + CAST(0.5 AS DOUBLE)) AS INTEGER) AS ramp, py < 0 AS clockwise FROM c""")
def point_functions(t: Tables) -> DataFrame:
    """Nearest points of a segment, bounded heights and their slopes, ramp places, turns."""
    lit = geo.lit
    x, y, h = F.col("lon") / 360, F.col("lat") / 180, ((F.col("id") * 13) % 7).cast("double") / 10 - lit(0.3)
    nx, ny = geo.project_to_segment(x, y, lit(-0.2), lit(-0.1), lit(0.3), lit(0.2))
    # Seen from the end of a step along x, a node below is more clockwise than the step straight up.
    turn = geo.right_of_turn(lit(1.0), lit(0.0), lit(0.0), lit(1.0), lit(0.0), F.when(y < 0, lit(-1.0)).otherwise(lit(1.0)))
    return net.nodes(t).select("id", (r6(nx) + 0).alias("x"), (r6(ny) + 0).alias("y"), r6(geo.bounded_height(h, 2.0)).alias("height"), r6(geo.bounded_height_slope(h, 2.0)).alias("slope"), geo.ramp_index(h).alias("ramp"), turn.alias("clockwise"))
