"""Queries over meshes, planar geometry and run configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import lit
from ..operators import collate as C
from ..operators import config as K
from ..operators import mesh as M
from . import network as net
from .basic import SUPPORT, r6, support
from .network import NET, PI
from .registry import Tables, query

SIDE = 21
EPS = 0.06


def loads(t: Tables, vertices: int) -> DataFrame:
    """vid, q: the mean quantity of the line items that fall to each vertex."""
    vid = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 31 + F.col("l_partkey")) % vertices
    return t.lineitem.groupBy(vid.cast("long").alias("vid")).agg((F.sum(F.col("l_quantity").cast("long")).cast("double") / F.count(F.lit(1))).alias("q"))


def loads_sql(vertices: int) -> str:
    return f"(SELECT (l_orderkey*7 + l_linenumber*31 + l_partkey) % {vertices} AS vid, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)/count(*) AS q FROM lineitem GROUP BY 1)"


def surface():
    return lit(0.3) * F.sin(lit(3) * F.col("x")) + lit(0.2) * F.cos(lit(4) * F.col("y")) + lit(0.0001) * F.coalesce("q", lit(0))


def parts(t: Tables):
    """Vertices, faces, faces with corners, half-edges of a surface with the line items' loads on it."""
    v = M.grid(t.spark, SIDE, SIDE).drop("z").join(loads(t, SIDE * SIDE), "vid", "left")
    v = v.select("vid", "i", "j", "x", "y", surface().alias("z"), "border")
    f = M.faces(t.spark, SIDE, SIDE)
    placed = M.placed_faces(f, v)
    return v, f, placed, M.halfedges(placed)


def segments(t: Tables) -> DataFrame:
    p = support(t)
    a, b = (p.select(F.col("id").alias(k), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for k, n in (("a", "u"), ("b", "v")))
    return net.near(t).join(a, "a").join(b, "b").select((F.col("a") * 100 + F.col("b")).alias("sid"), "ux", "uy", "vx", "vy", "rtt_us")


n1 = SIDE - 1
MESH = f"""vert AS (SELECT i*{SIDE} + j AS vid, i, j, i/CAST({n1} AS DOUBLE) AS x, j/CAST({n1} AS DOUBLE) AS y, CAST(0.3 AS DOUBLE)*sin(3*(i/CAST({n1} AS DOUBLE))) + CAST(0.2 AS DOUBLE)*cos(4*(j/CAST({n1} AS DOUBLE))) + CAST(0.0001 AS DOUBLE)*coalesce(q, 0) AS z, i = 0 OR j = 0 OR i = {n1} OR j = {n1} AS border FROM (SELECT unnest(range({SIDE})) AS i), (SELECT unnest(range({SIDE})) AS j) LEFT JOIN {loads_sql(SIDE*SIDE)} q ON q.vid = i*{SIDE} + j),
face AS (SELECT (i*{n1} + j)*2 AS fid, i*{SIDE} + j AS u, (i+1)*{SIDE} + j + 1 AS v, i*{SIDE} + j + 1 AS w FROM vert WHERE i < {n1} AND j < {n1} UNION ALL SELECT (i*{n1} + j)*2 + 1, i*{SIDE} + j, (i+1)*{SIDE} + j, (i+1)*{SIDE} + j + 1 FROM vert WHERE i < {n1} AND j < {n1}),
nrm AS (SELECT f.*, (a.y-c.y)*(b.z-c.z) - (a.z-c.z)*(b.y-c.y) AS nx, (a.z-c.z)*(b.x-c.x) - (a.x-c.x)*(b.z-c.z) AS ny, (a.x-c.x)*(b.y-c.y) - (a.y-c.y)*(b.x-c.x) AS nz FROM face f JOIN vert a ON a.vid = u JOIN vert b ON b.vid = v JOIN vert c ON c.vid = w),
tri AS (SELECT *, sqrt(nx*nx + ny*ny + nz*nz)/2 AS area FROM nrm),
half AS (SELECT h.*, ((o.x-p.x)*(d.x-p.x) + (o.y-p.y)*(d.y-p.y) + (o.z-p.z)*(d.z-p.z))/(2*area) AS cot, o.border AS ob, d.border AS db, p.border AS pb, o.x-d.x AS ex, o.y-d.y AS ey, o.z-d.z AS ez FROM (SELECT fid, area, nx, ny, nz, u AS oi, v AS di, w AS pi FROM tri UNION ALL SELECT fid, area, nx, ny, nz, v, w, u FROM tri UNION ALL SELECT fid, area, nx, ny, nz, w, u, v FROM tri) h JOIN vert o ON o.vid = oi JOIN vert d ON d.vid = di JOIN vert p ON p.vid = pi),
lap AS (SELECT least(oi, di) AS a, greatest(oi, di) AS b, NOT (ob OR db) AS inner_edge, sum(cot)/2 AS weight FROM half GROUP BY 1, 2, 3),
gauss AS (SELECT pi AS vid, sum(area)/3 AS area, CASE WHEN pb THEN 0 ELSE (2*{PI} - sum(acos(cot/sqrt(1 + cot*cot))))/(sum(area)/3) END AS kappa, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz, pb FROM half GROUP BY pi, pb),
mean0 AS (SELECT vid, sum(mx) AS mx, sum(my) AS my, sum(mz) AS mz FROM (SELECT oi AS vid, cot/2*ex AS mx, cot/2*ey AS my, cot/2*ez AS mz FROM half UNION ALL SELECT di, -cot/2*ex, -cot/2*ey, -cot/2*ez FROM half) GROUP BY 1),
curv AS (SELECT g.vid, kappa, CASE WHEN pb THEN 0 ELSE sqrt(mx*mx + my*my + mz*mz)/(2*area)*sign(mx*nx + my*ny + mz*nz) END AS mean FROM gauss g JOIN mean0 m ON m.vid = g.vid),
prin AS (SELECT *, mean + sqrt(greatest(0, mean*mean - kappa)) AS first, mean - sqrt(greatest(0, mean*mean - kappa)) AS second FROM curv)
"""
WITH_MESH = "WITH " + MESH
SEG = SUPPORT + """, seg AS (SELECT a*100 + b AS sid, p.x AS ux, p.y AS uy, q.x AS vx, q.y AS vy, rtt_us FROM near JOIN support p ON p.id = a JOIN support q ON q.id = b)
"""
DISTANCE = "(CASE WHEN (({x}-ux)*(ux-vx) + ({y}-uy)*(uy-vy)) <= 0 AND (({x}-vx)*(ux-vx) + ({y}-vy)*(uy-vy)) >= 0 THEN sqrt(greatest(0, ({x}-vx)*({x}-vx) + ({y}-vy)*({y}-vy) - (({x}-vx)*(ux-vx) + ({y}-vy)*(uy-vy))*(({x}-vx)*(ux-vx) + ({y}-vy)*(uy-vy))/((ux-vx)*(ux-vx) + (uy-vy)*(uy-vy)))) ELSE sqrt(least(({x}-ux)*({x}-ux) + ({y}-uy)*({y}-uy), ({x}-vx)*({x}-vx) + ({y}-vy)*({y}-vy))) END)".format(x="v.x", y="v.y")
FAT = f", fat AS (SELECT vid AS pid, sid, {DISTANCE} AS distance FROM vert v, seg WHERE {DISTANCE} < CAST({EPS} AS DOUBLE))\n"


@query(WITH_MESH + "SELECT vid, i, j, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, border FROM vert")
def grid_mesh(t: Tables) -> DataFrame:
    v = parts(t)[0]
    return v.select("vid", "i", "j", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), r6(F.col("z")).alias("z"), "border")


@query(WITH_MESH + "SELECT fid, u, v, w, round(area, 8) AS area FROM tri")
def face_areas(t: Tables) -> DataFrame:
    return parts(t)[2].select("fid", "u", "v", "w", F.round("area", 8).alias("area"))


@query(WITH_MESH + "SELECT a, b, inner_edge AS inner, round(weight, 6) + 0 AS weight FROM lap")
def cotan_laplacian(t: Tables) -> DataFrame:
    return M.edge_laplacian(parts(t)[3]).select("a", "b", "inner", (r6(F.col("weight")) + 0).alias("weight"))


@query(WITH_MESH + "SELECT vid, round(kappa, 5) + 0 AS kappa FROM gauss")
def gaussian_curvature(t: Tables) -> DataFrame:
    return M.gaussian_curvature(parts(t)[3]).select("vid", (F.round("kappa", 5) + 0).alias("kappa"))


@query(WITH_MESH + "SELECT vid, round(mean, 5) + 0 AS mean, round(first, 5) + 0 AS first, round(second, 5) + 0 AS second FROM prin")
def principal_curvature(t: Tables) -> DataFrame:
    return M.principal_curvatures(parts(t)[3]).select("vid", *[(F.round(c, 5) + 0).alias(c) for c in ("mean", "first", "second")])


@query(WITH_MESH + "SELECT round((SELECT sum(weight*((x.first-y.first)*(x.first-y.first) + (x.second-y.second)*(x.second-y.second))) FROM lap JOIN prin x ON x.vid = a JOIN prin y ON y.vid = b WHERE inner_edge)*(SELECT sum(area) FROM tri), 5) AS loss")
def smooth_loss(t: Tables) -> DataFrame:
    _, _, placed, half = parts(t)
    return M.smooth_loss(half, placed).select(F.round("loss", 5).alias("loss"))


@query(NET + SEG + ", " + MESH + FAT + "SELECT pid, sid, round(distance, 6) AS distance FROM fat")
def fat_edges(t: Tables) -> DataFrame:
    v = parts(t)[0].withColumnRenamed("vid", "pid")
    return M.points_near_segments(v, segments(t).drop("rtt_us"), EPS).select("pid", "sid", r6(F.col("distance")).alias("distance"))


@query(NET + SEG + ", " + MESH + FAT + ", miss AS (SELECT f.sid, avg((kappa - target)*(kappa - target)) AS miss FROM fat f JOIN gauss g ON g.vid = f.pid JOIN (SELECT sid, CAST(sid % 7 AS DOUBLE)/7 - 0.5 AS target FROM seg WHERE sid % 7 <> 3) s ON s.sid = f.sid GROUP BY 1), len AS (SELECT sid, sqrt((ux-vx)*(ux-vx) + (uy-vy)*(uy-vy)) AS length FROM seg) SELECT round(sum(miss*length)/(SELECT sum(length) FROM len), 6) AS loss FROM miss JOIN len USING (sid)")
def curvature_loss(t: Tables) -> DataFrame:
    v, _, _, half = parts(t)
    s = segments(t)
    fat = M.points_near_segments(v.withColumnRenamed("vid", "pid"), s.drop("rtt_us"), EPS)
    dx, dy = F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy")
    targets = s.select("sid", F.when(F.col("sid") % 7 != 3, (F.col("sid") % 7).cast("double") / 7 - lit(0.5)).alias("target"), F.sqrt(dx * dx + dy * dy).alias("length"))
    return M.curvature_loss(fat, M.gaussian_curvature(half), targets).select(r6(F.col("loss")).alias("loss"))


@query(NET + SUPPORT + ", " + MESH + "SELECT pid, vid FROM (SELECT s.id AS pid, vid, row_number() OVER (PARTITION BY s.id ORDER BY (s.x-v.x)*(s.x-v.x) + (s.y-v.y)*(s.y-v.y), vid) AS k FROM support s, vert v) WHERE k = 1")
def nearest_vertex(t: Tables) -> DataFrame:
    return M.nearest_grid_vertex(support(t).withColumnRenamed("id", "pid"), SIDE, SIDE)


@query(NET + SUPPORT + ", " + MESH + "SELECT s.id AS pid, min(fid) AS fid FROM support s, face f JOIN vert a ON a.vid = u JOIN vert b ON b.vid = v JOIN vert c ON c.vid = w WHERE (((b.x-a.x)*(s.y-a.y) - (b.y-a.y)*(s.x-a.x)) >= 0 AND ((c.x-b.x)*(s.y-b.y) - (c.y-b.y)*(s.x-b.x)) >= 0 AND ((a.x-c.x)*(s.y-c.y) - (a.y-c.y)*(s.x-c.x)) >= 0) OR (((b.x-a.x)*(s.y-a.y) - (b.y-a.y)*(s.x-a.x)) <= 0 AND ((c.x-b.x)*(s.y-b.y) - (c.y-b.y)*(s.x-b.x)) <= 0 AND ((a.x-c.x)*(s.y-c.y) - (a.y-c.y)*(s.x-c.x)) <= 0) GROUP BY s.id")
def point_in_triangle(t: Tables) -> DataFrame:
    v, f, _, _ = parts(t)
    return M.locate(support(t).withColumnRenamed("id", "pid"), f, v, SIDE, SIDE)


@query(NET + SEG + ", " + MESH + f", dmin AS (SELECT vid, z, min({DISTANCE}) AS d FROM vert v, seg GROUP BY 1, 2) SELECT vid, round((z + CAST(0.05 AS DOUBLE))*exp(-1000*d*d) - CAST(0.05 AS DOUBLE), 6) + 0 AS height FROM dmin")
def height_decay(t: Tables) -> DataFrame:
    """Heights that fall off with the distance to the nearest edge, which only near edges can be."""
    v = parts(t)[0]
    near = C.network_distances(v, segments(t).select(F.lit(0).alias("snapshot"), "ux", "uy", "vx", "vy"), C.DECAY_REACH)
    return v.join(near, "vid", "left").select("vid", (r6(C.decayed(F.col("z"), F.col("distance"), 0.0)) + 0).alias("height"))


@query(NET + SUPPORT + ", " + MESH + f", c AS (SELECT id, floor(x*{n1}) AS i, floor(y*{n1}) AS j, x*{n1} - floor(x*{n1}) AS p, y*{n1} - floor(y*{n1}) AS q FROM support) SELECT id, round((1-p)*((1-q)*a.z + q*b.z) + p*((1-q)*e.z + q*g.z), 6) AS height FROM c JOIN vert a ON a.i = c.i AND a.j = c.j JOIN vert b ON b.i = c.i AND b.j = c.j + 1 JOIN vert e ON e.i = c.i + 1 AND e.j = c.j JOIN vert g ON g.i = c.i + 1 AND g.j = c.j + 1")
def bilinear_height(t: Tables) -> DataFrame:
    v = parts(t)[0].select("i", "j", "z")
    fx, fy = F.col("x") * n1, F.col("y") * n1
    out = support(t).select("id", F.floor(fx).alias("ci"), F.floor(fy).alias("cj"), (fx - F.floor(fx)).alias("p"), (fy - F.floor(fy)).alias("q"))
    for name, di, dj in (("z00", 0, 0), ("z01", 0, 1), ("z10", 1, 0), ("z11", 1, 1)):
        out = out.join(v.select((F.col("i") - di).alias("ci"), (F.col("j") - dj).alias("cj"), F.col("z").alias(name)), ["ci", "cj"])
    return out.select("id", r6(geo.bilinear(*[F.col(c) for c in ("z00", "z01", "z10", "z11", "p", "q")])).alias("height"))


POLYGON = [(0.1, 0.1), (0.9, 0.2), (0.5, 0.5), (0.8, 0.9), (0.2, 0.8)]
_xy = ", ".join(f"({k}, CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))" for k, (x, y) in enumerate(POLYGON))


@query(NET + SUPPORT + f", poly(k, x, y) AS (VALUES {_xy}), side AS (SELECT p.x AS ux, p.y AS uy, q.x AS vx, q.y AS vy FROM poly p JOIN poly q ON q.k = (p.k + 1) % {len(POLYGON)}) SELECT id AS pid, sum(CASE WHEN (uy > y) <> (vy > y) AND ux + (y-uy)/(vy-uy)*(vx-ux) > x THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM support, side GROUP BY id")
def point_in_polygon(t: Tables) -> DataFrame:
    poly = t.spark.createDataFrame([(0, k, x, y) for k, (x, y) in enumerate(POLYGON)], "gid int, pos int, x double, y double")
    return M.in_polygons(support(t).withColumnRenamed("id", "pid"), poly)


DET = "((a.vy-a.uy)*(b.vx-b.ux) - (a.vx-a.ux)*(b.vy-b.uy))"


@query(NET + SEG + f", x AS (SELECT a.sid AS s1, b.sid AS s2, ((b.uy-a.uy)*(b.vx-b.ux) - (b.ux-a.ux)*(b.vy-b.uy))/nullif({DET}, 0) AS p, ((b.uy-a.uy)*(a.vx-a.ux) - (b.ux-a.ux)*(a.vy-a.uy))/nullif({DET}, 0) AS q FROM seg a JOIN seg b ON a.sid < b.sid WHERE a.sid//100 <> b.sid//100 AND a.sid % 100 <> b.sid % 100 AND a.sid//100 <> b.sid % 100 AND a.sid % 100 <> b.sid//100) SELECT s1, s2, round(p, 6) AS share FROM x WHERE p > 0 AND p < 1 AND q > 0 AND q < 1")
def segment_crossings(t: Tables) -> DataFrame:
    return M.crossings(segments(t).drop("rtt_us")).select("s1", "s2", r6(F.col("share")).alias("share"))


@query("WITH g AS (SELECT a, b, c, d FROM (VALUES (1, 10), (2, 20)) x(a, b), (VALUES (100), (200), (300)) y(c), (VALUES (7)) z(d)) SELECT a, b, d, array_to_string(list(CAST(c AS VARCHAR) ORDER BY c), ',') AS batch FROM g GROUP BY 1, 2, 3")
def param_grid(t: Tables) -> DataFrame:
    """Grouped values go together, groups multiply, and each batch runs along the ordering parameter."""
    grid = K.expand(t.spark, {"a": [1, 2], "b": [10, 20], "c": [100, 200, 300]}, [["a", "b"]], {"d": 7})
    return K.batches(grid, "c").select("a", "b", "d", F.array_join(F.transform("batch", lambda x: x.cast("string")), ",").alias("batch"))


@query("SELECT concat('run_', o_custkey, '_', o_orderstatus) AS dir, count(*) AS runs FROM orders GROUP BY 1 HAVING count(*) > 1")
def dup_outputs(t: Tables) -> DataFrame:
    return K.duplicates(t.orders.select(F.concat(F.lit("run_"), F.col("o_custkey").cast("string"), F.lit("_"), F.col("o_orderstatus")).alias("dir")), "dir")


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seed FROM orders")
def seed_chain(t: Tables) -> DataFrame:
    """Each run starts from the one before it in its batch."""
    return t.orders.select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("seed"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


@query("SELECT o_orderkey, upper(split_part(lower(o_orderpriority), '-', 1)) AS head, regexp_replace(o_orderpriority, '[0-9]+$', '') AS stripped, strftime(o_orderdate, '%Y%m%d%H%M%S') AS stamp FROM orders")
def string_functions(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.upper(F.split(F.lower(p), "-")[0]).alias("head"), F.regexp_replace(p, "[0-9]+$", "").alias("stripped"), F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("stamp"))
