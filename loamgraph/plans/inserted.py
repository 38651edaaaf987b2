"""Queries over meshes with the network's places as vertices, and routes drawn on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import insertion as I
from ..operators import mesh as M
from ..operators import polylines as L
from .basic import SUPPORT, r6, support
from .graph import ROUTES, loaded_routes
from .network import NET
from .registry import Tables, query
from .stage import stage
from .surface import MESH, SEG, SIDE, parts, segments

n1 = SIDE - 1


def points(t: Tables) -> DataFrame:
    """pid, x, y: the nodes, and the middles of the edges."""
    s = segments(t)
    middle = s.select((F.col("sid") + 1000).alias("pid"), ((F.col("ux") + F.col("vx")) / 2).alias("x"), ((F.col("uy") + F.col("vy")) / 2).alias("y"))
    return support(t).select(F.col("id").cast("long").alias("pid"), "x", "y").unionByName(middle.select(F.col("pid").cast("long").alias("pid"), "x", "y"))


def inserted(t: Tables, of: DataFrame) -> I.Inserted:
    v, f, _, _ = parts(t)
    held = M.locate(of, f, v, SIDE, SIDE)
    return I.insert(of.join(held, "pid"), f, v, 1e-9)


POINTS = ", pt AS (SELECT id AS pid, x, y FROM support UNION ALL SELECT sid + 1000, (ux + vx)/2, (uy + vy)/2 FROM seg)\n"


@query(
    NET
    + SEG
    + ", "
    + MESH
    + POINTS
    + f""", c AS (SELECT pid, floor(x*{n1}) AS i, floor(y*{n1}) AS j, x*{n1} - floor(x*{n1}) AS p, y*{n1} - floor(y*{n1}) AS q FROM pt)
SELECT pid, round(CASE WHEN p >= q THEN a.z + p*(e.z - a.z) + q*(g.z - e.z) ELSE a.z + q*(b.z - a.z) + p*(g.z - b.z) END, 6) + 0 AS height FROM c JOIN vert a ON a.i = c.i AND a.j = c.j JOIN vert b ON b.i = c.i AND b.j = c.j + 1 JOIN vert e ON e.i = c.i + 1 AND e.j = c.j JOIN vert g ON g.i = c.i + 1 AND g.j = c.j + 1"""
)
def inserted_mesh(t: Tables) -> DataFrame:
    """The heights of points that became vertices: the surface stays as it was."""
    made = inserted(t, points(t))
    return made.placed.join(made.vertices, "vid").select("pid", (r6(F.col("z")) + 0).alias("height"))


@query(NET + SEG + ", " + MESH + POINTS + f", spot AS (SELECT DISTINCT round(x, 7) AS x, round(y, 7) AS y FROM pt) SELECT {SIDE * SIDE} + count(*) AS vertices, 1 AS euler, CAST(1 AS DOUBLE) AS flat_area, {2 * n1 * n1} AS given FROM spot")
def inserted_topology(t: Tables) -> DataFrame:
    """Vertices, Euler's number and area of the mesh with points put in, and the faces left once they are taken out."""
    made = inserted(t, points(t))
    f, v = made.faces, made.vertices
    flat = v
    corners = f
    for c in "uvw":
        corners = corners.join(flat.select(F.col("vid").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), c)
    area = F.abs((F.col("vx") - F.col("ux")) * (F.col("wy") - F.col("uy")) - (F.col("vy") - F.col("uy")) * (F.col("wx") - F.col("ux"))) / 2
    sides = f.select(F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("u", "v"), ("v", "w"), ("w", "u"))])).alias("s")).distinct()
    one = lambda df, c: df.agg(c)
    out = one(v, F.count(F.lit(1)).alias("vertices")).crossJoin(one(corners, F.struct(F.count(F.lit(1)).alias("n"), F.sum(area).alias("area")).alias("f"))).crossJoin(one(sides, F.count(F.lit(1)).alias("sides"))).crossJoin(one(made.removed(), F.count(F.lit(1)).alias("given")))
    return out.select("vertices", (F.col("vertices") - F.col("sides") + F.col("f.n")).alias("euler"), r6(F.col("f.area")).alias("flat_area"), "given")


TOP = 100


def drawn(t: Tables, flat: bool) -> tuple[DataFrame, DataFrame]:
    """(routes, lines): the routes of most traffic and their lines over the mesh, or over the plane below it."""
    nodes = support(t).select(F.col("id").cast("long").alias("pid"), "x", "y")
    made = inserted(t, nodes)
    vertices = made.vertices.withColumn("z", F.lit(0.0)) if flat else made.vertices
    name = F.array_join(F.transform("route", lambda x: F.lpad(x.cast("string"), 6, "0")), "-")
    best = loaded_routes(t)[3].where("s <> t").orderBy(F.desc("volume"), F.desc(name)).limit(TOP)
    best = stage(best.select("route_id", "s", "t", "route"))
    stops = best.select("route_id", F.posexplode("route").alias("pos", "pid")).join(made.placed, "pid")
    ways = stops.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "vid"))).alias("stops")).select("route_id", F.col("stops.vid").alias("stops"))
    return best, L.polylines(stage(ways), stage(made.faces.select("u", "v", "w")), vertices.select("vid", "x", "y", "z"))


@query(
    NET
    + ROUTES
    + SUPPORT
    + f""", best AS (SELECT route_id, s, t FROM vol WHERE s <> t ORDER BY volume DESC, array_to_string(list_transform(route, lambda x: lpad(CAST(x AS VARCHAR), 6, '0')), '-') DESC LIMIT {TOP})
SELECT route_id, round(sqrt((a.x - b.x)*(a.x - b.x) + (a.y - b.y)*(a.y - b.y)), 6) AS length, true AS shortened FROM best JOIN support a ON a.id = s JOIN support b ON b.id = t"""
)
def flat_polylines(t: Tables) -> DataFrame:
    """On a flat mesh the taut line is the straight one, and no longer than the trace."""
    return drawn(t, True)[1].select("route_id", r6(F.col("length")).alias("length"), (F.col("length") <= F.col("trace") + 1e-9).alias("shortened"))


@query()
def route_polylines(t: Tables) -> DataFrame:
    """The routes of most traffic as lines on the surface, one row a point."""
    lines = drawn(t, False)[1]
    return lines.select("route_id", r6(F.col("trace")).alias("trace"), r6(F.col("length")).alias("length"), F.posexplode("points").alias("pos", "p")).select("route_id", "trace", "length", "pos", *[r6(F.col(f"p.{k}")).alias(k) for k in "xyz"])
