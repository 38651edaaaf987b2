"""Queries over meshes of the sphere, and over stored documents searched by pushed filters."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import mesh as M
from ..operators import sphere as S
from ..sources import search
from . import network as net
from .basic import r6
from .models import _folder
from .network import NET
from .registry import Tables, query

#: Cuts of an icosahedron's side, and how near an arc a vertex counts as on it (radians).
CUTS = 8
NEAR_ARC = 0.1

_CORNERS, _, _FACES = S.icosahedron()
_DIRECTION = "cos(radians(lon))*cos(radians(lat)) AS x, sin(radians(lon))*cos(radians(lat)) AS y, sin(radians(lat)) AS z"
_AT = ", ".join(f"(CAST({CUTS} - i - j AS DOUBLE)*p.{k} + i*q.{k} + j*r.{k}) AS {k}" for k in "xyz")
_NAME = f"list_sort(list_filter([CASE WHEN i + j < {CUTS} THEN f.a*1000 + {CUTS} - i - j END, CASE WHEN i > 0 THEN f.b*1000 + i END, CASE WHEN j > 0 THEN f.c*1000 + j END], lambda e: e IS NOT NULL))::VARCHAR"
VERT = (
    f"corner(c, x, y, z) AS (VALUES {', '.join(str((n, *p)) for n, p in enumerate(_CORNERS))}),\n"
    f"face(a, b, c) AS (VALUES {', '.join(map(str, _FACES))}),\n"
    f"grown AS (SELECT {_NAME} AS name, {_AT} FROM face f JOIN corner p ON p.c = f.a JOIN corner q ON q.c = f.b JOIN corner r ON r.c = f.c, (SELECT unnest(range({CUTS + 1})) AS i), (SELECT unnest(range({CUTS + 1})) AS j) WHERE i + j <= {CUTS}),\n"
    "vert AS (SELECT name, min(x/sqrt(x*x+y*y+z*z)) AS x, min(y/sqrt(x*x+y*y+z*z)) AS y, min(z/sqrt(x*x+y*y+z*z)) AS z FROM grown GROUP BY 1),\n"
    f"dirs AS (SELECT id, {_DIRECTION} FROM nodes)\n"
)


def directions(t: Tables) -> DataFrame:
    x, y, z = geo.sphere_point(F.col("lat"), F.col("lon"))
    return net.nodes(t).select(F.col("id").alias("pid"), x.alias("x"), y.alias("y"), z.alias("z"))


@query(NET + "," + VERT + "SELECT id, round(max(d.x*v.x + d.y*v.y + d.z*v.z), 6) AS cosine FROM dirs d, vert v GROUP BY 1")
def sphere_nearest(t: Tables) -> DataFrame:
    """How near each node's nearest vertex of the sphere is; the SQL tries all vertices."""
    return S.nearest_on_sphere(directions(t), CUTS).select(F.col("pid").alias("id"), r6(F.col("cosine")).alias("cosine"))


@query(
    NET + "," + VERT + ", arcs AS (SELECT a, b, x.x AS ux, x.y AS uy, x.z AS uz, y.x AS vx, y.y AS vy, y.z AS vz, x.x*y.x + x.y*y.y + x.z*y.z AS uv FROM near JOIN dirs x ON x.id = a JOIN dirs y ON y.id = b),\n"
    "dots AS (SELECT a, b, uv, x*ux + y*uy + z*uz AS ru, x*vx + y*vy + z*vz AS rv FROM arcs, vert)\n"
    f"SELECT a, b, count(*) AS vertices FROM dots WHERE greatest(ru, rv) > cos({NEAR_ARC}) OR (sqrt((ru*ru + rv*rv - 2*ru*rv*uv)/(1 - uv*uv)) > cos({NEAR_ARC}) AND ru > rv*uv AND rv > ru*uv) GROUP BY 1, 2"
)
def sphere_fat_edges(t: Tables) -> DataFrame:
    """How many vertices of the sphere lie near each link's great-circle arc."""
    at = directions(t)
    end = lambda link, n: at.select(F.col("pid").alias(link), *[F.col(k).alias(f"{n}{k}") for k in "xyz"])
    arcs = net.near(t).join(end("a", "u"), "a").join(end("b", "v"), "b").withColumn("sid", F.struct("a", "b"))
    return S.near_arcs(S.sphere_vertices(t.spark, CUTS), arcs, NEAR_ARC).groupBy("sid").agg(F.count(F.lit(1)).alias("vertices")).select("sid.a", "sid.b", "vertices")


def swollen_sphere(t: Tables) -> DataFrame:
    """The sphere, further from its centre where more traffic starts: a vertex's parameter is its nodes' share of all."""
    sent = net.directed(t).groupBy(F.col("source").alias("pid")).agg(F.sum("throughput").alias("sent"))
    whole = sent.agg(F.sum("sent").alias("whole"))
    at = S.nearest_on_sphere(directions(t), CUTS).join(sent, "pid").groupBy("vid").agg(F.sum("sent").alias("sent"))
    return S.swollen(S.sphere_vertices(t.spark, CUTS), at.crossJoin(F.broadcast(whole)).select("vid", (F.col("sent") / F.col("whole")).alias("parameter")))


@query(NET + f"SELECT CAST({10 * CUTS * CUTS + 2} AS BIGINT) AS vertices, CAST({20 * CUTS * CUTS} AS BIGINT) AS faces, round(4*pi(), 6) AS total_curvature, round(1.0, 6)::DOUBLE AS parameters FROM (SELECT sum(throughput) AS s FROM dedges) WHERE s > 0")
def sphere_curvature(t: Tables) -> DataFrame:
    """The swollen sphere's curvature over its whole surface, which is that of any closed surface without holes."""
    v = swollen_sphere(t)
    half = M.halfedges(M.placed_faces(S.sphere_faces(t.spark, CUTS), v))
    around = M.gaussian_curvature(half).join(M.vertex_areas(half), "vid").join(v.select("vid", (F.log(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")) / 2).alias("parameter")), "vid")
    whole = around.agg(F.count(F.lit(1)).alias("vertices"), F.sum(F.col("kappa") * F.col("area")).alias("k"), F.sum("parameter").alias("p"))
    faces = S.sphere_faces(t.spark, CUTS).agg(F.count(F.lit(1)).alias("faces"))
    return whole.crossJoin(faces).select("vertices", "faces", r6(F.col("k")).alias("total_curvature"), r6(F.col("p")).alias("parameters"))


#: The search's first and last moment, fixed values within the events' month.
FROM, UNTIL = datetime.datetime(2024, 1, 5, 6), datetime.datetime(2024, 1, 9, 18)


def found_events(t: Tables, where: Column) -> DataFrame:
    """All events, written as nested documents in folders by day, and what a search finds among them."""
    path = _folder(t, "documents")
    document = F.struct(
        F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type")).alias("test"),
        F.struct(F.struct(F.concat(F.lit("host-"), F.col("user_id").cast("string"), F.lit(".net")).alias("hostname")).alias("source")).alias("meta"),
        F.struct(F.col("ts").alias("start_time")).alias("scheduler"),
        F.struct("value", "props").alias("result"),
    )
    search.write_documents(t.events, document, F.col("ts"), path)
    return search.search(
        t.spark, path,
        {"event_id": ("test.id", "long"), "event_type": ("test.type", "string"), "host": ("meta.source.hostname", "string"), "ts": ("scheduler.start_time", "timestamp_ntz"), "value": ("result.value", "double")},
        where, time="ts",
    )


@query(f"SELECT event_id, event_type, concat('host-', user_id, '.net') AS host, value FROM events WHERE ts >= TIMESTAMP '{FROM}' AND ts < TIMESTAMP '{UNTIL}' AND event_type <> 'view' AND CAST(user_id AS VARCHAR) LIKE '%7' AND value > 5")
def document_search(t: Tables) -> DataFrame:
    """Documents of a range of time by host and value; days outside the range are not read."""
    first, last = (F.lit(m.isoformat(sep=" ")).cast("timestamp_ntz") for m in (FROM, UNTIL))
    where = (F.col("ts") >= first) & (F.col("ts") < last) & (F.col("event_type") != "view") & F.col("host").endswith("7.net") & (F.col("value") > 5)
    return found_events(t, where).select("event_id", "event_type", "host", "value")


@query("SELECT event_type, user_id, min(value) AS least, count(*) AS n FROM (SELECT event_type, concat('host-', user_id, '.net') AS user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND value > 0) GROUP BY 1, 2")
def document_minimum(t: Tables) -> DataFrame:
    """Least positive value by kind and host since a moment, over the documents of the days since then."""
    where = (F.col("ts") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")) & (F.col("value") > 0)
    return found_events(t, where).groupBy("event_type", F.col("host").alias("user_id")).agg(F.min("value").alias("least"), F.count(F.lit(1)).alias("n"))
