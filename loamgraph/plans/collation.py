"""Queries over collated snapshots: the years' networks under common names and on one scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import lit
from ..operators import collate as C
from ..operators import mesh as M
from . import network as net
from .basic import SUPPORT, r6, support
from .network import NET
from .registry import Tables, query
from .stage import stage
from .surface import DISTANCE, SIDE
from .timeline import YEARLY, yearly

BUBBLE = 0.03
CELLS = SIDE * SIDE
n1 = SIDE - 1


def clusters(t: Tables) -> DataFrame:
    """snapshot, id, rep: each year's active nodes of a country, in two clusters that change from year to year; the busiest stands for its cluster."""
    busy = yearly(t).select(F.col("y").alias("snapshot"), F.explode(F.array("a", "b")).alias("id"), "weight").groupBy("snapshot", "id").agg(F.sum("weight").alias("weight"))
    part = ((F.col("id") + F.col("snapshot") * F.col("id")) % 3 == 0).cast("int")
    placed = busy.join(net.nodes(t).select("id", "country"), "id").withColumn("part", part)
    best = placed.groupBy("snapshot", "country", "part").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id")).alias("b")).select("snapshot", "country", "part", F.col("b.id").alias("rep"))
    return placed.join(best, ["snapshot", "country", "part"]).select("snapshot", "id", "rep")


COLLATED = (
    YEARLY
    + """, busy AS (SELECT y, id, sum(weight) AS w FROM (SELECT y, a AS id, weight FROM yearly UNION ALL SELECT y, b, weight FROM yearly) GROUP BY 1, 2),
pl AS (SELECT y, id, first_value(id) OVER (PARTITION BY y, country, (id + y*id) % 3 = 0 ORDER BY w DESC, id) AS rep FROM busy JOIN nodes USING (id)),
tie AS (SELECT DISTINCT p.id AS u, q.id AS v FROM pl p JOIN pl q ON p.y = q.y AND p.rep = q.rep),
meet AS (SELECT u AS id, u AS other FROM tie UNION SELECT m.id, v FROM meet m JOIN tie ON u = m.other),
nam AS (SELECT id, min(other) AS name FROM meet GROUP BY id)
"""
)


@query(NET + COLLATED + "SELECT id, name, (SELECT string_agg(CAST(id AS VARCHAR), '/' ORDER BY CAST(id AS VARCHAR)) FROM nam m WHERE m.name = nam.name) AS label FROM nam")
def collated_nodes(t: Tables) -> DataFrame:
    return C.unified(clusters(t))


EDGES = ", cedge AS (SELECT y AS snapshot, least(p.name, q.name) AS a, greatest(p.name, q.name) AS b, CAST(sum(weight) AS BIGINT) AS weight, avg(CAST(low AS DOUBLE)) AS low FROM yearly JOIN nam p ON p.id = a JOIN nam q ON q.id = b WHERE p.name <> q.name GROUP BY 1, 2, 3)\n"


def _edges(t: Tables, names: DataFrame) -> DataFrame:
    links = yearly(t).select(F.col("y").alias("snapshot"), "a", "b", "weight", F.col("low").cast("double").alias("low"))
    return C.relabelled(links, names, ["weight"], ["low"])


@query(NET + COLLATED + EDGES + "SELECT snapshot, a, b, weight, round(low, 6) AS low FROM cedge")
def collated_edges(t: Tables) -> DataFrame:
    return _edges(t, C.unified(clusters(t))).select("snapshot", "a", "b", "weight", r6(F.col("low")).alias("low"))


def dome(i, j):
    """The initial surface over a unit square, by the vertex's row and column."""
    x, y = i / lit(n1) - lit(0.5), j / lit(n1) - lit(0.5)
    return F.sqrt(lit(2) - x * x - y * y)


DOME = f"sqrt(CAST(2 AS DOUBLE) - (i/CAST({n1} AS DOUBLE) - CAST(0.5 AS DOUBLE))*(i/CAST({n1} AS DOUBLE) - CAST(0.5 AS DOUBLE)) - (j/CAST({n1} AS DOUBLE) - CAST(0.5 AS DOUBLE))*(j/CAST({n1} AS DOUBLE) - CAST(0.5 AS DOUBLE)))"
HEIGHTS = f""", cv AS (SELECT i*{SIDE} + j AS vid, i/CAST({n1} AS DOUBLE) AS x, j/CAST({n1} AS DOUBLE) AS y, {DOME} AS z FROM (SELECT unnest(range({SIDE})) AS i), (SELECT unnest(range({SIDE})) AS j)),
load AS (SELECT year(ts) AS snapshot, (source*{SIDE} + target*7 + throughput) % {CELLS} AS vid, CAST(sum(throughput) AS DOUBLE)/count(*) AS q FROM raw GROUP BY 1, 2),
yr AS (SELECT DISTINCT snapshot FROM load),
fin AS (SELECT yr.snapshot, v.vid, coalesce(CAST(0.01 AS DOUBLE)*q, 0) AS z FROM yr CROSS JOIN cv v LEFT JOIN load USING (snapshot, vid)),
cseg AS (SELECT yearly.y AS snapshot, p.x AS ux, p.y AS uy, q.x AS vx, q.y AS vy FROM yearly JOIN support p ON p.id = a JOIN support q ON q.id = b WHERE weight % 7 = 0),
cdist AS (SELECT snapshot, v.vid, min({DISTANCE}) AS d FROM cv v, cseg GROUP BY 1, 2),
zz AS (SELECT f.snapshot, f.vid, z, d FROM fin f LEFT JOIN cdist c ON c.snapshot = f.snapshot AND c.vid = f.vid),
lev AS (SELECT snapshot, avg(z) AS level, min(z) - avg(z) AS low, max(z) - avg(z) AS high FROM zz WHERE d <= CAST({BUBBLE} AS DOUBLE) GROUP BY 1),
ends AS (SELECT min(low) AS least, max(high) AS most FROM lev),
high AS (SELECT snapshot, vid, (z - coalesce(level, 0) - least)/(most - least)*CAST(0.15 AS DOUBLE) AS h, coalesce(greatest(d - CAST({BUBBLE} AS DOUBLE), 0), 9) AS beyond FROM zz LEFT JOIN lev USING (snapshot), ends),
height AS (SELECT snapshot, vid, (h + CAST(0.05 AS DOUBLE))*exp(-1000*beyond*beyond) - CAST(0.05 AS DOUBLE) AS height FROM high)
"""


def _heights(t: Tables) -> DataFrame:
    """Surfaces whose rise over the dome is the mean of the loads that fall to a vertex in a year."""
    grid = M.grid(t.spark, SIDE, SIDE).withColumn("z", dome(F.col("i"), F.col("j")))
    links = net.raw_links(t)
    vid = (F.col("source") * SIDE + F.col("target") * 7 + F.col("throughput")) % CELLS
    load = links.groupBy(F.year("ts").alias("snapshot"), vid.alias("vid")).agg((F.sum("throughput").cast("double") / F.count(F.lit(1))).alias("q"))
    # A surface for each snapshot: as many rows as the result has.
    every = load.select("snapshot").distinct().crossJoin(grid.select("vid", "z"))
    final = every.join(load, ["snapshot", "vid"], "left").select("snapshot", "vid", (F.col("z") + F.coalesce(lit(0.01) * F.col("q"), lit(0))).alias("z"))
    p = support(t)
    a, b = (p.select(F.col("id").alias(k), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for k, n in (("a", "u"), ("b", "v")))
    segments = yearly(t).where("weight % 7 = 0").join(a, "a").join(b, "b").select(F.col("y").alias("snapshot"), "ux", "uy", "vx", "vy")
    return C.collated_heights(final, grid, C.network_distances(grid, segments, BUBBLE + C.DECAY_REACH), BUBBLE)


@query(NET + SUPPORT + YEARLY + HEIGHTS + "SELECT snapshot, vid, round(height, 6) + 0 AS height FROM height")
def collated_heights(t: Tables) -> DataFrame:
    """One row a snapshot and vertex: the years' surfaces without the initial one, on one scale."""
    return _heights(t).select("snapshot", "vid", (r6(F.col("height")) + 0).alias("height"))


@query(
    NET
    + SUPPORT
    + COLLATED
    + EDGES
    + HEIGHTS
    + """, lab AS (SELECT name, string_agg(CAST(id AS VARCHAR), '/' ORDER BY CAST(id AS VARCHAR)) AS label FROM nam GROUP BY 1), spot AS (SELECT name, label, s.x, s.y FROM lab JOIN support s ON s.id = name)
SELECT 'node' AS kind, NULL AS snapshot, CAST(name AS BIGINT) AS a, NULL AS b, label, round(x, 6) AS x, round(y, 6) AS y, NULL AS value FROM spot
UNION ALL SELECT 'edge', CAST(snapshot AS BIGINT), CAST(a AS BIGINT), CAST(b AS BIGINT), NULL, NULL, NULL, round(weight/CAST((SELECT max(weight) FROM cedge) AS DOUBLE), 6) FROM cedge
UNION ALL SELECT 'height', snapshot, vid, NULL, NULL, NULL, NULL, round(height, 6) + 0 FROM height
UNION ALL SELECT 'map', NULL, NULL, NULL, NULL, round((min(x) + max(x))/2, 6), round((min(y) + max(y))/2, 6), round(1/greatest(max(x) - min(x), max(y) - min(y)), 6) FROM spot"""
)
def animation_doc(t: Tables) -> DataFrame:
    """The animation written as JSON lines, and read back."""
    from .models import _folder

    named = stage(C.unified(clusters(t)))
    spots = named.select("name", "label").distinct().join(support(t).withColumnRenamed("id", "name"), "name")
    rows = C.animation(spots, _edges(t, named), _heights(t))
    path = _folder(t, "animation")
    C.write_animation(rows, path)
    back = t.spark.read.schema("kind string, snapshot long, a long, b long, label string, x double, y double, value double").json(path)
    return back.select("kind", "snapshot", "a", "b", "label", *[(r6(F.col(c)) + 0).alias(c) for c in ("x", "y", "value")])
