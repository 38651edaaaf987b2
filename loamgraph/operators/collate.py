"""Snapshots put together: common names, heights on one scale, and the animation's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.stage import stage
from .clusters import components
from .mesh import points_near_segments

#: Beyond this distance from the bubble a height has decayed to nothing: exp(-1000 * 0.15^2) is below 2e-10.
DECAY_REACH = 0.15


def unified(clusters: DataFrame) -> DataFrame:
    """id, name, label: one name for all nodes that any snapshots' clusters tie together, the least of them; the label lists them all.

    clusters: snapshot, id, rep.  A snapshot may lack nodes, and may have chosen another representative: nodes are tied if some
    snapshot has them in one cluster.
    """
    member = stage(clusters.select(F.concat_ws("/", "snapshot", "rep").alias("cluster"), "id").distinct())
    # Each member is tied to its cluster's least one, so that a cluster of n gives n - 1 ties.
    low = member.groupBy("cluster").agg(F.min("id").alias("a"))
    ties = member.join(low, "cluster").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    named = stage(components(member.select("id").distinct(), ties).withColumnRenamed("component", "name"))
    labels = named.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list(F.col("id").cast("string"))), "/").alias("label"))
    return named.join(labels, "name").select("id", "name", "label")


def relabelled(edges: DataFrame, names: DataFrame, sums: list[str], means: list[str]) -> DataFrame:
    """snapshot, a < b and the columns: edges between names, each pair once a snapshot; edges inside a name go."""
    ends = edges
    for c in "ab":
        ends = ends.join(names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")), c)
    values = [*(F.sum(c).alias(c) for c in sums), *(F.avg(c).alias(c) for c in means)]
    return ends.where("a_name <> b_name").groupBy("snapshot", F.least("a_name", "b_name").alias("a"), F.greatest("a_name", "b_name").alias("b")).agg(*values)


def network_distances(vertices: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """snapshot, vid, distance to the snapshot's nearest segment, up to `reach`; what is farther is left out.

    vertices: vid, x, y; segments: snapshot, ux, uy, vx, vy.
    """
    sid = F.struct("snapshot", "ux", "uy", "vx", "vy")
    near = points_near_segments(vertices.select(F.col("vid").alias("pid"), "x", "y"), segments.select(sid.alias("sid"), "ux", "uy", "vx", "vy"), reach)
    return near.groupBy(F.col("sid.snapshot").alias("snapshot"), F.col("pid").alias("vid")).agg(F.min("distance").alias("distance"))


def decayed(z: Column, distance: Column, bubble: float) -> Column:
    """Heights that fall to -0.05 with the distance beyond the bubble; no distance is beyond all reach."""
    return F.when(distance.isNull(), F.lit(-0.05)).otherwise(geo.border_decay(z, F.greatest(distance - F.lit(bubble), F.lit(0.0))))


def collated_heights(final: DataFrame, initial: DataFrame, distances: DataFrame, bubble: float, scale: float | None = 0.15) -> DataFrame:
    """snapshot, vid, height: all snapshots' surfaces on one scale.

    From each surface its initial one is taken off, then its mean over the vertices within `bubble` of its network; the least of
    these over all snapshots becomes 0 and the greatest `scale` (None: as they are; so too if all are one), and heights decay outside the bubble.
    A snapshot without vertices inside keeps its own level.  final: snapshot, vid, z; initial: vid, z; distances as of `network_distances`.
    """
    z = final.join(initial.select("vid", F.col("z").alias("z0")), "vid").join(distances, ["snapshot", "vid"], "left")
    z = stage(z.select("snapshot", "vid", (F.col("z") - F.col("z0")).alias("z"), "distance"))
    inside = F.col("distance") <= bubble
    level = z.where(inside).groupBy("snapshot").agg(F.avg("z").alias("level"), F.min("z").alias("low"), F.max("z").alias("high"))
    # One row, and one for each snapshot.
    whole = level.agg(F.min(F.col("low") - F.col("level")).alias("least"), F.max(F.col("high") - F.col("level")).alias("most"))
    shifted = z.join(level.select("snapshot", "level"), "snapshot", "left").crossJoin(F.broadcast(whole))
    h = F.col("z") - F.coalesce("level", F.lit(0.0)) - F.coalesce("least", F.lit(0.0))
    if scale is not None:
        h = F.when(F.col("most") != F.col("least"), h / (F.col("most") - F.col("least")) * F.lit(scale)).otherwise(h)
    return shifted.select("snapshot", "vid", decayed(h, F.col("distance"), bubble).alias("height"))


def animation(nodes: DataFrame, edges: DataFrame, heights: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """The animation as rows: kind, snapshot, a, b, label, x, y, value; a document of any size is written by its parts.

    Kinds: node (a: its name, x, y), edge (a, b, value: its share of the greatest weight of all), height (a: its vertex, value) and map (x, y: the centre,
    value: the zoom).  nodes: name, label, x, y; edges: snapshot, a, b, weight; heights: snapshot, vid, height.
    """
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, kind, time, a, b, label, x, y, value: df.select(F.lit(kind).alias("kind"), time.cast("long").alias("snapshot"), a.cast("long").alias("a"), b.cast("long").alias("b"), label.cast("string").alias("label"), x.cast("double").alias("x"), y.cast("double").alias("y"), value.cast("double").alias("value"))
    absent = none("long")
    most = edges.agg(F.max("weight").alias("most"))
    share = F.when(F.col("most") != 0, F.col("weight") / F.col("most")).otherwise(0.0)
    box = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).where("x0 is not null")
    zoom = F.when(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > 0, F.lit(1.0) / F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).otherwise(1.0)
    parts = [
        row(nodes, "node", absent, F.col("name"), absent, F.col("label"), F.col("x"), F.col("y"), absent),
        row(edges.crossJoin(F.broadcast(most)), "edge", F.col(snapshot), F.col("a"), F.col("b"), absent, absent, absent, share),
        row(heights, "height", F.col(snapshot), F.col("vid"), absent, absent, absent, absent, F.col("height")),
        row(box, "map", absent, absent, absent, absent, (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, zoom),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def write_animation(rows: DataFrame, path: str) -> None:
    """JSON lines in folders of kinds; a reader takes the frames that it shows."""
    rows.write.partitionBy("kind").option("ignoreNullFields", True).json(path)
