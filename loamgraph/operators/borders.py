"""Borders of drawn graphs: the drawing as a subdivision of the plane, in tables of half-edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import counted_stage, stage
from .clusters import components
from .mesh import crossings
from .stats import numbered


def cut_edges(segments: DataFrame, cell: float = 0.1) -> DataFrame:
    """p, q (structs x, y; p < q): the drawing's edges, cut where two segments cross, each once.

    segments: sid, ux, uy, vx, vy.  A crossing is one point on both segments.  An end that lies on another segment without crossing it stays beside it.
    """
    s = segments.select("sid", "ux", "uy", "vx", "vy").where("ux <> vx or uy <> vy")
    met = crossings(s, cell)
    first = s.select(F.col("sid").alias("s1"), *[F.col(c).alias(f"{c}1") for c in ("ux", "uy", "vx", "vy")])
    point = F.struct((F.col("ux1") + F.col("share") * (F.col("vx1") - F.col("ux1"))).alias("x"), (F.col("uy1") + F.col("share") * (F.col("vy1") - F.col("uy1"))).alias("y"))
    at = met.join(first, "s1").select(F.explode(F.array("s1", "s2")).alias("sid"), point.alias("p"))
    dx, dy = F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")
    along = ((F.col("p.x") - F.col("ux")) * dx + (F.col("p.y") - F.col("uy")) * dy) / (dx * dx + dy * dy)
    inner = at.join(s, "sid").select("sid", along.alias("t"), "p")
    ends = s.select("sid", F.explode(F.array(F.struct(F.lit(0.0).alias("t"), F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")).alias("p")), F.struct(F.lit(1.0).alias("t"), F.struct(F.col("vx").alias("x"), F.col("vy").alias("y")).alias("p")))).alias("e")).select("sid", "e.*")
    steps = inner.unionByName(ends).withColumn("q", F.lead("p").over(Window.partitionBy("sid").orderBy("t", "p")))
    return steps.where("q is not null and p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct()


def _doubled(state: DataFrame, merge: dict, changed, most_rounds: int = 64) -> DataFrame:
    """Pointers that jump twice as far each round, until `changed` holds nowhere.  state: h, next and what `merge` combines with that of the next (`far`)."""
    for _ in range(most_rounds):
        far = state.select(F.col("h").alias("next"), F.struct(*[c for c in state.columns if c != "h"]).alias("far"))
        moved = state.join(far, "next").select("h", F.col("far.next").alias("next"), *[how.alias(c) for c, how in merge.items()], changed.alias("_changed"))
        moved, seen = counted_stage(moved, n=F.count(F.when(F.col("_changed"), 1)))
        state = moved.drop("_changed")
        if not seen["n"]:
            return state
    raise RuntimeError("pointers did not settle")


def outer_rings(segments: DataFrame, cell: float = 0.1) -> DataFrame:
    """ring, pos, x, y: the outer border of each connected part of the drawing, counter-clockwise from its ring's least half-edge.

    Around each end, half-edges lie by angle; the one that follows another along its face is the next clockwise from its twin.  Faces are
    cycles of followers, named by their least half-edge (pointer doubling); of a part's faces, the outer one has the least signed area.  Dangling edges are walked on both sides.
    A part inside another's ring has a ring of its own.
    """
    e = stage(cut_edges(segments, cell))
    both = e.select(F.explode(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q")))).alias("h")).select(F.col("h.p").alias("a"), F.col("h.q").alias("b"))
    half = stage(numbered(both, [F.col("a"), F.col("b")]).withColumnRenamed("place", "h"))
    around = Window.partitionBy("a").orderBy(F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x")), "b")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # For the half-edge that comes in as the twin of this one: where it goes on.
    turn = half.select(F.col("b").alias("from"), F.col("a").alias("to"), F.coalesce(F.lag("h").over(around), F.last("h").over(whole)).alias("next"), F.col("h").alias("twin"))
    linked = stage(half.join(turn, (F.col("a") == F.col("from")) & (F.col("b") == F.col("to"))).select("h", "next", "twin", "a", "b"))
    low = _doubled(linked.select("h", "next", F.least("h", "next").alias("low")), {"low": F.least("low", "far.low")}, F.col("far.low") < F.col("low"))
    faces = stage(linked.join(low.select("h", "low"), "h").select("h", "next", "twin", "a", "b", "low"))
    tied = faces.select(F.col("twin").alias("h"), F.col("low").alias("other")).join(faces.select("h", "low"), "h").where("other <> low").select(F.least("low", "other").alias("a"), F.greatest("low", "other").alias("b")).distinct()
    parts = components(faces.select(F.col("low").alias("id")).distinct(), tied)
    area = faces.groupBy("low").agg(F.sum(F.col("a.x") * F.col("b.y") - F.col("b.x") * F.col("a.y")).alias("area")).join(parts, F.col("low") == F.col("id"))
    outer = area.groupBy("component").agg(F.min(F.struct("area", "low")).alias("m")).select(F.col("m.low").alias("low"))
    rings = stage(faces.join(outer, "low", "left_semi"))
    # Steps on to the ring's first half-edge, which counts none: the outer face is walked clockwise, so they run counter-clockwise.
    start = F.col("h") == F.col("low")
    rank = _doubled(rings.select("h", F.when(start, F.col("h")).otherwise(F.col("next")).alias("next"), F.when(start, 0).otherwise(1).cast("long").alias("pos")), {"pos": F.col("pos") + F.col("far.pos")}, F.col("far.pos") > 0)
    return rings.join(rank.select("h", "pos"), "h").select(F.col("low").alias("ring"), "pos", F.col("a.x").alias("x"), F.col("a.y").alias("y"))
