"""Points put into a triangle mesh as vertices: tables of faces that go and faces that come, in rounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.stage import counted_stage, stage


@dataclass
class Inserted:
    """A mesh with more vertices.

    faces: fid, u, v, w; vertices: vid, x, y, z, added; placed: pid, vid (the vertex that each point became, or that was there); gone: the given
    faces that were cut up; first: the least fid of a new face.
    """

    faces: DataFrame
    vertices: DataFrame
    placed: DataFrame
    gone: DataFrame
    first: int

    def removed(self) -> DataFrame:
        """The faces without the added vertices: the given mesh."""
        return self.faces.where(F.col("fid") < self.first).unionByName(self.gone)


def _with_corners(rows: DataFrame, vertices: DataFrame) -> DataFrame:
    for c in "uvw":
        rows = rows.join(vertices.select(F.col("vid").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyz"]), c)
    return rows


def _area(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def shares(x: Column, y: Column) -> dict[str, Column]:
    """The shares of a face's corners u, v and w in a point."""
    at = {c: (F.col(f"{c}x"), F.col(f"{c}y")) for c in "uvw"}
    whole = _area(*at["u"], *at["v"], *at["w"])
    return {"u": _area(x, y, *at["v"], *at["w"]) / whole, "v": _area(*at["u"], x, y, *at["w"]) / whole, "w": _area(*at["u"], *at["v"], x, y) / whole}


def insert(points: DataFrame, faces: DataFrame, vertices: DataFrame, epsilon: float = 0.0, most_rounds: int = 1000) -> Inserted:
    """Each point becomes a vertex of the mesh, on its surface.

    points: pid (not negative, each once), x, y, fid (a face that holds it, as of `locate`); faces: fid, u, v, w; vertices: vid, x, y, z.
    A point within `epsilon` of a corner is that vertex; within `epsilon` of a side it cuts the side and the faces on both sides of it; else it
    cuts its face in three.  `epsilon` has to be small beside the faces.  In each round a face takes one point at most, the one with the least pid of
    those that need it; the others look for themselves among the pieces.  So a round costs the mesh once, and there are
    as many as points that depend on each other, not as points.
    """
    top = faces.agg(F.max("fid").alias("f")).crossJoin(vertices.agg(F.max("vid").alias("v"))).first()
    first, base = (top["f"] or 0) + 1, (top["v"] or 0) + 1
    here = stage(faces.select("fid", "u", "v", "w"))
    spots = stage(vertices.select("vid", "x", "y", "z", F.lit(False).alias("added")))
    waiting, seen = counted_stage(points.select("pid", "x", "y", "fid"), n=F.count(F.lit(1)))
    placed = [points.select("pid", F.lit(None).cast("long").alias("vid")).limit(0)]
    gone = [here.limit(0)]
    near = F.lit(epsilon)
    for _ in range(most_rounds):
        if not seen["n"]:
            break
        corner = lambda c: F.struct(F.sqrt((F.col("x") - F.col(f"{c}x")) ** 2 + (F.col("y") - F.col(f"{c}y")) ** 2).alias("d"), F.col(c).alias("vid"))
        side = lambda a, b: F.struct(geo.segment_distance(*[F.col(f"{c}{k}") for c in (a, b) for k in "xy"], F.col("x"), F.col("y")).alias("d"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        looked = _with_corners(waiting.join(here, "fid"), spots).select("*", F.least(*map(corner, "uvw")).alias("corner"), F.least(side("u", "v"), side("v", "w"), side("w", "u")).alias("side"))
        share = shares(F.col("x"), F.col("y"))
        in_face = share["u"] * F.col("uz") + share["v"] * F.col("vz") + share["w"] * F.col("wz")
        # On a side: between its ends, by the foot of the point.
        along = lambda a, b: F.col(f"{a}z") + (F.col(f"{b}z") - F.col(f"{a}z")) * ((F.col("x") - F.col(f"{a}x")) * (F.col(f"{b}x") - F.col(f"{a}x")) + (F.col("y") - F.col(f"{a}y")) * (F.col(f"{b}y") - F.col(f"{a}y"))) / ((F.col(f"{b}x") - F.col(f"{a}x")) ** 2 + (F.col(f"{b}y") - F.col(f"{a}y")) ** 2)
        is_side = lambda a, b: (F.col("side.a") == F.least(a, b)) & (F.col("side.b") == F.greatest(a, b))
        on_side = F.when(is_side("u", "v"), along("u", "v")).when(is_side("v", "w"), along("v", "w")).otherwise(along("w", "u"))
        kind = F.when(F.col("corner.d") <= near, "corner").when(F.col("side.d") <= near, "side").otherwise("face")
        looked = stage(looked.select("pid", "x", "y", "fid", kind.alias("kind"), F.col("corner.vid").alias("vid"), F.col("side.a").alias("a"), F.col("side.b").alias("b"), F.when(kind == "side", on_side).otherwise(in_face).alias("z")))
        placed.append(looked.where("kind = 'corner'").select("pid", "vid"))
        cuts = looked.where("kind <> 'corner'")
        sides = here.select("fid", F.explode(F.array(*[F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("u", "v"), ("v", "w"), ("w", "u"))])).alias("s")).select(F.col("fid").alias("cut"), "s.a", "s.b")
        claims = stage(cuts.where("kind = 'face'").select("pid", F.col("fid").alias("cut")).unionByName(cuts.where("kind = 'side'").join(sides, ["a", "b"]).select("pid", "cut")))
        least = claims.groupBy("cut").agg(F.min("pid").alias("won"))
        wins = claims.join(least, "cut").groupBy("pid").agg(F.min(F.col("won") == F.col("pid")).alias("all"), F.min("cut").alias("low")).where("all").select("pid", "low")
        done = claims.join(wins, "pid").join(cuts.select("pid", "kind", "a", "b"), "pid").join(here.withColumnRenamed("fid", "cut"), "cut")
        new = F.col("pid") + base
        number = lambda k: F.lit(first) + F.col("pid") * 4 + F.when(F.col("cut") > F.col("low"), 2).otherwise(0) + k
        piece = lambda k, u, v, w: F.struct(number(k).alias("fid"), u.alias("u"), v.alias("v"), w.alias("w"))
        split = lambda a, b, c: F.array(piece(0, F.col(a), new, F.col(c)), piece(1, new, F.col(b), F.col(c)))
        here_side = lambda a, b: (F.col("a") == F.least(a, b)) & (F.col("b") == F.greatest(a, b))
        halves = F.when(here_side("u", "v"), split("u", "v", "w")).when(here_side("v", "w"), split("v", "w", "u")).otherwise(split("w", "u", "v"))
        thirds = F.array(piece(0, F.col("u"), F.col("v"), new), piece(1, F.col("v"), F.col("w"), new), piece(2, F.col("w"), F.col("u"), new))
        pieces = stage(done.select("pid", "cut", F.explode(F.when(F.col("kind") == "side", halves).otherwise(thirds)).alias("p")).select("cut", "p.*"))
        grown = cuts.join(wins, "pid").select("pid", new.alias("vid"), "x", "y", "z")
        placed.append(grown.select("pid", "vid"))
        spots = stage(spots.unionByName(grown.select("vid", "x", "y", "z", F.lit(True).alias("added"))))
        cut_up = pieces.select(F.col("cut").alias("fid")).distinct()
        gone.append(here.where(F.col("fid") < first).join(cut_up, "fid", "left_semi"))
        rest = cuts.join(wins, "pid", "left_anti").select("pid", "x", "y", "fid")
        among = _with_corners(rest.withColumnRenamed("fid", "cut").join(pieces, "cut"), spots)
        inner = shares(F.col("x"), F.col("y"))
        # The piece that a point lies deepest in; rounding can't leave it without one.
        moved = among.groupBy("pid").agg(F.min(F.struct((-F.least(*inner.values())).alias("out"), "fid")).alias("m")).select("pid", F.col("m.fid").alias("piece"))
        waiting, seen = counted_stage(rest.join(moved, "pid", "left").select("pid", "x", "y", F.coalesce("piece", "fid").alias("fid")), n=F.count(F.lit(1)))
        here = stage(here.join(cut_up, "fid", "left_anti").unionByName(pieces.select("fid", "u", "v", "w")))
    else:
        raise RuntimeError("points are left over")
    union = lambda parts: parts[0] if len(parts) == 1 else union([parts[0].unionByName(parts[1]), *parts[2:]])
    return Inserted(here, spots, stage(union(placed)), stage(union(gone)), first)
