"""Triangle meshes as tables: topology, areas, Laplacian, curvatures, losses, and points on them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.geo import lit
from ..plans.stage import stage
from .clusters import components


def grid(spark: SparkSession, width: int, height: int, z: Column | None = None, scale: float = 1.0) -> DataFrame:
    """vid, i, j, x, y, z, border of a rectangular grid; z may use x and y."""
    v = spark.range(width * height).select(F.col("id").alias("vid"), F.expr(f"id div {height}").alias("i"), (F.col("id") % height).alias("j"))
    v = v.withColumns({"x": F.col("i") / lit(width - 1) * scale, "y": F.col("j") / lit(height - 1) * scale})
    border = (F.col("i") == 0) | (F.col("j") == 0) | (F.col("i") == width - 1) | (F.col("j") == height - 1)
    return v.withColumn("z", z if z is not None else lit(0)).withColumn("border", border)


def faces(spark: SparkSession, width: int, height: int) -> DataFrame:
    """fid, u, v, w: two triangles for each cell, split along its main diagonal."""
    cell = spark.range((width - 1) * (height - 1)).select(F.col("id").alias("c"), F.expr(f"id div {height - 1}").alias("i"), (F.col("id") % (height - 1)).alias("j"))
    at = lambda di, dj: (F.col("i") + di) * height + F.col("j") + dj
    tri = lambda k, a, b, c: F.struct((F.col("c") * 2 + k).alias("fid"), a.alias("u"), b.alias("v"), c.alias("w"))
    both = F.array(tri(0, at(0, 0), at(1, 1), at(0, 1)), tri(1, at(0, 0), at(1, 0), at(1, 1)))
    return cell.select(F.explode(both).alias("t")).select("t.*")


def placed_faces(found: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with their corners' coordinates, normal (n) and area."""
    out = found
    for c in "uvw":
        out = out.join(vertices.select(F.col("vid").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyz"], F.col("border").alias(f"{c}b")), c)
    a = [F.col(f"u{k}") - F.col(f"w{k}") for k in "xyz"]
    b = [F.col(f"v{k}") - F.col(f"w{k}") for k in "xyz"]
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    out = out.withColumns({f"n{k}": c for k, c in zip("xyz", n)})
    return out.withColumn("area", F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz")) / 2)


def halfedges(placed: DataFrame) -> DataFrame:
    """One row for each half-edge: origin o, destination d, opposite corner p, with coordinates, area and cotangent at p."""
    turn = lambda o, d, p: F.struct(*[F.col(c).alias(n) for c, n in ((o, "o"), (d, "d"), (p, "p"))], *[F.col(f"{c}{k}").alias(f"{n}{k}") for c, n in ((o, "o"), (d, "d"), (p, "p")) for k in "xyzb"])
    rows = placed.select("fid", "area", "nx", "ny", "nz", F.explode(F.array(turn("u", "v", "w"), turn("v", "w", "u"), turn("w", "u", "v"))).alias("h")).select("fid", "area", "nx", "ny", "nz", "h.*")
    dot = sum(((F.col(f"o{k}") - F.col(f"p{k}")) * (F.col(f"d{k}") - F.col(f"p{k}")) for k in "yz"), (F.col("ox") - F.col("px")) * (F.col("dx") - F.col("px")))
    return rows.withColumn("cot", dot / (2 * F.col("area")))


def vertex_areas(half: DataFrame) -> DataFrame:
    """vid, area: a third of each face around it."""
    return half.groupBy(F.col("o").alias("vid")).agg((F.sum("area") / 3).alias("area"))


def edge_laplacian(half: DataFrame) -> DataFrame:
    """a, b, weight, inner: half the cotangents across each edge; `inner` where neither end is on the border."""
    inner = ~(F.col("ob") | F.col("db"))
    return half.groupBy(F.least("o", "d").alias("a"), F.greatest("o", "d").alias("b"), inner.alias("inner")).agg((F.sum("cot") / 2).alias("weight"))


def gaussian_curvature(half: DataFrame) -> DataFrame:
    """vid, kappa: the angle defect by area; 0 on the border."""
    angle = F.acos(F.col("cot") / F.sqrt(1 + F.col("cot") * F.col("cot")))
    around = half.groupBy(F.col("p").alias("vid"), F.col("pb").alias("border")).agg(F.sum(angle).alias("angles"), (F.sum("area") / 3).alias("area"))
    return around.select("vid", F.when(F.col("border"), 0.0).otherwise((lit(2 * math.pi) - F.col("angles")) / F.col("area")).alias("kappa"))


def principal_curvatures(half: DataFrame) -> DataFrame:
    """vid, kappa, mean, first, second.

    Each vertex's area, angles, normal and mean curvature normal come from one pass over its half-edges.
    """
    angle = F.acos(F.col("cot") / F.sqrt(1 + F.col("cot") * F.col("cot")))
    side = lambda end, other, s: F.struct(F.col(end).alias("vid"), F.col(f"{end}b").alias("border"), lit(0).alias("angle"), lit(0).alias("own"), *[lit(0).alias(f"n{k}") for k in "xyz"], *[(F.col("cot") / 2 * (F.col(f"{end}{k}") - F.col(f"{other}{k}"))).alias(f"m{k}") for k in "xyz"])
    corner = F.struct(F.col("p").alias("vid"), F.col("pb").alias("border"), angle.alias("angle"), F.col("area").alias("own"), *[F.col(f"n{k}").alias(f"n{k}") for k in "xyz"], *[lit(0).alias(f"m{k}") for k in "xyz"])
    rows = half.select(F.explode(F.array(corner, side("o", "d", 1), side("d", "o", 1))).alias("r")).select("r.*")
    v = rows.groupBy("vid", "border").agg(F.sum("angle").alias("angles"), (F.sum("own") / 3).alias("area"), *[F.sum(f"{c}{k}").alias(f"{c}{k}") for c in "nm" for k in "xyz"])
    length = F.sqrt(F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz")) / (2 * F.col("area"))
    facing = F.signum(F.col("mx") * F.col("nx") + F.col("my") * F.col("ny") + F.col("mz") * F.col("nz"))
    v = v.withColumn("kappa", F.when(F.col("border"), 0.0).otherwise((lit(2 * math.pi) - F.col("angles")) / F.col("area"))).withColumn("mean", F.when(F.col("border"), 0.0).otherwise(length * facing))
    off = F.sqrt(F.greatest(lit(0), F.col("mean") * F.col("mean") - F.col("kappa")))
    return v.select("vid", "kappa", "mean", (F.col("mean") + off).alias("first"), (F.col("mean") - off).alias("second"))


def smooth_loss(half: DataFrame, placed: DataFrame) -> DataFrame:
    """loss: minus the interior Laplacian's forms of both principal curvatures, times the whole area."""
    k = principal_curvatures(half).select("vid", "first", "second")
    e = edge_laplacian(half).where("inner")
    a, b = (k.select(F.col("vid").alias(n), F.col("first").alias(f"f{n}"), F.col("second").alias(f"s{n}")) for n in "ab")
    # w (x_a - x_b)^2 is what an edge and its share of both vertices' entries add up to.
    form = F.col("weight") * ((F.col("fa") - F.col("fb")) * (F.col("fa") - F.col("fb")) + (F.col("sa") - F.col("sb")) * (F.col("sa") - F.col("sb")))
    return e.join(a, "a").join(b, "b").agg(F.sum(form).alias("form")).crossJoin(placed.agg(F.sum("area").alias("area"))).select((F.col("form") * F.col("area")).alias("loss"))


def points_near_segments(points: DataFrame, segments: DataFrame, epsilon: float) -> DataFrame:
    """pid, sid, distance where a point is nearer than epsilon to a segment.

    points: pid, x, y; segments: sid, ux, uy, vx, vy.  Points fall into square cells; a segment goes to the
    cells of its box, widened by epsilon, so that only cells in common are compared.
    """
    side = 4 * epsilon
    cell = lambda c: F.floor(c / side)
    p = points.select("pid", "x", "y", cell(F.col("x")).alias("ci"), cell(F.col("y")).alias("cj"))
    span = lambda a, b: F.explode(F.sequence(cell(F.least(a, b) - epsilon), cell(F.greatest(a, b) + epsilon)))
    s = segments.withColumn("ci", span("ux", "vx")).withColumn("cj", span("uy", "vy"))
    d = geo.segment_distance(*[F.col(c) for c in ("ux", "uy", "vx", "vy", "x", "y")])
    return p.join(s, ["ci", "cj"]).select("pid", "sid", d.alias("distance")).where(F.col("distance") < epsilon)


def curvature_loss(fat: DataFrame, kappa: DataFrame, targets: DataFrame) -> DataFrame:
    """loss: over segments, weighted by length, the mean squared difference of their vertices' curvature to the target.

    fat: pid, sid; kappa: vid, kappa; targets: sid, target, length.  Weights are shares of all lengths; segments without a
    target or vertices add nothing.
    """
    whole = targets.agg(F.sum("length").alias("whole"))
    parts = fat.join(kappa, fat["pid"] == kappa["vid"]).join(targets.where("target is not null"), "sid").groupBy("sid", "length").agg(F.avg((F.col("kappa") - F.col("target")) * (F.col("kappa") - F.col("target"))).alias("miss"))
    return parts.crossJoin(F.broadcast(whole)).agg(F.sum(F.col("miss") * F.col("length") / F.col("whole")).alias("loss"))


def nearest_grid_vertex(points: DataFrame, width: int, height: int) -> DataFrame:
    """pid, vid: the nearest vertex of a unit grid, the smallest index on ties; its cell's corners are all that can be."""
    fx, fy = F.col("x") * (width - 1), F.col("y") * (height - 1)
    near = lambda f, n: F.array(F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), F.floor(f))), F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), F.floor(f) + 1)))
    rows = points.select("pid", "x", "y", F.explode(near(fx, width)).alias("i"), near(fy, height).alias("js")).select("pid", "x", "y", "i", F.explode("js").alias("j"))
    dx, dy = F.col("x") - F.col("i") / lit(width - 1), F.col("y") - F.col("j") / lit(height - 1)
    return rows.groupBy("pid").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), (F.col("i") * height + F.col("j")).alias("vid"))).alias("b")).select("pid", "b.vid")


def locate(points: DataFrame, found: DataFrame, vertices: DataFrame, height: int, width: int) -> DataFrame:
    """pid, fid: the first face of a unit grid that holds each point (borders included)."""
    ci = F.least(F.lit(width - 2).cast("long"), F.floor(F.col("x") * (width - 1)))
    cj = F.least(F.lit(height - 2).cast("long"), F.floor(F.col("y") * (height - 1)))
    near = F.explode(F.array(*[F.struct((ci + a).alias("i"), (cj + b).alias("j")) for a in (-1, 0) for b in (-1, 0)]))
    cells = points.select("pid", "x", "y", near.alias("c")).where("c.i >= 0 and c.j >= 0").select("pid", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.array(*[(F.col("c.i") * (height - 1) + F.col("c.j")) * 2 + k for k in (0, 1)])).alias("fid"))
    flat = found
    for c in "uvw":
        flat = flat.join(vertices.select(F.col("vid").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")), c)
    inside = geo.in_triangle(*[F.col(f"{c}{k}") for c in "uvw" for k in "xy"], F.col("px"), F.col("py"))
    return cells.join(flat, "fid").where(inside).groupBy("pid").agg(F.min("fid").alias("fid"))


def in_polygons(points: DataFrame, polygons: DataFrame, band: float = 0.05) -> DataFrame:
    """pid, inside: whether a point lies in some polygon, borders included, by the parity of crossings to its right.

    polygons: gid, pos, x, y in order around.  Points meet only sides in their band of y; one that meets none is outside.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("gid").orderBy("pos")
    whole = Window.partitionBy("gid").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = polygons.select("gid", F.col("x").alias("ux"), F.col("y").alias("uy"), F.coalesce(F.lead("x").over(order), F.first("x").over(whole)).alias("vx"), F.coalesce(F.lead("y").over(order), F.first("y").over(whole)).alias("vy"))
    level = (F.col("uy") == F.col("y")) | (F.col("vy") == F.col("y"))
    cross_x = F.col("ux") + (F.col("y") - F.col("uy")) / (F.col("vy") - F.col("uy")) * (F.col("vx") - F.col("ux"))
    crosses = ~level & ((F.col("uy") > F.col("y")) != (F.col("vy") > F.col("y")))
    corner = F.col("uy") == F.col("y")
    right = F.when(corner & (F.col("ux") > F.col("x")), 1).otherwise(0) + F.when(crosses, F.when(cross_x > F.col("x"), 1).otherwise(0)).otherwise(0)
    border = (corner & (F.col("ux") == F.col("x"))) | F.coalesce(F.when(crosses, cross_x == F.col("x")), F.lit(False))
    at = lambda c: F.floor(c / band)
    spread = sides.withColumn("band", F.explode(F.sequence(at(F.least("uy", "vy")), at(F.greatest("uy", "vy")))))
    per = points.withColumn("band", at(F.col("y"))).join(spread, "band").groupBy("pid", "gid").agg(F.sum(right).alias("n"), F.max(border).alias("on"))
    met = per.groupBy("pid").agg(F.max(F.col("on") | (F.col("n") % 2 == 1)).alias("inside"))
    return points.select("pid").distinct().join(met, "pid", "left").select("pid", F.coalesce("inside", F.lit(False)).alias("inside"))


def crossings(segments: DataFrame, cell: float = 0.1) -> DataFrame:
    """s1 < s2 and the share of s1 where they cross; only segments whose boxes share a cell are compared."""
    k = lambda c: F.floor(c / cell)
    span = lambda a, b: F.explode(F.sequence(k(F.least(a, b)), k(F.greatest(a, b))))
    s = segments.withColumn("ci", span("ux", "vx")).withColumn("cj", span("uy", "vy"))
    a, b = (s.select(F.col("sid").alias(f"s{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("ux", "uy", "vx", "vy")], "ci", "cj") for n in (1, 2))
    share = geo.crossing(*[F.col(f"{c}{n}") for n in (1, 2) for c in ("ux", "uy", "vx", "vy")])
    return a.join(b, ["ci", "cj"]).where("s1 < s2").select("s1", "s2", share.alias("share")).where("share is not null").distinct()


def holes(found: DataFrame, vertices: DataFrame, kept: DataFrame) -> DataFrame:
    """hole, vid, on_border: islands of faces that have a corner outside `kept`, as their vertices; faces touch by their sides.

    A hole's name is its least face; found: fid, u, v, w; vertices: vid, border; kept: vid.
    """
    corners = found.select("fid", F.explode(F.array("u", "v", "w")).alias("vid"))
    left = stage(found.join(corners.join(kept, "vid", "left_anti").select("fid").distinct(), "fid", "left_semi"))
    side = lambda a, b: F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    sides = left.select("fid", F.explode(F.array(side("u", "v"), side("v", "w"), side("u", "w"))).alias("side"))
    # Two faces meet at a side, three or more on no surface: each is tied to the side's least face.
    tied = sides.groupBy("side").agg(F.min("fid").alias("a"), F.max("fid").alias("b")).where("a < b").select("a", "b").distinct()
    islands = components(left.select(F.col("fid").alias("id")), tied).select(F.col("id").alias("fid"), F.col("component").alias("hole"))
    own = left.select("fid", F.explode(F.array("u", "v", "w")).alias("vid")).join(islands, "fid").select("hole", "vid").distinct()
    return own.join(vertices.select("vid", F.col("border").alias("on_border")), "vid")
