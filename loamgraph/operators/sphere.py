"""Meshes of the sphere: an icosahedron's faces cut into f x f triangles and projected from the centre.

A vertex is (face, i, j): the point with weights f - i - j, i and j at the face's three corners.  Vertices on sides and
corners have one number whatever face they are seen from, so that nothing has to be merged by position.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import lit


def icosahedron() -> tuple[list[tuple[float, float, float]], list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Corners of length 1, sides a < b, and faces a < b < c or turned so that they run counterclockwise from outside."""
    golden = (1 + math.sqrt(5)) / 2
    long = math.sqrt(1 + golden * golden)
    base = [(0.0, s / long, t * golden / long) for s in (1, -1) for t in (1, -1)]
    corners = [p[-k:] + p[:-k] if k else p for k in range(3) for p in base]
    touch = lambda a, b: math.dist(corners[a], corners[b]) < 2.1 / long
    sides = [(a, b) for a, b in itertools.combinations(range(12), 2) if touch(a, b)]
    found = []
    for a, b, c in itertools.combinations(range(12), 3):
        if touch(a, b) and touch(b, c) and touch(a, c):
            found.append((a, b, c) if _volume(corners[a], corners[b], corners[c]) > 0 else (a, c, b))
    return corners, sides, found


def _volume(a, b, c) -> float:
    return a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])


def _faces(spark: SparkSession) -> DataFrame:
    """t, corners a, b, c with coordinates, and for each side its number and whether it runs against the side's own order: 20 rows."""
    corners, sides, found = icosahedron()
    number = {s: k for k, s in enumerate(sides)}
    rows = []
    for t, (a, b, c) in enumerate(found):
        ends = [(a, b), (b, c), (a, c)]
        rows.append((t, a, b, c, *corners[a], *corners[b], *corners[c], *[number[tuple(sorted(e))] for e in ends], *[e[0] > e[1] for e in ends]))
    xyz = ", ".join(f"{n}{k} double" for n in "abc" for k in "xyz")
    return spark.createDataFrame(rows, f"t long, a long, b long, c long, {xyz}, ab long, bc long, ac long, rab boolean, rbc boolean, rac boolean")


def _number(f: int, i: Column, j: Column) -> Column:
    """The vertex's number: corners first, then sides, then insides of faces."""
    k = F.lit(f) - i - j
    along = lambda side, turned, far: 12 + F.col(side) * (f - 1) + F.when(F.col(turned), F.lit(f) - far).otherwise(far) - 1
    # Row i of a face's inside starts after the rows before it, of f - 2, f - 3, ... vertices.
    inside = 12 + 30 * (f - 1) + F.col("t") * ((f - 1) * (f - 2) // 2) + ((i - 1) * (2 * f - 2 - i) / 2).cast("long") + j - 1
    return (
        F.when(k == f, F.col("a")).when(i == f, F.col("b")).when(j == f, F.col("c"))
        .when(j == 0, along("ab", "rab", i)).when(k == 0, along("bc", "rbc", j)).when(i == 0, along("ac", "rac", j)).otherwise(inside)
    )


def _place(f: int, i: Column, j: Column) -> list[Column]:
    at = [(F.lit(f) - i - j) * F.col(f"a{k}") + i * F.col(f"b{k}") + j * F.col(f"c{k}") for k in "xyz"]
    length = F.sqrt(sum((p * p for p in at[1:]), at[0] * at[0]))
    return [(p / length).alias(k) for p, k in zip(at, "xyz")]


def sphere_vertices(spark: SparkSession, f: int) -> DataFrame:
    """vid, x, y, z of the 10 f^2 + 2 vertices: each face gives its inside, and what it is the first to hold of sides and corners."""
    _, sides, found = icosahedron()
    first_side = {s: min(t for t, face in enumerate(found) if set(s) <= set(face)) for s in sides}
    first_corner = [min(t for t, face in enumerate(found) if c in face) for c in range(12)]
    own = spark.createDataFrame(
        [(t, *[first_corner[c] == t for c in (a, b, c3)], *[first_side[tuple(sorted(e))] == t for e in ((a, b), (b, c3), (a, c3))]) for t, (a, b, c3) in enumerate(found)],
        "t long, oa boolean, ob boolean, oc boolean, oab boolean, obc boolean, oac boolean",
    )
    i, j = F.col("i"), F.col("j")
    k = F.lit(f) - i - j
    owned = F.when(k == f, F.col("oa")).when(i == f, F.col("ob")).when(j == f, F.col("oc")).when(j == 0, F.col("oab")).when(k == 0, F.col("obc")).when(i == 0, F.col("oac")).otherwise(True)
    cells = _cells(spark, f, f + 1)
    return cells.where(i + j <= f).join(F.broadcast(_faces(spark)), "t").join(F.broadcast(own), "t").where(owned).select(_number(f, i, j).alias("vid"), *_place(f, i, j))


def _cells(spark: SparkSession, f: int, n: int) -> DataFrame:
    """t, i, j over all faces and an n x n square."""
    return spark.range(20 * n * n).select(F.expr(f"id div {n * n}").alias("t"), F.expr(f"id div {n} % {n}").alias("i"), (F.col("id") % n).alias("j"))


def sphere_faces(spark: SparkSession, f: int) -> DataFrame:
    """fid, u, v, w of the 20 f^2 faces, counterclockwise from outside; 2 ((t f + i) f + j), and 1 more if it points the other way."""
    i, j = F.col("i"), F.col("j")
    fid = ((F.col("t") * f + i) * f + j) * 2
    tri = lambda s, *p: F.struct((fid + s).alias("fid"), *[_number(f, i + di, j + dj).alias(n) for n, (di, dj) in zip("uvw", p)])
    up, down = tri(0, (0, 0), (1, 0), (0, 1)), tri(1, (1, 0), (1, 1), (0, 1))
    both = F.when(i + j < f - 1, F.array(up, down)).otherwise(F.array(up))
    return _cells(spark, f, f).where(i + j < f).join(F.broadcast(_faces(spark)), "t").select(F.explode(both).alias("r")).select("r.*")


def locate_on_sphere(points: DataFrame, f: int) -> DataFrame:
    """pid, fid: the face that the ray from the centre through x, y, z goes through (borders: the smallest); the centre itself has none.

    A point's weights at the corners of the icosahedron's 20 faces find its face; what is left is arithmetic, since the cuts
    are even on the flat face and projection keeps them.
    """
    rows = _weights(points, f)
    return rows.groupBy("pid").agg(F.min(F.struct("t", "i", "j", "down")).alias("m")).select("pid", (((F.col("m.t") * f + F.col("m.i")) * f + F.col("m.j")) * 2 + F.col("m.down").cast("long")).alias("fid"))


def _weights(points: DataFrame, f: int) -> DataFrame:
    """One row for each of the icosahedron's faces that holds a point: i, j and `down` of the small face, and the face's columns."""
    p = points.where("x * x + y * y + z * z > 0").select("pid", "x", "y", "z").crossJoin(F.broadcast(_faces(points.sparkSession)))
    dot = lambda m, n: (
        F.col("x") * (F.col(f"{m}y") * F.col(f"{n}z") - F.col(f"{m}z") * F.col(f"{n}y"))
        + F.col("y") * (F.col(f"{m}z") * F.col(f"{n}x") - F.col(f"{m}x") * F.col(f"{n}z"))
        + F.col("z") * (F.col(f"{m}x") * F.col(f"{n}y") - F.col(f"{m}y") * F.col(f"{n}x"))
    )
    p = p.withColumns({"wa": dot("b", "c"), "wb": dot("c", "a"), "wc": dot("a", "b")})
    near = lit(-1e-12) * F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    whole = F.col("wa") + F.col("wb") + F.col("wc")
    p = p.where((F.col("wa") >= near) & (F.col("wb") >= near) & (F.col("wc") >= near)).withColumns({"fi": F.greatest(lit(0), F.col("wb") / whole * f), "fj": F.greatest(lit(0), F.col("wc") / whole * f)})
    p = p.withColumn("i", F.least(F.floor("fi"), F.lit(f - 1).cast("long")))
    p = p.withColumn("j", F.least(F.floor("fj"), F.lit(f - 1) - F.col("i")))
    return p.withColumn("down", (F.col("fi") - F.col("i") + F.col("fj") - F.col("j") > 1) & (F.col("i") + F.col("j") < f - 1))


def nearest_on_sphere(points: DataFrame, f: int) -> DataFrame:
    """pid, vid, cosine: the vertex in the nearest direction, the smallest number on ties.

    No angle of a face is obtuse, so that the nearest vertex is a corner of the face that holds the point.
    """
    i, j = F.col("i"), F.col("j")
    rows = _weights(points, f)
    corner = lambda di, dj: F.struct(_number(f, i + di, j + dj).alias("vid"), *_place(f, i + di, j + dj))
    three = F.when(F.col("down"), F.array(corner(1, 0), corner(1, 1), corner(0, 1))).otherwise(F.array(corner(0, 0), corner(1, 0), corner(0, 1)))
    rows = rows.select("pid", "x", "y", "z", F.explode(three).alias("c"))
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    cosine = (F.col("x") * F.col("c.x") + F.col("y") * F.col("c.y") + F.col("z") * F.col("c.z")) / length
    best = rows.groupBy("pid").agg(F.min(F.struct((-cosine).alias("miss"), F.col("c.vid").alias("vid"))).alias("b"))
    return best.select("pid", "b.vid", (-F.col("b.miss")).alias("cosine"))


def swollen(vertices: DataFrame, parameters: DataFrame) -> DataFrame:
    """vid, x, y, z, border: each direction as long as exp(parameter), 1 where it has none; a closed surface has no border."""
    r = F.exp(F.coalesce("parameter", lit(0)))
    return vertices.join(parameters.select("vid", "parameter"), "vid", "left").select("vid", *[(F.col(k) * r).alias(k) for k in "xyz"], F.lit(False).alias("border"))


def near_arcs(vertices: DataFrame, arcs: DataFrame, epsilon: float) -> DataFrame:
    """vid, sid where a vertex's direction is nearer than epsilon (radians) to a great-circle arc or its ends.

    arcs: sid, ux, uy, uz, vx, vy, vz of length 1, not opposite; the shorter way between the ends counts.  Arcs are sampled at steps of at most epsilon; a vertex within
    epsilon of the arc lies in a cube next to a sample's, and only those pairs are compared.
    """
    side = 1.6 * epsilon
    cell = lambda c: F.floor(c / side)
    uv = F.least(lit(1), F.greatest(lit(-1), F.col("ux") * F.col("vx") + F.col("uy") * F.col("vy") + F.col("uz") * F.col("vz")))
    a = arcs.withColumn("uv", uv).withColumn("angle", F.acos("uv"))
    steps = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("angle") / epsilon))
    a = a.withColumn("steps", steps).withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps"))))
    share = F.col("s") / F.col("steps")
    left = F.when(F.col("angle") > 0, F.sin((1 - share) * F.col("angle")) / F.sin("angle")).otherwise(lit(1))
    right = F.when(F.col("angle") > 0, F.sin(share * F.col("angle")) / F.sin("angle")).otherwise(lit(0))
    a = a.withColumns({f"c{k}": cell(left * F.col(f"u{k}") + right * F.col(f"v{k}")) for k in "xyz"})
    for k in "xyz":
        a = a.withColumn(f"c{k}", F.explode(F.array(*[F.col(f"c{k}") + d for d in (-1, 0, 1)])))
    a = a.select("sid", "ux", "uy", "uz", "vx", "vy", "vz", "uv", "cx", "cy", "cz").distinct()
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    v = vertices.select("vid", *[(F.col(k) / length).alias(k) for k in "xyz"]).withColumns({f"c{k}": cell(F.col(k)) for k in "xyz"})
    both = v.join(a, ["cx", "cy", "cz"])
    ru = F.col("x") * F.col("ux") + F.col("y") * F.col("uy") + F.col("z") * F.col("uz")
    rv = F.col("x") * F.col("vx") + F.col("y") * F.col("vy") + F.col("z") * F.col("vz")
    cos = lit(math.cos(epsilon))
    # The cosine of the angle to the plane of the arc, and whether the foot on that plane lies between the ends.
    plane = F.sqrt((ru * ru + rv * rv - 2 * ru * rv * F.col("uv")) / (1 - F.col("uv") * F.col("uv")))
    between = (F.col("uv") < 1 - 1e-12) & (plane > cos) & (ru > rv * F.col("uv")) & (rv > ru * F.col("uv"))
    return both.where((F.greatest(ru, rv) > cos) | between).select("vid", "sid").distinct()
