"""Routes drawn on a mesh: traces along its sides, drawn taut over its faces."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage
from . import paths as P
from .edges import mirrored

#: Side lengths are counted in these parts, so that ties are exact.
UNIT = 1_000_000


def mesh_sides(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """a < b, w: the mesh's sides and their lengths, in whole units."""
    side = F.explode(F.array(*[F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in (("u", "v"), ("v", "w"), ("w", "u"))]))
    out = faces.select(side.alias("s")).select("s.a", "s.b").distinct()
    for c in "ab":
        out = out.join(vertices.select(F.col("vid").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyz"]), c)
    length = F.sqrt(sum(((F.col(f"a{k}") - F.col(f"b{k}")) ** 2 for k in "yz"), (F.col("ax") - F.col("bx")) ** 2))
    return out.select("a", "b", F.greatest(F.lit(1), F.round(length * UNIT)).cast("long").alias("w"))


def traces(ways: DataFrame, adjacent: DataFrame) -> DataFrame:
    """route_id, path: the shortest way along the sides from each place of a route to the next, put together, without loops.

    ways: route_id, stops (vertices).  Distances are found from the stops only.  A route with a stop that can't be reached goes.
    """
    legs = stage(P.hops(ways, ["route_id"], "stops"))
    distances = P.closure(adjacent, legs.select(F.col("u").alias("id")).distinct())
    before = stage(P.predecessors(distances, adjacent))
    asked = legs.select(F.col("u").alias("s"), F.col("v").alias("t")).distinct()
    reached = asked.join(distances.select("s", "t"), ["s", "t"], "left_semi")
    found = P.walked_back(reached, before)
    steps = legs.join(found.select(F.col("s").alias("u"), F.col("t").alias("v"), "route"), ["u", "v"], "left")
    whole = steps.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "route"))).alias("parts"), F.max(F.col("route").isNull()).alias("lost")).where("not lost")
    joined = F.flatten(F.transform("parts", lambda p: F.when(p["pos"] == F.col("parts")[0]["pos"], p["route"]).otherwise(F.slice(p["route"], 2, F.size(p["route"])))))
    return whole.select("route_id", P.remove_loops(joined).alias("path"))


def corridors(lines: DataFrame, faces: DataFrame, vertices: DataFrame, cell: float = 0.125) -> DataFrame:
    """route_id, u, v, w: the faces that a way no longer than the trace may touch, which lie in an ellipse around its ends.

    lines: route_id, path, length.  Routes and faces meet in square cells of the ellipse's box.
    """
    ends = lines.select("route_id", "length", F.element_at("path", 1).alias("s"), F.element_at("path", -1).alias("t"))
    for c in "st":
        ends = ends.join(vertices.select(F.col("vid").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyz"]), c)
    corner = faces
    for c in "uvw":
        corner = corner.join(vertices.select(F.col("vid").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyz"]), c)
    apart = lambda p, q: F.sqrt(sum(((F.col(f"{p}{k}") - F.col(f"{q}{k}")) ** 2 for k in "yz"), (F.col(f"{p}x") - F.col(f"{q}x")) ** 2))
    corner = corner.withColumn("longest", F.greatest(apart("u", "v"), apart("v", "w"), apart("w", "u")))
    at = lambda c: F.floor(c / cell)
    spread = lambda k: F.explode(F.sequence(at(F.least(f"u{k}", f"v{k}", f"w{k}")), at(F.greatest(f"u{k}", f"v{k}", f"w{k}"))))
    box = lambda k: F.explode(F.sequence(at((F.col(f"s{k}") + F.col(f"t{k}") - F.col("length")) / 2), at((F.col(f"s{k}") + F.col(f"t{k}") + F.col("length")) / 2)))
    met = ends.withColumn("ci", box("x")).withColumn("cj", box("y")).join(corner.withColumn("ci", spread("x")).withColumn("cj", spread("y")), ["ci", "cj"])
    near = F.least(*[apart(c, "s") + apart(c, "t") for c in "uvw"])
    return met.where(near <= F.col("length") + 2 * F.col("longest")).select("route_id", "u", "v", "w", *[f"{c}{k}" for c in "uvw" for k in "xyz"]).distinct()


def taut(path: list[int], faces: np.ndarray, at: dict[int, np.ndarray]) -> list[np.ndarray]:
    """The points of a locally shortest way between the path's ends, which is never longer than the path.

    The path's neighbouring faces are a strip; unrolled into a plane, it has one shortest way, which may touch corners. Where going round the other
    side of such a corner is shorter, the strip moves there, until nowhere is.
    """
    straight = [at[path[0]], at[path[-1]]]
    left_of: dict[tuple[int, int], int] = {}
    for k, (u, v, w) in enumerate(faces.tolist()):
        left_of[u, v] = left_of[v, w] = left_of[w, u] = k
    corners = [tuple(f) for f in faces.tolist()]

    def around(m: int, face: int, goal: int, way: int) -> list[int] | None:
        """The faces around corner m from one to another, counter-clockwise (1) or clockwise (-1); None over the border."""
        out = [face]
        while out[-1] != goal:
            f = corners[out[-1]]
            i = f.index(m)
            after = left_of.get((m, f[i - 1])) if way > 0 else left_of.get((f[(i + 1) % 3], m))
            if after is None or after == face:
                return None
            out.append(after)
        return out

    def angle(m: int, strip: list[int]) -> float:
        total = 0.0
        for k in strip:
            f = corners[k]
            i = f.index(m)
            a, b = at[f[(i + 1) % 3]] - at[m], at[f[(i + 2) % 3]] - at[m]
            total += math.acos(max(-1.0, min(1.0, float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)))))
        return total

    def tidy(strip: list[int]) -> list[int]:
        """Without loops, from the last face at the start to the first one after it at the end."""
        seen: dict[int, int] = {}
        out: list[int] = []
        for k in strip:
            if k in seen:
                for gone in out[seen[k] + 1 :]:
                    del seen[gone]
                del out[seen[k] + 1 :]
            else:
                seen[k] = len(out)
                out.append(k)
        a = max(i for i, k in enumerate(out) if path[0] in corners[k])
        b = next((i for i in range(a, len(out)) if path[-1] in corners[out[i]]), None)
        return out[a : b + 1] if b is not None else []

    def unrolled(strip: list[int]) -> tuple[float, list[np.ndarray], list[tuple[int, int]]]:
        """(length, points, touched) of the shortest way through the strip; touched: corners, and the place in the strip of the side where it meets them."""
        flat: dict[int, complex] = {}
        gap = lambda x, y: float(np.linalg.norm(at[x] - at[y]))

        def place(c: int, x: int, y: int, side: int) -> complex:
            """Corner c on one side (1: left) of the line from x to y."""
            p, q, d = flat[x], flat[y], gap(x, y)
            along = (gap(c, x) ** 2 - gap(c, y) ** 2 + d * d) / (2 * d)
            up = math.sqrt(max(0.0, gap(c, x) ** 2 - along * along))
            return p + (q - p) / d * complex(along, side * up)

        gates = []
        first = corners[strip[0]]
        i = first.index(path[0])
        x, y = first[(i + 1) % 3], first[(i + 2) % 3]
        flat[path[0]], flat[x] = 0j, complex(gap(path[0], x), 0)
        flat[y] = place(y, path[0], x, 1)
        spots = [flat[path[0]]]
        for f, g in zip(strip, strip[1:]):
            a, b = next((p, q) for p, q in zip(corners[f], corners[f][1:] + corners[f][:1]) if left_of.get((q, p)) == g)
            gates.append((b, a, flat[b], flat[a]))  # left and right, as one leaves the face
            c = next(p for p in corners[g] if p != a and p != b)
            # A corner may come again further on: its newest place is the one that counts.
            flat[c] = place(c, a, b, -1)
        goal = flat[path[-1]]
        cross = lambda o, p, q: ((p - o).conjugate() * (q - o)).imag
        rows = [*gates, (path[-1], path[-1], goal, goal)]
        apex, l_at, r_at, touched, turns = spots[0], 0, 0, [], [(0j, -1)]
        left, right, k = rows[0][2], rows[0][3], 1
        while k < len(rows):
            _, _, l_new, r_new = rows[k]
            if cross(apex, right, r_new) >= 0:
                if apex == right or cross(apex, left, r_new) <= 0:
                    right, r_at = r_new, k
                else:
                    apex, back = left, l_at
                    touched.append((rows[l_at][0], l_at))
                    turns.append((apex, l_at))
                    k = l_at = r_at = back + 1
                    left, right = rows[k][2], rows[k][3]
                    k += 1
                    continue
            if cross(apex, left, l_new) <= 0:
                if apex == left or cross(apex, right, l_new) >= 0:
                    left, l_at = l_new, k
                else:
                    apex, back = right, r_at
                    touched.append((rows[r_at][1], r_at))
                    turns.append((apex, r_at))
                    k = l_at = r_at = back + 1
                    left, right = rows[k][2], rows[k][3]
                    k += 1
                    continue
            k += 1
        turns.append((goal, len(rows) - 1))
        length, points = 0.0, [at[path[0]]]
        for (p, a), (q, b) in zip(turns, turns[1:]):
            length += abs(q - p)
            for g in range(a + 1, b):
                x, y, fx, fy = rows[g]
                d = cross(0j, q - p, fy - fx)
                share = 0.5 if d == 0 else min(1.0, max(0.0, cross(0j, q - p, p - fx) / d))
                points.append(at[x] + (at[y] - at[x]) * share)
            last = rows[b]
            points.append(at[last[0]] if q == last[2] else at[last[1]])
        return length, points, touched

    if len(path) < 3:
        return straight if len(path) == 2 else straight[:1]
    strip: list[int] = []
    for a, m, b in zip(path, path[1:], path[2:]):
        sides = []
        for way, start, end in ((-1, left_of.get((a, m)), left_of.get((m, b))), (1, left_of.get((m, a)), left_of.get((b, m)))):
            fan = around(m, start, end, way) if start is not None and end is not None else None
            if fan:
                sides.append((angle(m, fan), fan))
        if not sides:
            return [at[x] for x in path]
        strip += min(sides)[1]
    strip = tidy(strip)
    if not strip:
        return [at[x] for x in path]
    best = unrolled(strip)
    moved = True
    while moved:
        moved = False
        for m, gate in best[2]:
            a = b = gate
            while a > 0 and m in corners[strip[a - 1]]:
                a -= 1
            while b + 1 < len(strip) and m in corners[strip[b + 1]]:
                b += 1
            for way in (1, -1):
                other = around(m, strip[a], strip[b], way)
                if other is None or other == strip[a : b + 1]:
                    continue
                candidate = tidy(strip[:a] + other + strip[b + 1 :])
                found = unrolled(candidate) if candidate else None
                if found and found[0] < best[0] * (1 - 1e-12):
                    strip, best, moved = candidate, found, True
                    break
            if moved:
                break
    return best[1]


def polylines(ways: DataFrame, faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """route_id, trace, length, points (array of x, y, z): each route as a taut line on the mesh.

    ways: route_id, stops (vertices); faces: u, v, w, all with one orientation; vertices: vid, x, y, z.  `trace` is the length along the mesh's sides, which
    `length` never exceeds.  Only the ends are held.  Of each route only the faces that a shorter way could touch come together.
    Routes that the mesh doesn't connect go; one whose stops are one vertex has a single point and no length.
    """
    sides = stage(mesh_sides(faces, vertices))
    found = stage(traces(ways, stage(mirrored(sides))))
    at = found.select("route_id", F.posexplode("path").alias("pos", "vid")).join(vertices.select("vid", "x", "y", "z"), "vid")
    spots = stage(at.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "vid", "x", "y", "z"))).alias("p")))
    step = F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), F.slice("p", 2, F.size("p")), lambda a, b: F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2))
    lines = stage(spots.select("route_id", F.col("p.vid").alias("path"), F.col("p.x").alias("px"), F.col("p.y").alias("py"), F.col("p.z").alias("pz"), F.aggregate(step, F.lit(0.0), lambda s, x: s + x).alias("length")))
    near = corridors(lines, faces, vertices)
    near = near.select(*[F.col(c).alias(c) for c in near.columns])  # columns of their own, for the cogroup

    def draw(key: tuple, line: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if not len(line):
            return pd.DataFrame({"route_id": [], "trace": [], "length": [], "points": []})
        one = line.iloc[0]
        spots = {int(v): np.array(p) for v, *p in zip(one["path"], one["px"], one["py"], one["pz"])}
        for c in "uvw":
            spots |= {int(v): np.array(p) for v, *p in zip(*(near[n] for n in (c, f"{c}x", f"{c}y", f"{c}z")))}
        points = np.array(taut([int(v) for v in one["path"]], near[["u", "v", "w"]].to_numpy(dtype=int).reshape(-1, 3), spots))
        length = float(np.linalg.norm(np.diff(points, axis=0), axis=1).sum())
        return pd.DataFrame({"route_id": [key[0]], "trace": [one["length"]], "length": [length], "points": [[dict(zip("xyz", p)) for p in points.tolist()]]})

    kind = dict(lines.dtypes)["route_id"]
    return lines.groupBy("route_id").cogroup(near.groupBy("route_id")).applyInPandas(draw, f"route_id {kind}, trace double, length double, points array<struct<x: double, y: double, z: double>>")
