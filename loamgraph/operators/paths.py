"""Shortest paths with deterministic ties, routes and what is computed along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import counted_stage, stage
from .edges import mirrored


def adjacency(edges: DataFrame, weight: str) -> DataFrame:
    """u, v, w in both directions.  Weights are whole and positive, so that ties are exact."""
    return mirrored(edges.select("a", "b", F.col(weight).alias("w")))


def closure(adjacent: DataFrame, nodes: DataFrame, by: list[str] | None = None, most_rounds: int = 1000) -> DataFrame:
    """s, t, d: the shortest distance of each pair that is connected, from the given nodes to all.

    Only pairs whose distance has just changed go on, one edge a round, until none does: pairs times degree in all, and
    as many rounds as the longest shortest path has hops.  Each round is written, so lineage stays one round long.  With `by`, graphs with
    different keys are closed side by side.
    """
    by = by or []
    key = [*by, "s", "t"]
    zero = nodes.select(*by, F.col("id").alias("s"), F.col("id").alias("t"), F.lit(0).cast("long").alias("d"))
    step = adjacent.select(*by, F.col("u").alias("s"), F.col("v").alias("t"), F.col("w").cast("long").alias("d")).join(nodes.select(*by, F.col("id").alias("s")), [*by, "s"], "left_semi")
    fresh = F.count(F.when(F.col("fresh"), 1))
    now, seen = counted_stage(zero.unionByName(step).groupBy(*key).agg(F.min("d").alias("d")).withColumn("fresh", F.col("s") != F.col("t")), n=fresh)
    links = adjacent.select(*by, F.col("u").alias("m"), F.col("v").alias("t"), F.col("w").cast("long").alias("w"))
    for _ in range(most_rounds):
        if not seen["n"]:
            return now.drop("fresh")
        longer = now.where("fresh").select(*by, "s", F.col("t").alias("m"), "d").join(links, [*by, "m"]).select(*key, (F.col("d") + F.col("w")).alias("d"), F.lit(None).cast("long").alias("old"))
        best = longer.unionByName(now.select(*key, "d", F.col("d").alias("old"))).groupBy(*key).agg(F.min("d").alias("d"), F.min("old").alias("old"))
        now, seen = counted_stage(best.select(*key, "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("fresh")), n=fresh)
    raise RuntimeError("distances did not settle")


def predecessors(distances: DataFrame, adjacent: DataFrame) -> DataFrame:
    """s, v, u: the node before v on the canonical path from s: nearest to s, then smallest."""
    reached = distances.withColumnsRenamed({"t": "u", "d": "du"}).join(adjacent, "u")
    ends = distances.withColumnsRenamed({"t": "v", "d": "dv"})
    on_path = reached.join(ends, ["s", "v"]).where((F.col("du") + F.col("w") == F.col("dv")) & (F.col("s") != F.col("v")))
    return on_path.groupBy("s", "v").agg(F.min(F.struct("du", "u")).alias("best")).select("s", "v", "best.u")


def routes(before: DataFrame, nodes: DataFrame, most_hops: int = 1000) -> DataFrame:
    """s, t, route (array): all canonical paths, trivial ones included, one hop longer each round.

    Paths of more than `most_hops` hops raise an error; none is left out.
    """
    before = stage(before)
    front = stage(nodes.select(F.col("id").alias("s"), F.col("id").alias("t"), F.array("id").alias("route")))
    found = [front]
    for _ in range(most_hops):
        front = stage(front.join(before.withColumnRenamed("u", "t"), ["s", "t"]).select("s", F.col("v").alias("t"), F.concat("route", F.array("v")).alias("route")))
        if front.isEmpty():
            break
        found.append(front)
    else:
        raise RuntimeError(f"some routes have more than {most_hops} hops")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def walked_back(pairs: DataFrame, before: DataFrame, most_hops: int = 100_000) -> DataFrame:
    """s, t, route: the canonical paths of the given pairs only, walked back from their ends, one hop longer each round.  pairs: s, t, connected."""
    front, seen = counted_stage(pairs.select("s", "t", F.array("t").alias("route")), n=F.count(F.when(F.col("s") != F.col("t"), 1)))
    found = [front.where(F.col("route")[0] == F.col("s"))]
    for _ in range(most_hops):
        if not seen["n"]:
            break
        open_ends = front.where(F.col("route")[0] != F.col("s")).withColumn("v", F.col("route")[0])
        front, seen = counted_stage(open_ends.join(before, ["s", "v"]).select("s", "t", F.concat(F.array("u"), "route").alias("route")), n=F.count(F.when(F.col("route")[0] != F.col("s"), 1)))
        found.append(front.where(F.col("route")[0] == F.col("s")))
    else:
        raise RuntimeError(f"some routes have more than {most_hops} hops")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def hops(paths: DataFrame, keep: list[str], route: str = "route") -> DataFrame:
    """One row for each hop: the kept columns, pos, u, v."""
    pairs = F.arrays_zip(F.slice(F.col(route), 1, F.greatest(F.size(route) - 1, F.lit(0))).alias("u"), F.slice(F.col(route), 2, F.greatest(F.size(route) - 1, F.lit(0))).alias("v"))
    return paths.select(*keep, F.posexplode(pairs).alias("pos", "hop")).select(*keep, "pos", "hop.u", "hop.v")


def route_weights(paths: DataFrame, adjacent: DataFrame, keep: list[str]) -> DataFrame:
    """The sum of the hops' weights of each route."""
    return hops(paths, keep).join(adjacent, ["u", "v"]).groupBy(*keep).agg(F.sum("w").alias("weight"))


def fix_routes(paths: DataFrame, shortest: DataFrame) -> DataFrame:
    """Each hop replaced by its shortest path; a route with an unreachable hop goes.  paths: route_id, route."""
    ways = shortest.select(F.col("s").alias("u"), F.col("t").alias("v"), F.slice("route", 2, F.size("route")).alias("rest"))
    steps = hops(paths, ["route_id"]).join(ways, ["u", "v"], "left")
    fixed = steps.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rest"))).alias("parts"), F.count(F.when(F.col("rest").isNull(), 1)).alias("missing")).where("missing = 0")
    first = paths.select("route_id", F.slice("route", 1, 1).alias("head"))
    return first.join(fixed, "route_id", "left").join(steps.select(F.col("route_id").alias("walked")).distinct(), F.col("route_id") == F.col("walked"), "left").where("parts is not null or walked is null").select("route_id", F.concat("head", F.coalesce(F.flatten("parts.rest"), F.slice("head", 1, 0))).alias("route"))


def remove_loops(path):
    """A path without loops: at a node seen before, all after its first place goes."""
    return F.aggregate(path, F.slice(path, 1, 0), lambda acc, x: F.when(F.array_contains(acc, x), F.slice(acc, 1, F.array_position(acc, x).cast("int"))).otherwise(F.concat(acc, F.array(x))))


def criticality(edges: DataFrame, nodes: DataFrame, volumes: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """For each edge, how much the traffic-weighted mean distance grows without it (over pairs still connected).

    Without an edge, only pairs change whose canonical path has it: as many rows as all paths have hops.  Such a pair starts
    from the nodes whose distance stands and is mended along edges between changed ones, in rounds, until none changes.
    volumes: source, target, throughput.
    """
    adjacent = stage(adjacency(edges, "rtt_us"))
    distances = closure(adjacent, nodes)
    walks = routes(predecessors(distances, adjacent), nodes)
    lost = stage(hops(walks, ["s", "t"]).select(F.least("u", "v").alias("ra"), F.greatest("u", "v").alias("rb"), "s", "t"))
    key = ["ra", "rb", "s", "t"]
    links = adjacent.select(F.col("u").alias("m"), F.col("v").alias("t"), "w")
    other = ~((F.least("m", "t") == F.col("ra")) & (F.greatest("m", "t") == F.col("rb")))
    marked = lost.select("ra", "rb", "s", F.col("t").alias("m"))
    stands = lost.join(links, "t").where(other).join(marked, ["ra", "rb", "s", "m"], "left_anti")
    first = stands.join(distances.select("s", F.col("t").alias("m"), "d"), ["s", "m"]).groupBy(*key).agg(F.min(F.col("d") + F.col("w")).alias("d"))
    fresh = F.count(F.when(F.col("fresh"), 1))
    now, seen = counted_stage(first.withColumn("fresh", F.lit(True)), n=fresh)
    for _ in range(most_rounds):
        if not seen["n"]:
            break
        moved = now.where("fresh").select("ra", "rb", "s", F.col("t").alias("m"), "d").join(links, "m").where(other).join(lost, key, "left_semi")
        best = moved.select(*key, (F.col("d") + F.col("w")).alias("d"), F.lit(None).cast("long").alias("old")).unionByName(now.select(*key, "d", F.col("d").alias("old"))).groupBy(*key).agg(F.min("d").alias("d"), F.min("old").alias("old"))
        now, seen = counted_stage(best.select(*key, "d", (F.col("old").isNull() | (F.col("d") < F.col("old"))).alias("fresh")), n=fresh)
    else:
        raise RuntimeError("distances did not settle")
    demand = volumes.select(F.col("source").alias("s"), F.col("target").alias("t"), F.col("throughput").alias("q"))
    whole = distances.join(demand, ["s", "t"]).agg(F.coalesce(F.sum(F.col("q") * F.col("d")), F.lit(0)).alias("cost"), F.coalesce(F.sum("q"), F.lit(0)).alias("load"))
    was = lost.join(distances, ["s", "t"]).join(demand, ["s", "t"]).join(now.select(*key, F.col("d").alias("after")), key, "left")
    change = was.groupBy("ra", "rb").agg(
        F.sum(F.col("q") * (F.coalesce("after", F.lit(0)) - F.col("d"))).alias("more"),
        F.sum(F.when(F.col("after").isNull(), F.col("q")).otherwise(0)).alias("cut"),
    )
    all_edges = edges.select(F.col("a").alias("ra"), F.col("b").alias("rb")).join(change, ["ra", "rb"], "left").crossJoin(F.broadcast(whole))
    mean = (F.col("cost") + F.coalesce("more", F.lit(0))).cast("double") / (F.col("load") - F.coalesce("cut", F.lit(0)))
    return all_edges.where(F.col("load") > F.coalesce("cut", F.lit(0))).select(F.col("ra").alias("a"), F.col("rb").alias("b"), (mean - F.col("cost").cast("double") / F.col("load")).alias("growth"))


def nearest_places(pairs: DataFrame, adjacent: DataFrame, paths: DataFrame) -> DataFrame:
    """u, v, route_id, volume, ps, pv, us, uv: for each ordered pair and route, the nearest two places in that order, as (gap, pos, left, right).

    p is a neighbour of u and not v, s one of v and not u; a place may be both ends, with a gap of 0.  Of several with the least gap the first on
    the route counts.  As prefix distances grow, the last left place up to a right place is the nearest; one window pass finds all.
    paths: route_id, route, volume; routes without volume are skipped.
    """
    near = adjacent.select(F.col("u").alias("x"), F.col("v").alias("y"))
    mark = lambda df, node, kind: df.select("u", "v", F.col(node).alias("node"), *[F.lit(n == kind).alias(f"is_{n}") for n in "pusv"])
    parts = [
        mark(pairs.join(near, F.col("u") == F.col("x")).where("y <> v"), "y", "p"),
        mark(pairs, "u", "u"),
        mark(pairs.join(near, F.col("v") == F.col("x")).where("y <> u"), "y", "s"),
        mark(pairs, "v", "v"),
    ]
    roles = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("u", "v", "node").agg(*[F.max(f"is_{n}").alias(f"is_{n}") for n in "pusv"])
    loaded = paths.where("volume <> 0")
    step = hops(loaded, ["route_id"]).withColumnsRenamed({"u": "x", "v": "y"}).join(adjacent.withColumnsRenamed({"u": "x", "v": "y"}), ["x", "y"]).select("route_id", (F.col("pos") + 1).alias("pos"), "w")
    places = loaded.select("route_id", "volume", F.posexplode("route").alias("pos", "node")).join(step, ["route_id", "pos"], "left")
    along = Window.partitionBy("route_id").orderBy("pos")
    places = places.withColumn("prefix", F.sum(F.coalesce("w", F.lit(0))).over(along))
    met = places.join(roles, "node")
    so_far = Window.partitionBy("u", "v", "route_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda n: F.max(F.when(F.col(f"is_{n}"), F.struct("prefix", "node"))).over(so_far)
    gap = lambda a, b: F.when(F.col(f"is_{b}") & F.col(f"last_{a}").isNotNull(), F.struct((F.col("prefix") - F.col(f"last_{a}.prefix")).alias("gap"), "pos", F.col(f"last_{a}.node").alias("left"), F.col("node").alias("right")))
    gaps = met.withColumns({f"last_{n}": last(n) for n in "pu"}).withColumns({f"gap_{a}{b}": gap(a, b) for a in "pu" for b in "sv"})
    return gaps.groupBy("u", "v", "route_id").agg(F.max("volume").alias("volume"), *[F.min(f"gap_{k}").alias(k) for k in ("ps", "pv", "us", "uv")])


def traffic_curvature(pairs: DataFrame, adjacent: DataFrame, distances: DataFrame, paths: DataFrame) -> DataFrame:
    """u, v, curvature of each ordered pair from the routes that pass it; pairs without any are left out.

    A route counts once for a pair, by the first that it has of: a neighbour of u before a neighbour of v (s), a
    neighbour of u before v, u before a neighbour of v, u before v.  Its cost is the least distance
    between two such places, plus 0, 1, 1 or 2 times the pair's distance.  paths: route_id, route, volume.
    """
    least = nearest_places(pairs, adjacent, paths)
    d = distances.select(F.col("s").alias("u"), F.col("t").alias("v"), "d")
    cost = F.coalesce(F.col("ps.gap"), F.col("pv.gap") + F.col("d"), F.col("us.gap") + F.col("d"), F.col("uv.gap") + 2 * F.col("d"))
    costed = least.join(d, ["u", "v"]).withColumn("cost", cost).where("cost is not null")
    return costed.groupBy("u", "v", "d").agg((F.sum((F.col("volume") * F.col("cost")).cast("double")) / F.sum("volume")).alias("mean")).select("u", "v", (1 - F.col("mean") / F.col("d")).alias("curvature"))
