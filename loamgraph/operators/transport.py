"""Curvature by optimal transport: one transport problem for each pair of nodes, its rows gathered by joins.

A group holds the places that two neighbourhoods give mass to, and the distances between them: the product of two degrees,
never the graph.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import mirrored
from .kernels import transport_cost
from .paths import closure, nearest_places


def least_costs(supply: DataFrame, demand: DataFrame, distances: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """keys, cost: the least cost of moving each problem's supply to its demand; the two have equal sums.

    supply: keys, x, mass; demand: keys, y, need; distances: by, x, y, d.  A problem with places that are not connected is left out.
    """
    places = supply.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_x")).join(demand.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_y")), keys)
    rows = supply.join(demand, keys).join(distances, [*by, "x", "y"]).join(places, keys)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[:1][keys].copy()
        cost = pdf.pivot(index="x", columns="y", values="d")
        if len(cost) != pdf["n_x"].iloc[0] or len(cost.columns) != pdf["n_y"].iloc[0] or cost.isna().to_numpy().any():
            return one.iloc[:0].assign(cost=pd.Series(dtype=float))
        mass = pdf.drop_duplicates("x").set_index("x")["mass"].reindex(cost.index).to_numpy(dtype=float)
        need = pdf.drop_duplicates("y").set_index("y")["need"].reindex(cost.columns).to_numpy(dtype=float)
        return one.assign(cost=transport_cost(mass, need, cost.to_numpy(dtype=float)))

    kind = dict(supply.dtypes)
    return rows.select(*keys, "x", "y", "mass", "need", "d", "n_x", "n_y").groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kind[k]}" for k in keys) + ", cost double")


def transport_curvature(pairs: DataFrame, adjacent: DataFrame, distances: DataFrame, paths: DataFrame) -> DataFrame:
    """u, v, curvature of each ordered pair that routes pass: 1 - W / (volume * d), where W is the least cost over the graph of
    moving the volumes from where routes are nearest before the pair to where they are nearest behind it.

    A route's two places are those of `nearest_places`, of the first kind that it has in its order; then routing is forgotten.
    Pairs without such routes are left out.
    """
    least = nearest_places(pairs, adjacent, paths)
    best = F.coalesce(*[F.when(F.col(k).isNotNull(), F.struct(F.col(f"{k}.left").alias("x"), F.col(f"{k}.right").alias("y"))) for k in ("ps", "pv", "us", "uv")])
    moves = least.select("u", "v", F.col("volume").cast("double").alias("volume"), best.alias("m")).where("m is not null").select("u", "v", "m.x", "m.y", "volume")
    supply = moves.groupBy("u", "v", "x").agg(F.sum("volume").alias("mass"))
    demand = moves.groupBy("u", "v", "y").agg(F.sum("volume").alias("need"))
    ways = distances.select(F.col("s").alias("x"), F.col("t").alias("y"), "d")
    costs = least_costs(supply, demand, ways, [], ["u", "v"]).join(moves.groupBy("u", "v").agg(F.sum("volume").alias("volume")), ["u", "v"])
    apart = distances.select(F.col("s").alias("u"), F.col("t").alias("v"), "d")
    return costs.join(apart, ["u", "v"]).select("u", "v", (1 - F.col("cost") / F.col("volume") / F.col("d")).alias("curvature"))


def hop_distances(wanted: DataFrame, adjacent: DataFrame, by: list[str]) -> DataFrame:
    """by, x, y, d: hops between places around one edge, which are 3 at most (over the edge): 0, 1 by an edge, 2 by a shared neighbour, else 3."""
    links = adjacent.select(*by, F.col("u").alias("x"), F.col("v").alias("y"))
    key = [*by, "x", "y"]
    one = wanted.join(links.withColumn("d1", F.lit(1.0)), key, "left").withColumn("d", F.when(F.col("x") == F.col("y"), 0.0).otherwise(F.col("d1")))
    far = one.where("d is null").select(*key)
    over = links.withColumnsRenamed({"y": "m"}).join(links.withColumnsRenamed({"x": "m"}), [*by, "m"])
    two = far.join(over.select(*key).distinct(), key, "left_semi").withColumn("d", F.lit(2.0))
    three = far.join(two.select(*key), key, "left_anti").withColumn("d", F.lit(3.0))
    return one.where("d is not null").select(*key, "d").unionByName(two).unionByName(three)


def ricci(edges: DataFrame, by: list[str] | None = None, alpha: float = 0.0, weighted: bool = False, augmented: bool = False, mass: str | None = None, power: float = 0.0) -> DataFrame:
    """by, a, b, curvature: (1 - W / d) / (1 - alpha) of each graph's edges, after Ollivier and Ricci.

    A node spreads 1 - alpha over its neighbours (by the column `mass`, even without, and divided by the distance to the `power`) and keeps alpha.
    Distances are hops, or sums of rtt_us if `weighted`; d is the edge's own.  If `augmented`, an edge's ends see each other only by copies that hang on the ends
    themselves, one edge away; the shares are even then.  Each edge is a group of its own: the product of its ends' degrees.
    """
    by = by or []
    both = mirrored(edges.select(*by, "a", "b", F.col("rtt_us").cast("double").alias("w"), (F.col(mass).cast("double") if mass else F.lit(1.0)).alias("m")))
    length = F.col("w") if weighted else F.lit(1.0)
    share = F.col("m") / F.pow(length, F.lit(power)) if power else F.col("m")
    near = both.select(*by, "u", "v", share.alias("m"))
    spread = near.join(near.groupBy(*by, "u").agg(F.sum("m").alias("whole")), [*by, "u"]).where("whole > 0").select(*by, "u", F.col("v").alias("x"), (F.lit(1.0 - alpha) * F.col("m") / F.col("whole")).alias("mass"))
    keys = [*by, "a", "b"]
    own = edges.select(*keys)

    def side(end: str, other: str) -> DataFrame:
        """Masses of one end: (place, extra) pairs; extra is the length from the place on to a copy that hangs on it."""
        around = own.join(spread.withColumnRenamed("u", end), [*by, end])
        place = F.when(F.lit(augmented) & (F.col("x") == F.col(other)), F.col(end)).otherwise(F.col("x"))
        beyond = F.when(F.lit(augmented) & (F.col("x") == F.col(other)), 1).otherwise(0)
        stay = own.select(*keys, F.col(end).alias("p"), F.lit(0).alias("beyond"), F.lit(float(alpha)).alias("mass"))
        out = around.select(*keys, place.alias("p"), beyond.alias("beyond"), "mass")
        return (out.unionByName(stay) if alpha else out).groupBy(*keys, "p", "beyond").agg(F.sum("mass").alias("mass"))

    supply, demand = side("a", "b"), side("b", "a")
    wanted = supply.select(*keys, F.col("p").alias("x")).join(demand.select(*keys, F.col("p").alias("y")), keys).select(*by, "x", "y").distinct()
    if weighted:
        ids = both.select(*by, F.col("u").alias("id")).distinct()
        ways = closure(both.select(*by, "u", "v", F.col("w").cast("long").alias("w")), ids, by).select(*by, F.col("s").alias("x"), F.col("t").alias("y"), F.col("d").cast("double").alias("d"))
        ways = ways.join(wanted, [*by, "x", "y"], "left_semi")
    else:
        ways = hop_distances(wanted, both, by)
    if augmented:
        # A copy lies one edge beyond its place; its length is the edge's own.
        extra = edges.select(*keys, (F.col("rtt_us").cast("double") if weighted else F.lit(1.0)).alias("e"))
        cells = supply.select(*keys, F.col("p").alias("x"), F.col("beyond").alias("bx")).join(demand.select(*keys, F.col("p").alias("y"), F.col("beyond").alias("by_")), keys).join(extra, keys).join(ways, [*by, "x", "y"])
        reach = cells.select(*keys, F.concat_ws(":", "x", "bx").alias("x"), F.concat_ws(":", "y", "by_").alias("y"), (F.col("d") + (F.col("bx") + F.col("by_")) * F.col("e")).alias("d"))
        costs = least_costs(supply.select(*keys, F.concat_ws(":", "p", "beyond").alias("x"), "mass"), demand.select(*keys, F.concat_ws(":", "p", "beyond").alias("y"), F.col("mass").alias("need")), reach, keys, keys)
    else:
        costs = least_costs(supply.select(*keys, F.col("p").alias("x"), "mass"), demand.select(*keys, F.col("p").alias("y"), F.col("mass").alias("need")), ways, by, keys)
    d = edges.select(*keys, (F.col("rtt_us").cast("double") if weighted else F.lit(1.0)).alias("own"))
    return costs.join(d, keys).select(*keys, ((1 - F.col("cost") / F.col("own")) / F.lit(1.0 - alpha)).alias("curvature"))
