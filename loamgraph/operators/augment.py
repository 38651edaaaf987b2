"""Graphs with a copy of each neighbour hung on every node, neighbour distributions, prefix lookups, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import mirrored


def augmented_edges(edges: DataFrame) -> DataFrame:
    """u, v, w: node names are strings, the copy of y at x is 'x:y'; a star edge has its original's weight."""
    name = lambda c: F.col(c).cast("string")
    both = mirrored(edges.select("a", "b", F.col("rtt_us").alias("w")))
    stars = both.select(name("u").alias("u"), F.concat_ws(":", "u", "v").alias("v"), "w")
    return edges.select(name("a").alias("u"), name("b").alias("v"), F.col("rtt_us").alias("w")).unionByName(stars)


def augmented_distances(distances: DataFrame, adjacent: DataFrame) -> DataFrame:
    """u, v, d between nodes and copies: a copy lies its edge beyond its node; 'x:y' to x is that edge, copies of one node add both."""
    places = adjacent.select("u", "v").distinct().join(distances.select(F.col("s").alias("u"), F.col("t").alias("v"), F.col("d").alias("extra")), ["u", "v"])
    copies = places.select(F.col("u").alias("node"), F.concat_ws(":", "u", "v").alias("name"), "extra")
    own = distances.where("s = t").select(F.col("s").alias("node"), F.col("s").cast("string").alias("name"), F.lit(0).cast("long").alias("extra"))
    ends = own.unionByName(copies)
    left = ends.select(F.col("node").alias("s"), F.col("name").alias("u"), F.col("extra").alias("e1"))
    right = ends.select(F.col("node").alias("t"), F.col("name").alias("v"), F.col("extra").alias("e2"))
    return distances.join(left, "s").join(right, "t").select("u", "v", (F.col("d") + F.col("e1") + F.col("e2")).alias("d"))


def distributions(adjacent: DataFrame, nodes: DataFrame, alpha: float) -> DataFrame:
    """x, y, mass: 1 - alpha over the neighbours by weight, alpha at the node; all of it there without neighbours."""
    total = adjacent.groupBy("u").agg(F.sum("w").alias("whole"))
    spread = adjacent.join(total, "u").where("whole > 0").select(F.col("u").alias("x"), F.col("v").alias("y"), (F.lit(1 - alpha) * F.col("w") / F.col("whole")).alias("mass"))
    stay = nodes.join(total, F.col("id") == F.col("u"), "left").select(F.col("id").alias("x"), F.col("id").alias("y"), F.when(F.col("whole") > 0, F.lit(float(alpha))).otherwise(1.0).alias("mass"))
    return spread.unionByName(stay)


def longest_prefix(addresses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """address, owner: the owner of the longest matching prefix, or null.  prefixes: prefix, owner.

    Each address looks for its own prefixes of the lengths in use by equi-join.
    """
    # One row, as many lengths as prefixes have.
    sizes = prefixes.agg(F.collect_set(F.length("prefix")).alias("sizes"))
    tries = addresses.select("address").distinct().crossJoin(F.broadcast(sizes)).select("address", F.explode(F.filter("sizes", lambda n: n <= F.length("address"))).alias("size")).select("address", F.expr("left(address, size)").alias("prefix"))
    found = tries.join(prefixes, "prefix").groupBy("address").agg(F.max_by("owner", F.length("prefix")).alias("owner"))
    return addresses.join(found, "address", "left")


def without(edges: DataFrame, removed: DataFrame) -> DataFrame:
    return edges.join(removed.select("a", "b"), ["a", "b"], "left_anti")


def common_keys(*tables: DataFrame, key: list[str]) -> DataFrame:
    """The values of tables with equal keys, side by side, where all have the key."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key)
    return out


def trimmed(faces: DataFrame, kept: DataFrame) -> DataFrame:
    """Faces whose corners are all kept.  kept: vid."""
    for c in "uvw":
        faces = faces.join(kept.select(F.col("vid").alias(c)), c, "left_semi")
    return faces
