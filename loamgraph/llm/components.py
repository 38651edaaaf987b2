"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(moved.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _unsettled(links: DataFrame) -> bool:
    """Whether some node has more than one link down, or one down and one up: else all are stars around their smallest node."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(links.select("b", F.lit(0), F.lit(1)))
    per = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not per.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def components(links: DataFrame, most_rounds: int = 60, known: DataFrame | None = None) -> DataFrame:
    """(node, component) for each node of the links (a long, b long): the smallest node that it reaches.

    Each round is written to the shared folder, so that the plan stays short and a lost
    executor costs one round.  Joins are on nodes whose links are already pointed at the
    smallest neighbour, and a step emits one row for each link, never pairs of neighbours.

    `known` is what this has returned for other links: only those between its components take rounds, and its nodes are returned too.
    """
    links = links.select("a", "b")
    if known is not None:
        for end in ("a", "b"):
            links = links.join(known.select(F.col("node").alias(end), F.col("component").alias("own")), end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    now = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(most_rounds):
        if not _unsettled(now):
            break
        now = staged(_small_star(_large_star(now)), "links")
    else:
        raise RuntimeError("components did not settle")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b"))).distinct()
    if known is None:
        return found
    if now.isEmpty():
        return known
    new = found.select(F.col("node").alias("name"), F.col("component").alias("low"))
    moved = known.join(new, F.col("component") == F.col("name"), "left").select("node", F.coalesce("low", "component").alias("component"))
    return staged(moved.union(found.join(known, "node", "left_anti")), "components")
