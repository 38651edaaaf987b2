"""Greedy covers in rounds: the choices of the one-by-one method, many at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import counted_stage, stage
from .stats import numbered


def greedy_cover(members: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """step, name, gain: sets that together hold all items, as if one took the set that adds most again and again (ties: the least rank).

    members: name, item, rank, each (name, item) once.  A set's rank is the least of its items left.  What a set adds never grows and its rank never falls, so a set that is
    ahead of all sets that share an item with it is taken before any of them whatever happens elsewhere: all such sets are
    taken at once, and their order is that of what they added, then rank.
    """
    left, seen = counted_stage(members.select("name", "item", "rank"), n=F.count(F.lit(1)))
    taken = []
    for _ in range(most_rounds):
        if not seen["n"]:
            break
        worth = left.groupBy("name").agg(F.count(F.lit(1)).alias("gain"), F.min("rank").alias("least"))
        ahead = F.struct((-F.col("gain")).alias("gain"), F.col("least"), F.col("name")).alias("ahead")
        placed = stage(left.join(worth.select("name", ahead), "name"))
        first = placed.groupBy("item").agg(F.min("ahead").alias("first"))
        won = stage(placed.join(first, "item").groupBy("name", "ahead").agg(F.min(F.col("ahead") == F.col("first")).alias("all")).where("all").select("name", "ahead"))
        taken.append(won)
        covered = left.join(won, "name", "left_semi").select("item").distinct()
        left, seen = counted_stage(left.join(covered, "item", "left_anti"), n=F.count(F.lit(1)))
    else:
        raise RuntimeError("items are left over")
    if not taken:
        return members.select(F.lit(0).cast("long").alias("step"), "name", F.lit(0).cast("long").alias("gain")).limit(0)
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return numbered(out, [F.col("ahead")], 0).select(F.col("place").alias("step"), "name", (-F.col("ahead.gain")).alias("gain"))


def vertex_cover(pairs: DataFrame) -> DataFrame:
    """step, id, gain: nodes that touch all pairs (a, b), of most remaining pairs first; ties go to the one that the pairs in order show first."""
    end = lambda c, k: F.struct(F.col(c).alias("name"), F.struct("a", "b").alias("item"), F.struct("a", "b", F.lit(k).alias("end")).alias("rank"))
    members = pairs.select("a", "b").distinct().select(F.explode(F.array(end("a", 0), end("b", 1))).alias("m")).select("m.*")
    return greedy_cover(members).withColumnRenamed("name", "id")


def set_cover(members: DataFrame) -> DataFrame:
    """step, name, gain: sets that hold all items; ties go to the smallest name.  members: name, item."""
    return greedy_cover(members.select("name", "item", F.col("name").alias("rank")).distinct())
