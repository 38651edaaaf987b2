"""Triangles of a graph and violations of the triangle inequality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def triangles(edges: DataFrame) -> DataFrame:
    """u < v < w with the three round trips uv, uw, vw.

    Pairs of edges start at their smaller end, so that a triangle is made once.  At a hub,
    pairs of neighbours grow with the square of its later neighbours, as the triangles may.
    """
    e = lambda a, b, w: edges.select(F.col("a").alias(a), F.col("b").alias(b), F.col("rtt_us").alias(w))
    return e("u", "v", "uv").join(e("v", "w", "vw"), "v").join(e("u", "w", "uw"), ["u", "w"]).select("u", "v", "w", "uv", "uw", "vw")


def with_goodness(found: DataFrame) -> DataFrame:
    return found.withColumn("goodness", geo.goodness(F.col("uv"), F.col("uw"), F.col("vw")))


def long_edges(found: DataFrame) -> DataFrame:
    """The distinct longest edges of triangles whose goodness is above 1."""
    side = geo.longest_side(F.col("uv"), F.col("uw"), F.col("vw"))
    bad = with_goodness(found).where("goodness > 1")
    return bad.select(F.when(side == "vw", F.col("v")).otherwise(F.col("u")).alias("a"), F.when(side == "uv", F.col("v")).otherwise(F.col("w")).alias("b")).distinct()


def remove_violations(edges: DataFrame) -> DataFrame:
    return edges.join(long_edges(triangles(edges)), ["a", "b"], "left_anti")
