"""Edge tables: filters, keys, deduplication, thresholds, completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_self_loops(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    return links.where(F.col(source) != F.col(target))


def known_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose both ends are nodes."""
    ids = nodes.select("id")
    return links.join(ids, links["source"] == ids["id"], "left_semi").join(ids.withColumnRenamed("id", "id2"), F.col("target") == F.col("id2"), "left_semi")


def present(links: DataFrame, column: str, has_column: bool = True) -> DataFrame:
    """Links with a measured value; a table without the column keeps all (its values are the bounds)."""
    return links.where(F.col(column).isNotNull()) if has_column else links


def canonical(links: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Unordered pairs: a is the smaller end.  Ids that are strings compare as strings."""
    rest = [c for c in links.columns if c not in (source, target)]
    return links.select(F.least(source, target).alias("a"), F.greatest(source, target).alias("b"), *rest)


def dedupe_edges(links: DataFrame) -> DataFrame:
    """One row for each unordered pair: least round trip, summed throughput, its bound."""
    return canonical(links).groupBy("a", "b").agg(F.min("rtt_us").alias("rtt_us"), F.sum("throughput").alias("throughput"), F.min("gcl_us").alias("gcl_us"))


def threshold(edges: DataFrame, epsilon_us: int) -> DataFrame:
    """Without edges more than epsilon above their bound; edges without a round trip stay."""
    return edges.where(F.col("rtt_us").isNull() | (F.col("rtt_us") - F.col("gcl_us") <= epsilon_us))


def violations(edges: DataFrame) -> DataFrame:
    """Edges faster than light allows."""
    return edges.where(F.col("rtt_us") < F.col("gcl_us"))


def mirrored(edges: DataFrame) -> DataFrame:
    """Both directions of each unordered edge, in one pass over it."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    ends = F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
    return edges.select(ends.alias("ends"), *rest).select("ends.u", "ends.v", *rest)


def symmetric_rtt(links: DataFrame, column: str) -> DataFrame:
    """Both directions' values of each pair, s < t."""
    back = links.select(F.col("source").alias("t"), F.col("target").alias("s"), F.col(column).alias("back"))
    there = links.where("source < target").select(F.col("source").alias("s"), F.col("target").alias("t"), F.col(column).alias("there"))
    return there.join(back, ["s", "t"])


def complete_delays(links: DataFrame, delays: DataFrame) -> DataFrame:
    """Delays for all links: the lesser of both directions, or the bound where neither is measured."""
    measured = canonical(delays.select("source", "target", "rtt_us")).groupBy("a", "b").agg(F.min("rtt_us").alias("rtt_us"))
    wanted = canonical(links.select("source", "target", "gcl_us")).groupBy("a", "b").agg(F.min("gcl_us").alias("gcl_us"))
    whole = wanted.join(measured, ["a", "b"], "full")
    return mirrored(whole.select("a", "b", F.coalesce("rtt_us", "gcl_us").alias("rtt_us"))).withColumnsRenamed({"u": "source", "v": "target"})


def node_totals(links: DataFrame) -> DataFrame:
    """Each node's outgoing and incoming throughput, and their shares of the whole; one pass, one shuffle."""
    ends = F.explode(F.array(F.struct(F.col("source").alias("id"), F.col("throughput").alias("o"), F.lit(0).cast("long").alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).cast("long").alias("o"), F.col("throughput").alias("i"))))
    return links.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.o").alias("total_out"), F.sum("e.i").alias("total_in"))


def distance_band(edges: DataFrame, near_us: int, far_us: int) -> DataFrame:
    return edges.withColumn("band", F.when(F.col("gcl_us") < near_us, "near").when(F.col("gcl_us") < far_us, "mid").otherwise("far"))


def quotient(edges: DataFrame, mapping: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The graph of clusters: for each pair of different clusters the least round trip and the summed throughput.

    mapping: id, rep.
    """
    a = mapping.select(F.col("id").alias("a"), F.col("rep").alias("ra"))
    b = mapping.select(F.col("id").alias("b"), F.col("rep").alias("rb"))
    moved = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "rtt_us", "throughput")
    return moved.groupBy("a", "b").agg(F.min("rtt_us").alias("rtt_us"), F.sum("throughput").alias("throughput"))


def merge_curvatures(rows: DataFrame) -> DataFrame:
    """The mean of both directions' values of each pair."""
    return canonical(rows.select("source", "target", "curvature")).groupBy("a", "b").agg(F.avg("curvature").alias("curvature"))
