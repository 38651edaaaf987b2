"""Exact deduplication: 128-bit hash groups, the smallest id stays, bytes compared within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import key128, narrow, staged

#: Runs of these characters count as one space.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.regexp_replace("text", SPACES, " "))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by the 128-bit hash and, inside a hash, by their bytes: a
    hash aggregation whose key is (hash, text) compares the bytes, and map-side
    combining leaves one row per text and task, so a group of any size stays
    small.  A hash with one text (all, in practice) is joined back on the hash
    alone; only the documents of a hash with several texts are joined on their
    bytes as well.

    Null text counts as empty, and empty texts are equal.  A null id sorts before
    all others.  Rows repeated with the same id are one document given twice: the
    row kept is marked on each of them.  An empty table gives an empty result.  Very long texts are hashed and compared whole.
    Other columns are not read, whatever their names.
    """
    base = normalised(narrow(docs, id_col, text_col)).withColumn("h", key128("text"))
    # A missing id is a flag of its own, so that every long may be an id.
    own_id = [F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("none"), F.count(F.lit(1)).alias("n")]
    texts = base.groupBy("h", "text").agg(*own_id)
    summed = texts.groupBy("h").agg(F.count(F.lit(1)).alias("variants"), F.min("low").alias("low"), F.max("none").alias("none"), F.sum("n").alias("n"))
    groups = staged(summed, "exact-groups")
    ids = base.select("doc_id", "h", F.sha2("text", 256).alias("text_sha256"))
    plain = ids.join(groups.where("variants = 1").drop("variants"), "h")
    clashes = groups.where("variants > 1").select("h")
    if not clashes.isEmpty():
        apart = base.join(clashes, "h", "left_semi")
        own = apart.groupBy("h", "text").agg(*own_id)
        plain = plain.unionByName(apart.join(own, ["h", "text"]).select("h", "doc_id", F.sha2("text", 256).alias("text_sha256"), "low", "none", "n"))
    keep = F.when(~F.col("none"), F.col("low"))
    return plain.select(
        "doc_id",
        keep.alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows repeated with the same id and text, each stays.

    The rows that go are the few; they leave by an anti join on (id, hash).
    """
    gone = exact_groups(docs).where("not kept").select(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias("key")).distinct()
    sha = F.sha2(F.regexp_replace(F.coalesce(docs["text"].cast("string"), F.lit("")), SPACES, " "), 256)
    rows = docs.select(F.struct("*").alias("row"), F.struct(docs["doc_id"].cast("long").alias("id"), sha.alias("sha")).alias("key"))
    left = rows.join(gone, rows["key"]["id"].eqNullSafe(gone["key"]["id"]) & (rows["key"]["sha"] == gone["key"]["sha"]), "left_anti")
    return left.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
