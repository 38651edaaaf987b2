"""Resampling towards a target: n-gram features in hashed buckets, counted through a dictionary of integer words.

Each block of texts has its own dictionary of words, and its n-grams are pairs of numbers: that of the run of n - 1 words, and
that of the next word.  Each distinct one is hashed once a block, from its shorter run's checksum on.  A first pass adds up the
buckets of all blocks of a task, so that what is shuffled is at most one row a bucket and task; with the buckets' gains, a second
pass over the texts weighs each document.  Nothing else is written, and a task holds one block and two vectors over the buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, narrow, staged, tidied, utf8
from .words import LETTERS, Words

#: The longest n-gram, the number of buckets, words that a document needs to be drawn, and the share that is.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT = 1, 10_000, 20, 10
SEED = "2024"
#: Bytes of text that share a dictionary.
BLOCK_BYTES = 4_000_000


def _features(batch: pa.RecordBatch, longest: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The texts' numbers of words; and for each n, (text, bucket) of all runs of n words, texts in order."""
    words = Words(utf8(batch.column("text")), LETTERS, lower=True)
    ids, dictionary = words.numbered()
    owner = words.owners()
    plain = dictionary.to_pylist()
    sums = np.fromiter(map(zlib.crc32, plain), np.int64, len(plain))
    here, found = ids, [(owner, (sums % buckets)[ids])]
    spaced = [b" " + w for w in plain] if longest > 1 else []
    for n in range(2, longest + 1):
        # Runs of n words: a run of n - 1 and the next word.
        size = max(0, len(ids) - n + 1)
        inside = np.flatnonzero(owner[:size] == owner[n - 1 :]) if size else np.empty(0, np.int64)
        kind, back = np.unique(here[inside] * (len(plain) + 1) + ids[inside + n - 1], return_inverse=True)
        shorter, last = np.divmod(kind, len(plain) + 1)
        sums = np.fromiter(map(zlib.crc32, (spaced[i] for i in last.tolist()), sums[shorter].tolist()), np.int64, len(kind))
        found.append((owner[inside], (sums % buckets)[back]))
        here = np.full(size, -1)
        here[inside] = back
    return words.counts, found


def _bucket_counts(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, n): the texts' features by bucket, a row for each bucket that a task fills."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in blocks(batches, "text", BLOCK_BYTES):
            for _, bucket in _features(batch, longest, buckets)[1]:
                total += np.bincount(bucket, minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(tidied(count), "bucket long, n long")


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that `raw` (bucket, n) fills: thousandths of the log ratio of the smoothed distributions, down."""
    per = lambda t, c: t.groupBy("bucket").agg(F.sum("n").alias(c))
    total = lambda t, c: t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(c))
    # Both totals are one row each, by construction.
    wide = per(raw, "s").join(per(target, "t"), "bucket", "left").crossJoin(F.broadcast(total(raw, "all_s"))).crossJoin(F.broadcast(total(target, "all_t")))
    t, s = F.coalesce("t", F.lit(0)).cast("double") + 1, F.col("s").cast("double") + 1
    return wide.select("bucket", F.floor(F.lit(1000.0) * F.log((t * (F.col("all_s") + buckets).cast("double")) / (s * (F.col("all_t") + buckets).cast("double")))).alias("gain"))


WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def _weighed(docs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight), with the gain of each bucket."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK_BYTES):
            counts, found = _features(batch, longest, len(gains))
            features, weight = np.zeros((2, batch.num_rows), dtype=np.int64)
            for owner, bucket in found:
                size = np.bincount(owner, minlength=batch.num_rows)
                ends = np.cumsum(size)
                sums = np.concatenate([[0], np.cumsum(gains[bucket])])
                features += size
                weight += sums[ends] - sums[ends - size]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(tidied(weigh), WEIGHED)


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with `rank` 1, 2, 3... in this order, which no two rows may share: sorted in ranges, numbered in each, moved on by the ranges before."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = staged(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), name)
    # One row a range.
    sizes = {r["part"]: r["n"] for r in ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    numbered = ranges.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    if not sizes:
        return numbered.drop("part").withColumn("rank", F.col("rank").cast("long"))
    moved = rows.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    return numbered.join(F.broadcast(moved), "part").withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")


def importance_resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (null where not drawn).

    Features are all runs of 1 to `longest` words (maximal runs of letters, digits and characters beyond ASCII, A-Z lowered), joined by a
    space, each occurrence counted.  A bucket's gain is floor(1000 ln(((t + 1) / (T + buckets)) / ((s + 1) / (S + buckets)))), where all documents hold S
    features, s in the bucket, and all target texts T and t.  A weight is the sum of gains over a document's features; its score adds floor(1000 g), where g is a Gumbel
    variate from the SHA-256 of `seed`:doc_id.  Of the N documents with `least_words` words or more, floor(percent N / 100) are drawn: the
    highest scores, ties by smaller doc_id (none first), then by fewer features.

    Null and empty texts have no features and weight 0, and count among the N only if `least_words` is 0.  A null id draws as an empty one and stays null.  Repeated rows are documents of
    their own, with ranks that follow each other.  An empty target has gains all the same; an empty table gives an empty result.  Very long texts are one document of a block.  Other columns are
    not read, whatever their names.
    """
    texts = narrow(docs, id_col, text_col)
    aims = target.select(F.coalesce(target[target_text].cast("string"), F.lit("")).alias("text"))
    # One row a bucket.
    raw = staged(_bucket_counts(texts, longest, buckets).groupBy("bucket").agg(F.sum("n").alias("n")), "bucket-counts")
    gains = np.zeros(buckets, dtype=np.int64)
    for r in bucket_gains(raw, _bucket_counts(aims, longest, buckets), buckets).collect():
        gains[r["bucket"]] = r["gain"]
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u)))
    scored = staged(_weighed(texts, gains, longest).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_words", "n_features", "weight", score.alias("score")), "scores")
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc(), F.col("rid").asc()]
    drawn = percent * scored.where(able).count() // 100
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    first = ranked(scored.where(able), order, "ranges").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return first.select(out).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")).select(out))
