"""Quality selection by importance resampling.

Words and word pairs are hashed into buckets; target texts and all texts give two bucket
distributions.  A document's log weight is its mean log ratio over its n-grams; a Gumbel
variate from its id is added, and the documents with the k largest sums are the sample: k draws
without replacement, in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST_ID, blocks, narrow, packed, staged, summed, utf8
from .text import hash_words, mix64

BUCKETS = 1 << 14
#: Labelled target documents: at most so many, with the smallest hashes of their ids.
TARGET_ROWS = 20_000
KEEP = 0.85
#: The mean log ratio counts as this many n-grams, or as many as there are.
STRENGTH = 100.0


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words and word pairs, text by text, and the number before each text (len + 1 values)."""
    words, before = hash_words(texts)
    n = len(words)
    pairs = np.empty(2 * n, dtype=np.uint64)
    pairs[::2] = words
    pairs[1::2] = mix64(words * np.uint64(3) + np.append(words[1:], np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15))
    keep = np.ones(2 * n, dtype=bool)
    keep[2 * before[1:][before[1:] > before[:-1]] - 1] = False  # a text's last word starts no pair
    sizes = np.diff(before)
    return (pairs[keep] % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(2 * sizes - 1, 0))]).astype(np.int64)


def _counts(texts: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in blocks(batches, "text", 1_000_000):
            total += np.bincount(features(utf8(batch.column("text")))[0], minlength=BUCKETS)
        yield packed(total)

    return summed(texts.select("text").mapInArrow(count, "counts binary"), BUCKETS)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two smoothed bucket distributions; 0 everywhere without target texts."""
    if not target.sum():
        return np.zeros(BUCKETS)
    p, q = target + 1.0, raw + 1.0
    return np.log(p / p.sum()) - np.log(q / q.sum())


def weigh(texts: list[bytes], ratios: np.ndarray) -> np.ndarray:
    slots, before = features(texts)
    n = np.diff(before)
    out = np.zeros(len(texts))
    full = np.flatnonzero(n)
    if len(full):
        out[full] = np.add.reduceat(ratios[slots], before[full]) / n[full] * np.minimum(n[full], STRENGTH)
    # A text without words is as unlike the target as can be.
    out[n == 0] = ratios.min() * STRENGTH
    return out


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """A standard Gumbel variate for each id."""
    u = (mix64(mix64(ids.view(np.uint64)) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2**53))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as longs in the same order."""
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def threshold(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """(t, more): exactly k rows are above t, or are `more` of those at t.  16 bits a pass; 65,536 counts at most reach the driver."""
    prefix, left = 0, k
    unsigned = F.col(column).bitwiseXOR(F.lit(-(2**63)))
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned(unsigned, shift)
        own = rows if shift == 48 else rows.where(F.shiftrightunsigned(unsigned, shift + 16) == F.lit(prefix))
        counts = dict(own.groupBy(digit.bitwiseAND(F.lit(65535)).alias("d")).count().collect())
        for d in sorted(counts, reverse=True):
            if counts[d] >= left:
                break
            left -= counts[d]
        prefix = (prefix << 16) | d
    t = prefix ^ (1 << 63)
    return (t - (1 << 64) if t >= 1 << 63 else t), left


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per document: doc_id, log_weight, sort_key (weight plus Gumbel variate), kept.

    The target are documents labelled quality 1; raw counts cover all documents.  ceil(keep * rows) rows are kept, by
    key, ties by smaller id; rows with equal key and id share their fate.  Null text counts as empty, and a
    text without words has the lowest weight.  Null ids draw as the smallest long, share its fate and come back as null; so do repeated rows.
    Very long texts are weighed whole; an empty table gives an empty result; other columns are not read, whatever their names.  Without labels all weights are equal.
    """
    base = narrow(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(LOWEST_ID)).alias("did"), "text")
    # At most target_rows ids: a bounded table, so it may be broadcast.
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("did")).distinct().orderBy(F.xxhash64("did"), "did").limit(target_rows)
    target = _counts(base.join(F.broadcast(staged(good, "target-ids")), "did", "left_semi"))
    ratios = log_ratios(target, _counts(base))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1_000_000):
            weight = weigh(utf8(batch.column("text")), ratios)
            key = weight + gumbel(batch.column("did").to_numpy(), seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("did"), pa.array(weight), pa.array(key), pa.array(_ordered(key))], names=["doc_id", "did", "log_weight", "sort_key", "place"])

    scored = staged(base.mapInArrow(score, "doc_id long, did long, log_weight double, sort_key double, place long"), "quality-scores")
    k = int(np.ceil(keep * scored.count()))
    if not k:
        kept = F.lit(False)
    else:
        t, more = threshold(scored, "place", k)
        tied = scored.where(F.col("place") == F.lit(t)).select(F.bitwise_not("did").alias("low"))
        low, _ = threshold(tied, "low", more)
        kept = (F.col("place") > F.lit(t)) | ((F.col("place") == F.lit(t)) & (F.col("did") <= F.lit(-low - 1)))
    return scored.select("doc_id", "log_weight", "sort_key", kept.alias("kept"))
