"""Suffix-array deduplication: removes every byte of a string of `length` bytes that starts more than once.

Which texts have to meet in a suffix array is found by winnowing: each string of
`length` bytes has one chosen gram, the same wherever the string stands.  A gram
that stands once in the corpus can't belong to a repeated string; the text around the
others goes to the bucket of the smallest document key with that gram.  A bucket's texts,
identical ones once, are sorted by the two-stage suffix sort, and neighbours that
share `length` bytes mark what is repeated.  The strings of a bucket that is too large for one
suffix array are dealt anew by their own grams, and those of a gram that is still too frequent by wider ones: buckets
get smaller, and each is sorted in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, document_key, narrow, narrow_key, staged, tidied, utf8
from .suffix import repeated_starts
from .text import BYTE_VALUE, mix64
from .winnow import gram_hashes, window_minima

LENGTH = 200
#: Distinct bytes of one bucket that a single suffix array takes; the strings of larger buckets go to finer ones.
BUCKET_BYTES = 2_000_000
#: Bytes after which a suffix array of several buckets is closed.
ARRAY_BYTES = 2_000_000


def gram_width(length: int) -> int:
    """The largest power of two up to a sixth of the length, 4 at least (for lengths from 8)."""
    return max(4, 1 << max(0, (length // 6).bit_length() - 1)) if length >= 8 else 1


def _anchors(length: int):
    k = gram_width(length)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1_000_000):
            raw = utf8(batch.column("text"))
            sizes = np.array([len(r) for r in raw], dtype=np.int64)
            values = BYTE_VALUE[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            doc, _, h, lo, hi = window_minima(values, sizes, k, length - k + 1)
            take = pa.array(doc)
            # One long for the first start and the number of starts after it, which is less than the length.
            at = (lo << 16) | (hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(batch.column(c).take(take) for c in ("k1", "k2", "times")), pa.array(at)], names=["gram", "k1", "k2", "times", "at"])

    return tidied(anchors)


def _segments(length: int):
    """From documents with their marked places: the text of each run of places with the same bucket."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "part", "k1", "k2", "times", "start", "bytes"])

        for batch in blocks(batches, "z", 1_000_000):
            rows: list[tuple] = []
            held = 0
            for k1, k2, times, packed, size, at, owner in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "times", "z", "n_bytes", "ats", "owners"))):
                text = press.decompress(packed, max_output_size=size) if size else b""
                at, owner = np.array(at, dtype=np.int64), np.array(owner, dtype=np.int64)
                order = np.argsort(at)
                at, owner = at[order], owner[order]
                lo = at >> 16
                hi = lo + (at & 0xFFFF)
                new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (lo[1:] != hi[:-1] + 1)]))
                for a, b, own in zip(lo[new].tolist(), hi[np.append(new[1:], len(at)) - 1].tolist(), owner[new].tolist()):
                    part = text[a : b + length]
                    rows.append((own, xxhash.xxh3_128_digest(part), k1, k2, times, a, part))
                    held += len(part)
                if held > 8_000_000:
                    yield found()
                    rows, held = [], 0
            if rows:
                yield found()

    return tidied(segments)


def covered(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs [from, to) of bytes within `length` of a repeated start; starts ascend."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
    return starts[new], starts[np.append(new[1:], len(starts)) - 1] + length


def _sort_buckets(length: int):
    """Rows sorted by bucket: marks the repeated runs of each distinct text of each bucket."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int]] = []
        size = 0

        def marked() -> pa.RecordBatch:
            hits = repeated_starts([t for _, _, t, _ in held], length)
            rows, at = [], 0
            for bucket, part, text, copies in held:
                own = np.arange(len(text) - length + 1) if copies > 1 else np.flatnonzero(hits[at : at + len(text)])
                at += len(text) + 1
                if len(own):
                    a, b = covered(own, length)
                    rows.append((bucket, part, a.tolist(), b.tolist()))
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["bucket", "part", "froms", "tos"])

        for batch in blocks(batches, "bytes", 2_000_000):
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "bytes", "copies"))):
                # A bucket is never cut; several share an array, where only true repeats can meet.
                if size > ARRAY_BYTES and row[0] != held[-1][0]:
                    yield marked()
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield marked()

    return tidied(sort)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MARKS rows whose runs overlap, with the runs that they make together."""
    for batch in batches:
        froms, tos = [], []
        for a, b in zip(batch.column("froms"), batch.column("tos")):
            a, b = a.values.to_numpy(), b.values.to_numpy()
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            froms.append(a[new])
            tos.append(b[np.append(new[1:], len(a)) - 1])
        runs = [pa.array(c, pa.list_(pa.int64())) for c in (froms, tos)]
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("part"), *runs], names=["bucket", "part", "froms", "tos"])


MARKS = "bucket long, part binary, froms array<long>, tos array<long>"


def finer_widths(length: int) -> list[int]:
    """Widths of the grams that large buckets are dealt by, one after another; the last is the whole string."""
    wide = 1 << (length.bit_length() - 1)
    return sorted({gram_width(length), wide // 2 if wide == length else wide} - {length}) + [length]


def _finer(length: int, k: int):
    """From a large bucket's texts: the runs of strings with one chosen gram of k bytes, by that gram."""

    def chosen(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, gram, first, last): the strings that start at first..last of a text have this gram."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        values = BYTE_VALUE[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        if k < length:
            doc, _, h, lo, hi = window_minima(values, sizes, k, length - k + 1)
            return doc, h, lo, hi
        wide = 1 << (length.bit_length() - 1)
        grams = gram_hashes(values, wide)
        count = sizes - length + 1
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place = at + np.repeat(np.cumsum(sizes) - sizes, count)
        return np.repeat(np.arange(len(texts)), count), mix64(grams[place] + mix64(grams[place + length - wide])), at, at

    def finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        for batch in blocks(batches, "bytes", 1_000_000 if k < length else 50_000):
            buckets, parts, texts, copies = (batch.column(c).to_pylist() for c in ("bucket", "part", "bytes", "copies"))
            doc, h, lo, hi = chosen(texts)
            for a in range(0, len(doc), 20_000):
                # A text that goes on in a short period has the same strings many times: they are one row.
                places: dict[tuple, list[int]] = {}
                for i, gram, x, y in zip(doc[a : a + 20_000].tolist(), h[a : a + 20_000].view(np.int64).tolist(), lo[a : a + 20_000].tolist(), hi[a : a + 20_000].tolist()):
                    places.setdefault((i, gram, texts[i][x : y + length]), []).append(x)
                rows = [(buckets[i], parts[i], ats, gram, xxhash.xxh3_128_digest(own), own, copies[i] * len(ats)) for (i, gram, own), ats in places.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["outer", "whole", "ats", "bucket", "part", "bytes", "copies"])

    return tidied(finer)


def _marks(texts: DataFrame, length: int, bucket_bytes: int, widths: list[int]) -> DataFrame:
    """The repeated runs of each bucket's texts, which may overlap: MARKS rows.  A bucket has at most `bucket_bytes` in one suffix array."""
    sort = lambda t: t.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "part", "bytes", "copies").mapInArrow(_sort_buckets(length), MARKS)
    if not widths:
        return staged(sort(texts), "marks")
    large = staged(texts.groupBy("bucket").agg(F.sum(F.octet_length("bytes")).alias("n")).where(F.col("n") > bucket_bytes).select("bucket"), "large-buckets")
    if large.isEmpty():
        return staged(sort(texts), "marks")
    small = staged(sort(texts.join(large, "bucket", "left_anti")), "marks")
    parts = texts.join(large, "bucket", "left_semi").select("bucket", "part", "bytes", "copies").mapInArrow(_finer(length, widths[0]), "outer long, whole binary, ats array<long>, bucket long, part binary, bytes binary, copies long")
    finer = staged(parts.groupBy("bucket", "part").agg(F.max("bytes").alias("bytes"), F.sum("copies").alias("copies")), "finer-texts")
    own = _marks(finer, length, bucket_bytes, widths[1:])
    moved = lambda c: F.flatten(F.collect_list(F.flatten(F.transform("ats", lambda at: F.transform(c, lambda x: x + at))))).alias(c)
    back = parts.select("outer", "whole", "ats", "bucket", "part").join(own, ["bucket", "part"])
    whole = back.groupBy("outer", "whole").agg(moved("froms"), moved("tos")).select(F.col("outer").alias("bucket"), F.col("whole").alias("part"), "froms", "tos")
    return small.unionByName(staged(whole.mapInArrow(tidied(_merged), MARKS), "finer-marks"))


def removals(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, characters: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, cuts): all documents as (doc_id, k1, k2, text), and for those that lose bytes (k1, k2, n_removed, n_spans, rest).

    With `characters`, `rest` has whole characters only.

    `k1` and `k2` are the document's key; rows with the same id and different texts are different documents.
    """
    base = narrow(docs, id_col, text_col).select("doc_id", *document_key(F.col("doc_id"), F.col("text")), "text")

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in blocks(batches, "text", 4_000_000):
            raw = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "times")), pa.array([squeeze.compress(r) for r in raw], pa.binary()), pa.array([len(r) for r in raw], pa.int64())], names=["k1", "k2", "times", "z", "n_bytes"])

    packed = F.struct("at", "bucket")
    # Equal rows are handled once, and count as often as they are there: usually there are none, and texts needn't move.
    again = staged(base.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeated-rows")
    once = base.withColumn("times", F.lit(1).cast("long"))
    if not again.isEmpty():
        once = base.dropDuplicates(["k1", "k2"]).join(again, ["k1", "k2"], "left").withColumn("times", F.coalesce("times", F.lit(1).cast("long")))
    anchors = staged(once.mapInArrow(_anchors(length), "gram long, k1 long, k2 long, times long, at long"), "anchors")
    buckets = staged(anchors.groupBy("gram").agg(F.sum("times").alias("n"), F.min("k1").alias("bucket")).where("n > 1").drop("n"), "buckets")
    marked = anchors.join(buckets, "gram").groupBy("k1", "k2").agg(F.collect_list(packed).alias("marks")).select("k1", "k2", F.col("marks.at").alias("ats"), F.col("marks.bucket").alias("owners"))
    # Documents that no gram points to leave here; the texts of the others are kept, compressed.
    pressed = once.mapInArrow(tidied(press), "k1 long, k2 long, times long, z binary, n_bytes long")
    suspects = staged(pressed.join(marked, ["k1", "k2"]), "suspects")
    parts = suspects.mapInArrow(_segments(length), "bucket long, part binary, k1 long, k2 long, times long, start long, bytes binary")
    texts = staged(parts.groupBy("bucket", "part").agg(F.max("bytes").alias("bytes"), F.sum("times").alias("copies")), "bucket-texts")
    marks = _marks(texts, length, bucket_bytes, finer_widths(length))
    places = parts.select("bucket", "part", "k1", "k2", "start").join(marks, ["bucket", "part"])
    spans = places.select("k1", "k2", F.explode(F.arrays_zip(F.transform("froms", lambda x: x + F.col("start")).alias("a"), F.transform("tos", lambda x: x + F.col("start")).alias("b"))).alias("span"))
    per_doc = spans.groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in blocks(batches, "z", 1_000_000):
            rows = []
            for k1, k2, z, size, spans in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "z", "n_bytes", "spans"))):
                text = expand.decompress(z, max_output_size=size) if size else b""
                removed, runs, at, kept = 0, 0, 0, []
                for a, b in sorted((s["a"], s["b"]) for s in spans):
                    if a > at or not runs:
                        kept.append(text[at:a])
                        runs += 1
                        removed += b - a
                    else:
                        removed += max(0, b - at)
                    at = max(at, b)
                kept.append(text[at:])
                rest = b"".join(kept)
                rows.append((k1, k2, removed, runs, rest.decode("utf-8", "ignore").encode() if characters else rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["k1", "k2", "n_removed", "n_spans", "rest"])

    cuts = suspects.select("k1", "k2", "z", "n_bytes").join(per_doc, ["k1", "k2"]).mapInArrow(tidied(cut), "k1 long, k2 long, n_removed long, n_spans long, rest binary")
    return base, cuts


def repeat_digests(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes left).

    Texts are judged as UTF-8 bytes on the input, null as empty; strings never cross
    documents; overlapping repeats count.  Texts shorter than `length` keep all; very long ones
    are handled in parts.  A row repeated is another document with the same text; so are rows of one id.  Rows
    with a null id are returned with a null id; an empty table gives an empty result; other columns are not read,
    whatever their names.
    """
    base, cuts = removals(docs, length, id_col, text_col, bucket_bytes)
    all_docs = base.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    lost = cuts.select("k1", "k2", "n_removed", "n_spans", F.sha2("rest", 256).alias("rest_sha"))
    return all_docs.join(lost, ["k1", "k2"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("rest_sha", "sha").alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """`docs` with its texts' repeated strings removed, all other columns as they are.

    What a cut leaves of a character goes as well, so that the text stays valid.  Documents keep their row,
    whatever is left; n_chars, where there is such a column, counts the new text.  Null texts stay null, and
    an empty table stays empty.
    """
    _, cuts = removals(docs, length, characters=True)
    rest = cuts.select("k1", "k2", F.col("rest").cast("string").alias("rest"))
    rows = narrow_key(docs)
    joined = rows.join(rest, (rows["key.k1"] == rest["k1"]) & (rows["key.k2"] == rest["k2"]), "left")
    lost = F.col("rest").isNotNull()
    new = {"text": F.when(lost, F.col("rest")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(lost, F.length("rest")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
