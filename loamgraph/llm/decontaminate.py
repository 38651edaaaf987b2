"""Benchmark decontamination: a prefix-filtered join of documents with the windows of benchmark items.

A window is `size` consecutive words of an item, or all words of a shorter one.  As a set of word shingles, a
window is contained in a document's window of the same length only if the shingles of its prefix are: of n
shingles of which all have to agree, the prefix is the first in the order of rarity, counted over all documents.
A window with a shingle that no document has leaves at once.

Documents meet prefixes by their shingles: each place with a prefix shingle, moved back by the shingle's offset in
the window, is the one start that the window can have there (positional bound), if the document holds all its words
from there on (length bound).  What is left is compared word by word, by a join on the windows' texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, narrow, staged, tidied, utf8
from .text import mix64
from .words import LETTERS, Words

SIZE = 10
SHINGLE = 3
#: Slots of the filter that documents' shingles pass before they are joined: 16 a window, within these bounds.  A slot shared by
#: chance lets a shingle through to the exact join, so that the bound limits memory and never results.
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 24


def _hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word; each distinct one is hashed once a block."""
    ids, dictionary = words.numbered()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in dictionary.to_pylist()), dtype=np.uint64, count=len(dictionary))
    return own[ids]


def _shingles(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the runs of `width` words within one text."""
    n = max(0, len(hashes) - width + 1)
    odd = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(7919)) | np.uint64(1)
    total = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        total += hashes[j : j + n] * odd[j]
    place = np.flatnonzero(owner[:n] == owner[width - 1 :]) if n else np.empty(0, np.int64)
    return place, mix64(total[place])


def _taken(words: Words, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The texts of these stretches of words."""
    ends = np.cumsum(length)
    take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - length, length) + np.repeat(start, length)
    return words.joined(take, ends).cast(pa.string())


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, window): the texts of all windows of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 200_000):
            words = Words(utf8(batch.column("text")), LETTERS, lower=True)
            n = words.counts
            length = np.minimum(n, size)
            count = np.where(n > 0, n - length + 1, 0)
            owner = np.repeat(np.arange(len(n)), count)
            start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + words.before[owner]
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner)), _taken(words, start, length[owner])], names=["item", "window"])

    return benchmark.mapInArrow(tidied(cut), "item string, window string")


def _window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, length, width, gram, at): all shingles of each window; one of fewer words is one shingle of that width."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "window", 500_000):
            words = Words(utf8(batch.column("window")), LETTERS)
            hashes, owner, n = _hashes(words), words.owners(), words.counts
            for width in range(1, shingle + 1):
                place, gram = _shingles(hashes, owner, width)
                own = np.minimum(n[owner[place]], shingle) == width
                place, gram = place[own], gram[own]
                text = owner[place]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("window").take(pa.array(text)), pa.array(n[text]), pa.array(np.full(len(text), width)), pa.array(gram.view(np.int64)), pa.array(place - words.before[text])],
                    names=["window", "length", "width", "gram", "at"],
                )

    return windows.select("window").mapInArrow(tidied(cut), "window string, length long, width long, gram long, at long")


def slot_masks(grams: DataFrame, slots: int, most: int) -> np.ndarray:
    """For each slot the bits `at` (below `most`, 64 at most) of the shingles that fall there: vectors of a fixed size, merged in two levels, so that 8 of them reach the driver."""
    kind = np.dtype(f"u{1 << max(0, (most - 1).bit_length() - 3)}")

    def press(mask: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([zstandard.compress(mask.tobytes(), 1)], pa.binary())], names=["mask"])

    def expand(data: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(data), dtype=kind)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(slots, dtype=kind)
        for batch in batches:
            slot = batch.column("gram").to_numpy().view(np.uint64) & np.uint64(slots - 1)
            np.bitwise_or.at(mask, slot.astype(np.int64), np.left_shift(kind.type(1), batch.column("at").to_numpy().astype(kind)))
        yield press(mask)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(slots, dtype=kind)
        for batch in batches:
            for data in batch.column("mask").to_pylist():
                mask |= expand(data)
        yield press(mask)

    parts = grams.select("gram", "at").mapInArrow(mark, "mask binary")
    for n in (64, 8):
        parts = parts.repartition(n).mapInArrow(merge, "mask binary")
    mask = np.zeros(slots, dtype=kind)
    for row in parts.collect():
        mask |= expand(row["mask"])
    return mask


def _counted(docs: DataFrame, mask, slots: int, widths: list[int]) -> DataFrame:
    """(gram, n): how often each shingle that passes the filter stands in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = mask.value
        for batch in blocks(batches, "text", 4_000_000):
            words = Words(utf8(batch.column("text")), LETTERS, lower=True)
            hashes, owner = _hashes(words), words.owners()
            for width in widths:
                gram = _shingles(hashes, owner, width)[1]
                gram, n = np.unique(gram[held[(gram & np.uint64(slots - 1)).astype(np.int64)] != 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])

    return docs.mapInArrow(tidied(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


CANDIDATES = "rid long, doc_id long, n_words long, windows array<string>, starts array<long>, lengths array<long>"


def _candidates(docs: DataFrame, mask, slots: int, lengths: list[int], shingle: int) -> DataFrame:
    """One row per document, with a number of its own: its stretches of words that may be windows, by the filter's prefixes and both bounds."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = mask.value
        number = TaskContext.get().partitionId() << 33
        for batch in blocks(batches, "text", 4_000_000):
            words = Words(utf8(batch.column("text")), LETTERS, lower=True)
            hashes, owner, before = _hashes(words), words.owners(), words.before
            places, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for width in {min(n, shingle) for n in lengths}:
                place, gram = _shingles(hashes, owner, width)
                bits = held[(gram & np.uint64(slots - 1)).astype(np.int64)]
                place, bits = place[bits != 0], bits[bits != 0]
                for n in (n for n in lengths if min(n, shingle) == width):
                    for at in range(n - width + 1):
                        start = place[bits & bits.dtype.type(1 << at) != 0]
                        text = owner[start]
                        start = start - at
                        start = start[(start >= before[text]) & (start + n <= before[text + 1])]
                        places.append(start)
                        sizes.append(np.full(len(start), n))
            found = np.unique(np.stack([np.concatenate(places), np.concatenate(sizes)]), axis=1)
            start, n = found
            text = owner[start]
            ends = pa.array(np.searchsorted(start, before), pa.int32())
            columns = (_taken(words, start, n), pa.array(start - before[text]), pa.array(n))
            rid = number + np.arange(batch.num_rows)
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(rid), batch.column("doc_id"), pa.array(words.counts), *(pa.ListArray.from_arrays(ends, c) for c in columns)], names=["rid", "doc_id", "n_words", "windows", "starts", "lengths"])

    return docs.mapInArrow(tidied(find), CANDIDATES)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (those with windows in the document, as sorted strings).

    Words are maximal runs of letters, digits and characters beyond ASCII, A-Z lowered.  Words of a document inside
    any occurrence of a window are hit, each counted once.  Null and empty texts, and texts of marks alone, have no words and no windows.  An item
    without an id goes by the empty string; items with one id are one; repeated items and windows count once.  A repeated document is judged again, null
    ids stay null.  Without items, or with items without words, nothing is hit; without documents the result is empty.  Texts are judged whole; a document of any
    length is one row of candidates.  `size` is 64 words at most.  Other columns are not read, whatever their names.
    """
    if not 1 <= shingle <= size <= 64:
        raise ValueError("1 <= shingle <= size <= 64")
    spark = docs.sparkSession
    base = narrow(docs, id_col, text_col)
    given = benchmark.select(F.coalesce(benchmark[item_col].cast("string"), F.lit("")).alias("item"), F.coalesce(benchmark[item_text].cast("string"), F.lit("")).alias("text"))
    items = staged(windows_of(given, size).distinct(), "item-windows")
    windows = items.select("window").distinct()
    grams = staged(_window_shingles(windows, shingle), "window-shingles")
    # As many lengths as words in a window at most.
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect())
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (16 * windows.count()).bit_length()))
    in_any = spark.sparkContext.broadcast(slot_masks(grams.select("gram", F.lit(0).alias("at")), slots, 1))
    counts = staged(_counted(base, in_any, slots, sorted({min(n, shingle) for n in lengths})), "shingle-counts")
    # The rarest shingle of each window; none where a shingle of it is nowhere.
    ranked = grams.join(counts, "gram", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "at")).alias("first"))
    prefixes = staged(ranked.where("first.n > 0").select("window", "first.gram", "first.at"), "prefixes")
    by_slot = spark.sparkContext.broadcast(slot_masks(prefixes, slots, size))
    found = staged(_candidates(base, by_slot, slots, lengths, shingle), "candidates")
    with_some = found.where(F.size("windows") > 0)
    stretches = with_some.select("rid", F.explode(F.arrays_zip("windows", "starts", "lengths")).alias("s")).select("rid", F.col("s.windows").alias("window"), F.col("s.starts").alias("start"), F.col("s.lengths").alias("length"))
    hits = staged(stretches.join(prefixes.select("window"), "window", "left_semi"), "hits")
    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    zero = F.lit(0).cast("long")
    covered = F.aggregate(
        spans,
        F.struct(zero.alias("n"), zero.alias("upto")),
        lambda a, x: F.struct((a["n"] + F.greatest(zero, x["end"] - F.greatest(a["upto"], x["start"]))).alias("n"), F.greatest(a["upto"], x["end"]).alias("upto")),
        lambda a: a["n"],
    )
    n_hit = hits.groupBy("rid").agg(covered.alias("n_hit"))
    named = hits.select("rid", "window").distinct().join(items, "window").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    judged = with_some.select("rid", "doc_id", "n_words").join(n_hit, "rid", "left").join(named, "rid", "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return judged.unionByName(found.where(F.size("windows") == 0).select("doc_id", "n_words", zero.alias("n_hit"), none.alias("items")))


def contamination_digests(found: DataFrame) -> DataFrame:
    """The digest columns of `contamination`: the number of items, a hash of their ids, and whether anything is hit."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
