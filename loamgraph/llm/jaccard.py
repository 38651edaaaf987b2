"""Near copies by the Jaccard likeness of word shingles, joined by signature trees.

Two sets that are alike enough agree on a whole part of their elements (see `partitions`); sets with a common part
meet in a bucket.  There their texts come together, and a tree over their bitmaps with size ranges excludes
pairs that can't be alike; what is left is compared exactly, skipping what is connected already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, document_key, grouped, narrow, narrow_key, scratch, staged, tidied, utf8
from .components import components
from .partitions import signatures
from .signature_tree import Node, bitmap, build, dual_join
from .text import mix64, shingles

#: Sets and bytes of text that meet in one task; larger buckets are cut into blocks.
BLOCK_SETS = 512
BLOCK_BYTES = 24_000_000


def _identity(s: np.ndarray) -> int:
    """A set's 64-bit name; with its size it stands for the set."""
    return int(np.add.reduce(mix64(s ^ np.uint64(0x5851F42D4C957F2D))).astype(np.uint64).view(np.int64)) if len(s) else 0


def _describe(width: int, percent: int):
    """Each document's set by name and size, and its parts' signatures."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1_000_000):
            sets = shingles(utf8(batch.column("text")), width)
            owner, found = signatures(sets, percent)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sets)))]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.view(np.int64)))
            names, sizes = pa.array([_identity(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("did"), names, sizes, tokens], names=["k1", "k2", "did", "cid", "n", "tokens"])

    return tidied(describe)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * shared >= percent * union, of sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _links(width: int, percent: int):
    """Exact links within each group of rows: a forest that connects what is connected, not all pairs."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for table in grouped(batches, "key"):
            cids = table.column("cid").to_pylist()
            texts = [expand.decompress(z, max_output_size=max(1, size)) for z, size in zip(table.column("z").to_pylist(), table.column("n_bytes").to_pylist())]
            sets = shingles(texts, width)
            parent = list(range(len(cids)))

            def find(i: int) -> int:
                while parent[i] != i:
                    parent[i] = parent[parent[i]]
                    i = parent[i]
                return i

            known: dict[int, int] = {}
            for i, c in enumerate(table.column("component").to_pylist()):
                parent[find(i)] = find(known.setdefault(c, i))
            out = []

            def visit(i: int, j: int) -> None:
                if find(i) != find(j) and alike(sets[i], sets[j], percent):
                    parent[find(i)] = find(j)
                    out.append((cids[i], cids[j]))

            def one(x: Node) -> int:
                """The root that all sets below share, or -1."""
                if not x.below:
                    return find(x.item)
                if x.done is not None:
                    return find(x.done)
                roots = [one(b) for b in x.below]
                if roots[0] >= 0 and all(r == roots[0] for r in roots):
                    x.done = roots[0]
                    return roots[0]
                return -1

            def settled(x: Node, y: Node) -> bool:
                r = one(x)
                return r >= 0 and (x is y or one(y) == r)

            dual_join(build([len(s) for s in sets], [bitmap(s) for s in sets]), percent, visit, settled)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return tidied(links)


def _blocks(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """How many blocks the rows of each group need."""
    return rows.groupBy(*by).agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n_bytes") / BLOCK_BYTES)).alias(name))


def _dealt(rows: DataFrame, key: Column, width: int, percent: int) -> DataFrame:
    keyed = rows.select(key.alias("key"), "cid", "z", "n_bytes", "component")
    return keyed.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(_links(width, percent), "a long, b long")


def _round(rows: DataFrame, lengths: DataFrame, texts: DataFrame, known: DataFrame | None, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links within the blocks of each bucket, given what is connected already, and each bucket's number of blocks.  rows: bucket, cid, n."""
    blocks_of = staged(_blocks(rows.join(lengths, ["cid", "n"]), ["bucket"], "blocks"), "blocks")
    met = rows.join(blocks_of, "bucket")
    if known is None:
        met = met.withColumn("component", F.col("cid"))
    else:
        met = met.join(known, F.col("cid") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cid"))
    met = met.select("cid", "n", "component", F.xxhash64("bucket", _block("blocks", 1)).alias("key")).join(texts, ["cid", "n"])
    return staged(_dealt(met, F.col("key"), width, percent), "links"), blocks_of


def _block(n: str, seed: int) -> Column:
    return F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n))


def similarity_classes(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: did, k1, k2 (its key, see `document_key`), n_shingles, and low: the smallest (did, k1, k2) of its component.

    A bucket of more than BLOCK_SETS sets is joined block by block first.  Then, with what is connected by then left
    out, its blocks meet in pairs: sets outside its largest component meet all others.
    """
    base = narrow(docs, id_col, text_col).select(F.col("doc_id").alias("did"), *document_key(F.col("doc_id"), F.col("text")), "text")
    described = staged(base.select("k1", "k2", "did", "text").mapInArrow(_describe(width, percent), "k1 long, k2 long, did long, cid long, n long, tokens array<long>"), "described")
    sets = described.where("n > 0")
    rows = sets.select(F.explode("tokens").alias("token"), "cid", "n")
    # Signatures whose sets have the same smallest and largest name give the same bucket; equal sets count as one.
    shared = rows.groupBy("token").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a <> b").select("token", F.xxhash64("a", "b").alias("bucket"))
    members = staged(rows.join(staged(shared, "shared"), "token").select("bucket", "cid", "n").distinct(), "members")
    classes = staged(sets.groupBy("cid", "n").agg(F.min(F.struct("did", "k1", "k2")).alias("rep")), "classes")
    wanted = classes.join(members.select("cid", "n").distinct(), ["cid", "n"]).select("rep.k1", "rep.k2", "cid", "n")

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in blocks(batches, "text", 4_000_000):
            raw = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array([squeeze.compress(r) for r in raw], pa.binary()), pa.array([len(r) for r in raw], pa.int64())], names=["k1", "k2", "z", "n_bytes"])

    pressed = base.select("k1", "k2", "text").mapInArrow(tidied(press), "k1 long, k2 long, z binary, n_bytes long")
    texts = staged(pressed.join(wanted, ["k1", "k2"]).dropDuplicates(["cid", "n"]).select("cid", "n", "z", "n_bytes"), "texts")
    lengths = texts.select("cid", "n", "n_bytes")
    # First, each set goes to two of its buckets only: that connects most of what is alike.
    counted = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"))
    chosen = members.join(counted, "bucket").groupBy("cid", "n").agg(F.max(F.struct("members", "bucket")).alias("top"), F.min("bucket").alias("low"))
    chosen = staged(chosen.select("cid", "n", F.explode(F.array_distinct(F.array("top.bucket", "low"))).alias("bucket")), "chosen")
    links, _ = _round(chosen, lengths, texts, None, width, percent)
    # Then only buckets that still hold different components are joined whole.
    known = components(links)
    named = members.join(known, F.col("cid") == F.col("node"), "left").select("bucket", "cid", "n", F.coalesce("component", "cid").alias("component"))
    mixed = staged(named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket"), "mixed")
    left = staged(members.join(mixed, "bucket", "left_semi"), "left")
    links, sizes = _round(left, lengths, texts, known, width, percent)
    known = components(links, known=known)
    cut = sizes.where("blocks > 1").select("bucket")
    if not cut.isEmpty():
        known = components(staged(_across(left.join(cut, "bucket", "left_semi").join(texts, ["cid", "n"]), known, width, percent), "cross-links"), known=known)
    # A class without links keeps its own smallest document.
    placed = staged(classes.join(known, F.col("cid") == F.col("node"), "left").select("cid", "n", "rep", "component"), "placed")
    lowest = placed.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"))
    final = staged(placed.join(lowest, "component", "left").select("cid", "n", F.coalesce("low", "rep").alias("low")), "final-classes")
    own = F.struct("did", "k1", "k2")
    return described.drop("tokens").join(final, ["cid", "n"], "left").select("did", "k1", "k2", F.col("n").alias("n_shingles"), F.coalesce("low", own).alias("low"))


def similarity_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links).

    Documents link when 100 * |shared| >= percent * |union| of their sets of `width`-word shingles.
    A text with fewer words has the whole sequence as one shingle; one without words (or null) has
    none and is linked with nothing.  Equal sets are one class from the start.  Rows of one id are
    separate documents with that id; a null id sorts before all others and comes back as null.  Very
    long texts are sets like others.  An empty table gives an empty result; other columns are not read, whatever
    their names.
    """
    found = similarity_classes(docs, width, percent, id_col, text_col)
    return found.select(F.col("did").alias("doc_id"), "n_shingles", F.col("low.did").alias("component_id"))


def _across(met: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between blocks of a cut bucket.  Only sets outside its largest component have to meet others."""
    rows = staged(met.join(known, F.col("cid") == F.col("node"), "left").select("bucket", "cid", "z", "n_bytes", F.coalesce("component", "cid").alias("component")), "cut-buckets")
    largest = rows.groupBy("bucket", "component").count().groupBy("bucket").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    sided = rows.join(largest, "bucket").withColumn("minor", F.col("component") != F.col("main"))
    needed = staged(_blocks(sided, ["bucket", "minor"], "k"), "sides")
    minor = needed.where("minor").select("bucket", F.col("k").alias("minors"))
    major = needed.where("not minor").select("bucket", F.col("k").alias("majors"))
    apart = sided.join(minor, "bucket").join(major, "bucket")
    few = apart.where("minor").withColumn("i", _block("minors", 2))
    many = apart.where("not minor").withColumn("i", _block("majors", 2))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    pairs = few.withColumn("j", F.explode(every("minors"))).select("*", F.xxhash64("bucket", F.lit(0), F.least("i", "j"), F.greatest("i", "j")).alias("key"))
    against = few.withColumn("j", F.explode(every("majors"))).select("*", F.xxhash64("bucket", F.lit(1), "i", "j").alias("key"))
    others = many.withColumn("j", F.explode(every("minors"))).select("*", F.xxhash64("bucket", F.lit(1), "j", "i").alias("key"))
    return _dealt(pairs.unionByName(against).unionByName(others), F.col("key"), width, percent)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` with the smallest (id, key) of their component, all columns kept.

    Of documents without an id, or with the same one, the smallest key stays, so that one document of each
    group does; rows repeated with the same id and text are one document and stay or go together.
    Documents without words are linked with nothing and stay.  An empty table stays empty.
    """
    with scratch(docs.sparkSession) as left:
        found = similarity_classes(docs, width, percent)
        gone = staged(found.where("k1 <> low.k1 or k2 <> low.k2").select("k1", "k2").distinct(), "gone")
        left.pop()  # only this last table is read again
    rows = narrow_key(docs)
    return rows.join(gone, (rows["key.k1"] == gone["k1"]) & (rows["key.k2"] == gone["k2"]), "left_anti").select("row.*")
