"""Shared plumbing of the text operators: inputs, written stages, streamed groups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The smallest long: where rows without an id stand in ranges and draws, beside those that have this id.
LOWEST_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (as long) and the text (null: empty), whatever else the table has."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def document_key(doc_id: Column, text: Column) -> list[Column]:
    """The 128 bits that a document goes by, as two longs k1 and k2: its id (or that it has none) and text, hashed under two seeds."""
    did = doc_id.cast("long")
    return [F.xxhash64(F.lit(seed), did.isNull(), did, text).alias(f"k{seed}") for seed in (1, 2)]


def narrow_key(docs: DataFrame) -> DataFrame:
    """Whole rows as a struct `row` beside their documents' keys in a struct `key`: no name of theirs can clash with others."""
    return docs.select(F.struct("*").alias("row"), F.struct(*document_key(docs["doc_id"], F.coalesce(docs["text"].cast("string"), F.lit("")))).alias("key"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a new local one only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loamgraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folders of tables staged in each open `scratch`, innermost last.
_SCRATCH: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged inside are deleted at its end, but for those whose folders are taken off the list: what is returned may read no others."""
    paths: list[str] = []
    _SCRATCH.append(paths)
    try:
        yield paths
    finally:
        del _SCRATCH[-1]
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to the shared folder and read back: later jobs neither recompute it nor depend on a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the consecutive rows with one key, from batches sorted by it."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column(key).to_numpy()
        cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.concat_tables(held)


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes of text each, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(text)).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts' bytes; null is empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def key128(name: str) -> Column:
    """The 128-bit hash of a text column."""
    return F.unhex(F.md5(F.col(name)))


def packed(counts: np.ndarray) -> pa.RecordBatch:
    """One row with a vector of 64-bit counts."""
    return pa.RecordBatch.from_arrays([pa.array([zstandard.compress(counts.astype(np.int64).tobytes(), 1)], pa.binary())], names=["counts"])


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of rows made by `packed`: vectors of one fixed size, added up in two levels, so that 8 of them reach the driver."""

    def unpack(data: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.decompress(data), dtype=np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                total = total + unpack(data)
        yield packed(total)

    for n in (64, 8):
        parts = parts.repartition(n).mapInArrow(add, "counts binary")
    return sum((unpack(r["counts"]) for r in parts.collect()), np.zeros(size, dtype=np.int64))


#: Stores that Python workers keep between tasks, by operator.
STORES: dict[str, list[dict]] = {}


def trim() -> None:
    """Gives freed memory back to the system where the libraries can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release(keep: str = "") -> None:
    """Empties what other operators have left in this worker."""
    held = [store for name, stores in STORES.items() if name != keep for store in stores if store]
    if held:
        for store in held:
            store.clear()
        gc.collect()
        trim()


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work`, begun without other operators' stores, and with its own freed memory given back at its end: workers wait for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep)
        try:
            yield from work(batches)
        finally:
            trim()

    return run
