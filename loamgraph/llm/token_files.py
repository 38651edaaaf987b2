"""Token ids in bit-plane files: fixed-size blocks of ids, transposed, each plane compressed, with an index.

A file, all integers little-endian:

    magic 4 bytes "LGBP", version u8, planes per id u8, unit u8 (1: bit planes, 8: byte planes), 0,
    ids per block u32, the planes' zstandard frames one after another, the index,
    length of the index u64, magic.

The index, a zstandard frame, holds u64 values: number of blocks, number of documents, then for
each block its number of ids, and the offset and length of each of its planes; then for each document its id
and twice its number of ids, plus one if it has no id.  A block is read by its index entry alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, narrow, staged, tidied
from .tokens import default_path, encoder

MAGIC = b"LGBP"
BLOCK_IDS = 65536
FILE_IDS = 1 << 22
END_ID = 2


def _planes(ids: np.ndarray, planes: int, unit: int) -> list[bytes]:
    if unit == 8:
        return [np.ascontiguousarray((ids >> np.uint32(8 * p)).astype(np.uint8)).tobytes() for p in range(planes)]
    return [np.packbits(((ids >> np.uint32(p)) & np.uint32(1)).astype(np.uint8)).tobytes() for p in range(planes)]


def write_image(docs: list[tuple[int | None, bytes]], unit: int = 1, block: int = BLOCK_IDS) -> bytes:
    """One file's bytes from (document id, its ids as uint32 bytes) in order."""
    ids = np.frombuffer(b"".join(d for _, d in docs), dtype="<u4")
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    planes = -(-bits // unit)
    press = zstandard.ZstdCompressor(level=1)
    out = [MAGIC + struct.pack("<BBBBI", 1, planes, unit, 0, block)]
    index: list[int] = []
    at = len(out[0])
    for a in range(0, len(ids), block):
        part = ids[a : a + block]
        index.append(len(part))
        for plane in _planes(part, planes, unit):
            frame = press.compress(plane)
            index += [at, len(frame)]
            out.append(frame)
            at += len(frame)
    count = -(-len(ids) // block)
    for doc, data in docs:
        index += [(doc or 0) & (2**64 - 1), len(data) // 4 * 2 + (doc is None)]
    packed = press.compress(np.array([count, len(docs), *index], dtype="<u8").tobytes())
    return b"".join([*out, packed, struct.pack("<Q", len(packed)), MAGIC])


def _index(image: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    if image[:4] != MAGIC or image[-4:] != MAGIC:
        raise ValueError("not a bit-plane file")
    planes, unit = image[5], image[6]
    size = struct.unpack("<Q", image[-12:-4])[0]
    index = np.frombuffer(zstandard.ZstdDecompressor().decompress(image[-12 - size : -12]), dtype="<u8")
    count, docs = int(index[0]), int(index[1])
    return planes, unit, index[2 : 2 + count * (1 + 2 * planes)].reshape(count, 1 + 2 * planes), index[2 + count * (1 + 2 * planes) :].reshape(docs, 2)


def read_block(image: bytes, number: int) -> np.ndarray:
    """The ids of one block, uint32."""
    planes, unit, table, _ = _index(image)
    return _read_block(image, planes, unit, table[number], zstandard.ZstdDecompressor())


def _read_block(image: bytes, planes: int, unit: int, entry: np.ndarray, press: zstandard.ZstdDecompressor) -> np.ndarray:
    n = int(entry[0])
    ids = np.zeros(n, dtype="<u4")
    for p in range(planes):
        a, size = int(entry[1 + 2 * p]), int(entry[2 + 2 * p])
        plane = np.frombuffer(press.decompress(image[a : a + size]), dtype=np.uint8)
        values = plane if unit == 8 else np.unpackbits(plane, count=n)
        ids |= values.astype(np.uint32) << np.uint32(unit * p)
    return ids


def read_image(image: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file: id (or None) and ids."""
    planes, unit, table, docs = _index(image)
    press = zstandard.ZstdDecompressor()
    ids = np.concatenate([_read_block(image, planes, unit, e, press) for e in table]) if len(table) else np.empty(0, "<u4")
    at = 0
    for doc, n in zip(docs[:, 0].astype(np.int64).tolist(), docs[:, 1].tolist()):
        yield None if n & 1 else doc, ids[at : at + n // 2]
        at += n // 2


IMAGES = "part long, first_id long, n_ids long, n_docs long, image binary"


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID, unit: int = 1, file_ids: int = FILE_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """File images of all documents' ids, ascending by document id; order the rows by `part`.

    One row is one file of about `file_ids` ids; a document stays in one file, and one with more ids is a file alone.
    Null text counts as empty, null ids stand first.  Ties of ids go by their texts; repeated rows are written as often as
    they come.  An empty table has no files; other columns are not read, whatever their names.  Only texts move, once,
    in ranges of ids; encoding follows, so that range sampling doesn't encode.
    """
    path = tokenizer or default_path()
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        enc = encoder(path)
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def image() -> pa.RecordBatch:
            nonlocal part, held, size
            row = [part, held[0][0], size // 4, len(held), write_image(held, unit)]
            part, held, size = part + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "first_id", "n_ids", "n_docs", "image"])

        for batch in blocks(batches, "text", 2_000_000):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist())):
                if held and size + len(ids) > 4 * file_ids:
                    yield image()
                held.append((doc, ids + end))
                size += len(held[-1][1])
        if held:
            yield image()

    base = narrow(docs, id_col, text_col)
    return base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(tidied(write, "tokens"), IMAGES)


def read_tokens(images: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32, and the ids if asked for."""
    schema = "part long, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, image in zip(batch.column("part").to_pylist(), batch.column("image").to_pylist()):
                rows: list[list] = [[] for _ in range(5 + with_ids)]
                at = 0
                for doc, ids in read_image(image):
                    for column, value in zip(rows, (part, doc, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist() if with_ids else None)):
                        column.append(value)
                    at += len(ids)
                types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["part", "doc_id", "inner", "n_tokens", "ids_crc32", "ids"][: 5 + with_ids])

    # A file's ids come after those of all files before: of its own range, and of the ranges before, one row each.
    counts = images.select("part", F.shiftright("part", 32).alias("range"), "n_ids")
    ranges = counts.groupBy("range").agg(F.sum("n_ids").alias("held"))
    ranges = ranges.select("range", (F.sum("held").over(Window.orderBy("range")) - F.col("held")).alias("before"))
    within = F.sum("n_ids").over(Window.partitionBy("range").orderBy("part")) - F.col("n_ids")
    files = counts.withColumn("within", within).join(ranges, "range").select("part", (F.col("before") + F.col("within")).alias("base"))
    rows = images.select("part", "image").mapInArrow(tidied(read), schema)
    extra = ["ids"] if with_ids else []
    return rows.join(files, "part").select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *extra)


def token_round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the files to the shared folder and reads them back; see `read_tokens`."""
    return read_tokens(staged(write_tokens(docs, tokenizer), "token-files"))
