"""Packing along a space-filling curve: hashed document vectors, a Hilbert key, neighbours packed together."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, narrow, staged, tidied
from .text import mix64
from .tokens import default_path, encoder

LENGTH = 1024
DIMS = 3
BITS = 16
END_ID = 0


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Each point's place on the Hilbert curve through a grid of 2**bits cells a side; points: (n, dims) integers."""
    x = points.astype(np.uint64).T.copy()
    dims = len(x)
    # From the coarsest bit down, undo the rotations and reflections that the curve makes in a cell.
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = q - np.uint64(1)
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        flip ^= np.where((x[-1] & q) != 0, q - np.uint64(1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << np.uint64(1)) | ((x[d] >> np.uint64(level)) & np.uint64(1))
    return key.astype(np.int64)


_directions: dict[int, np.ndarray] = {}


def directions(size: int, dims: int) -> np.ndarray:
    """A hashed +1 or -1 for each token id and dimension."""
    key = size * 64 + dims
    if key not in _directions:
        bits = mix64(np.arange(size * dims, dtype=np.uint64) + np.uint64(77)) >> np.uint64(63)
        _directions[key] = (bits.astype(np.float32) * 2 - 1).reshape(size, dims)
    return _directions[key]


def curve_keys(ids: list[np.ndarray], vocabulary: int, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """The Hilbert key of each document: its mean hashed direction, squeezed to a cube, on the curve."""
    lens = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate(ids)
    signs = directions(vocabulary, dims)
    starts = np.cumsum(lens) - lens
    means = np.stack([np.add.reduceat(signs[:, d][flat], starts) for d in range(dims)], axis=1) / lens[:, None]
    cube = np.clip(((np.tanh(4 * means) + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    return hilbert_keys(cube, bits)


class Packer:
    """Fills sequences of `length` ids one after another; the last one is cut into powers of two, which need no padding."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence = length, first
        self.rows: list[tuple] = []
        self.open: list[tuple[int | None, int, np.ndarray, int]] = []
        self.filled = 0

    def add(self, doc: int, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.length - self.filled]
            self.open.append((doc, at, part, len(ids)))
            self.filled += len(part)
            at += len(part)
            if self.filled == self.length:
                self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list[tuple[int, int, np.ndarray, int]]) -> None:
        offset = 0
        for doc, start, part, total in pieces:
            self.rows.append((doc, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, self.sequence, offset))
            offset += len(part)
        self.sequence += 1

    def finish(self) -> None:
        pieces, left = self.open, self.filled
        self.open, self.filled = [], 0
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            own, rest = [], []
            for doc, start, part, total in pieces:
                take = min(size, len(part))
                if take:
                    own.append((doc, start, part[:take], total))
                if take < len(part):
                    rest.append((doc, start + take, part[take:], total))
                size -= take
            self._close(own)
            pieces = rest

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, curve key, number of ids, and the ids compressed (zstandard over little-endian uint16, or uint32 for large vocabularies)."""
    path = tokenizer or default_path()
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        press = zstandard.ZstdCompressor(level=1)
        size = max(enc.size, (end_id or 0) + 1)
        kind = "<u4" if size > 65536 else "<u2"
        for batch in blocks(batches, "text", 2_000_000):
            ids = [np.frombuffer(x + end, dtype="<u4") for x in enc.encode(batch.column("text").to_pylist())]
            rows = [press.compress(x.astype(kind).tobytes()) for x in ids]
            full = [x if len(x) else np.zeros(1, "<u4") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(curve_keys(full, size)), pa.array([len(x) for x in ids], pa.int64()), pa.array(rows, pa.binary())], names=["doc_id", "key", "n", "ids"])

    return narrow(docs, id_col, text_col).mapInArrow(tidied(encode, "tokens"), "doc_id long, key long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of a document in a sequence of at most `length` ids.

    Documents are encoded once and written; they are then range-sorted by (Hilbert
    key, id), and each range fills its own sequences, document after document.  Full sequences need no padding;
    what a range has left at its end becomes sequences of power-of-two lengths, at
    most 10 of them.  Sequence ids hold the range in their upper bits.

    Null text counts as empty: such a document is its end id alone.  A very long text is one row of
    compressed ids, cut over as many sequences as it fills.  Ties on the curve go by id (null first), then by the
    ids' bytes; repeated rows are packed as often as they come; null ids come back as null.  An empty table gives an
    empty result; other columns are not read, whatever their names.
    """
    path = tokenizer or default_path()

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        press = zstandard.ZstdDecompressor()
        packer = Packer(length, TaskContext.get().partitionId() << 40)

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.taken()))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                ids = press.decompress(data)
                packer.add(doc, np.frombuffer(ids, dtype="<u2" if len(ids) == 2 * n else "<u4"))
                if len(packer.rows) > 20_000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    table = staged(encoded(docs, path, end_id, id_col, text_col), "encoded")
    return table.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids").select("doc_id", "n", "ids").mapInArrow(tidied(fill), PIECES)
