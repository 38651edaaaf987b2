"""Document fingerprints by winnowing, and how alike two of them are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST_ID, blocks, narrow, tidied
from .text import mix64
from .winnow import window_minima

GRAM = 16
WINDOW = 64
#: Characters compared at once, and bytes of text made Python strings at once: a worker's memory goes by this, but for a longer text.
HELD = 1 << 18


def fingerprints(texts: list[str], k: int = GRAM, w: int = WINDOW) -> list[np.ndarray]:
    """For each text, its entries as an array (n, 2) of uint32: position in code points, hash.

    A text with fewer than k code points is a single gram; the empty text has no entry.
    """
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    values = mix64(np.concatenate(raw).astype(np.uint64) + np.uint64(1)) if len(raw) and sizes.sum() else np.empty(0, np.uint64)
    doc, pos, h, _, _ = window_minima(values, sizes, k, w, short=True)
    entries = np.empty((len(pos), 2), dtype="<u4")
    entries[:, 0] = pos
    entries[:, 1] = h >> np.uint64(32)
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i, r in enumerate(raw):
        if 0 < len(r) < k:
            whole = int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=4).digest(), "little")
            out.append(np.array([[0, whole]], dtype="<u4"))
        else:
            out.append(entries[cuts[i] : cuts[i + 1]])
    return out


def written(entries: np.ndarray) -> str:
    """A fingerprint as text: 8 hex digits of the position and 8 of the hash, little-endian, for each entry."""
    return entries.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard likeness of two fingerprints' hashes; two empty ones are alike."""
    x, y = np.unique(a[:, 1]), np.unique(b[:, 1])
    if not len(x) and not len(y):
        return 1.0
    both = np.searchsorted(y, x)
    same = int((y[np.minimum(both, len(y) - 1)] == x).sum()) if len(y) else 0
    return same / (len(x) + len(y) - same)


def edited(text: str, other: str) -> str:
    """`text` with its last half (rounded down) replaced by the first as many code points of `other`."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(rows: list[tuple[int, str]], last: str) -> pa.RecordBatch:
    texts = [t for _, t in rows]
    nexts = [*texts[1:], last]
    changed = [edited(a, b) for a, b in zip(texts, nexts)]
    own = fingerprints([*texts, last])
    new = fingerprints(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array([written(x) for x in own[:-1]]),
            pa.array([written(x) for x in new]),
            pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _one_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows that stand after a range, only the first is its next."""
    seen = None
    for batch in batches:
        after = batch.column("after").to_numpy()
        target = batch.column("target").to_numpy()
        keep = after == 0
        for i in np.flatnonzero(~keep).tolist():
            if target[i] != seen:
                seen, keep[i] = target[i], True
        yield batch.filter(pa.array(keep))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (range, place): each with the next one of its range; the last of a range is only a next."""
    held: list[tuple[int, str]] = []
    size, now = 0, None
    for batch in _one_after(blocks(batches, "text", HELD)):
        for target, doc, text in zip(*(batch.column(c).to_pylist() for c in ("target", "doc_id", "text"))):
            if target != now:
                if held[:-1]:
                    yield _compare(held[:-1], held[-1][1])
                held, size, now = [], 0, target
            elif size > HELD and len(held) > 1:
                yield _compare(held[:-1], held[-1][1])
                held, size = held[-1:], len(held[-1][1])
            held.append((doc, text))
            size += len(text)
    if held[:-1]:
        yield _compare(held[:-1], held[-1][1])


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of its edited text, and its likeness to both that and the next document's.

    The texts move once, in ranges of ids.  The first document of each range goes to
    the range before it as well (the first of all to the last range), so that every
    document meets its next one without a global window; only one id for each range,
    as many as shuffle partitions, comes to the driver.

    Null text counts as empty.  Documents are in ascending order of id, null ids
    first; rows with equal ids are in order of their texts, and repeated rows follow each other.  A table
    of one row is its own next; an empty table gives an empty result.  Very long texts are fingerprinted whole.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    # Ranges take no id for the smallest one; in a range, rows without an id are first.
    base = narrow(docs, id_col, text_col).withColumn("place", F.coalesce("doc_id", F.lit(LOWEST_ID)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [pa.compute.min(b.column(0)).as_py() for b in batches if b.num_rows]
        if low:
            yield pa.RecordBatch.from_arrays([pa.array([min(low)], pa.int64())], names=["low"])

    lows = base.select("place").repartitionByRange(2 * parts, "place").mapInArrow(firsts, "low long").collect()
    bounds = np.array(sorted({r["low"] for r in lows}), dtype=np.int64)
    if not len(bounds):
        return spark.createDataFrame([], SCHEMA)
    top = len(bounds) - 1

    @F.arrow_udf("array<int>")
    def targets(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds, ids.to_numpy(), side="right") - 1
        first = bounds[at] == ids.to_numpy()
        return pa.array([[int(r), int(r - 1) if r else top] if f else [int(r)] for r, f in zip(at, first)], pa.list_(pa.int32()))

    # A copy of each row with a range's first id stands after the range before; of several, the first counts.
    spread = base.select("*", F.posexplode(targets("place")).alias("after", "target"))
    sorted_rows = spread.repartition("target").sortWithinPartitions("target", "after", "doc_id", "text")
    return sorted_rows.select("target", "after", "doc_id", "text").mapInArrow(tidied(_ranges), SCHEMA)
