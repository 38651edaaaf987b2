"""Periodic runs: stretches of words that repeat with a period, found by Gusfield and Stoye's method for tandem repeats.

A run of `least` words or more, twice its period at least, agrees with itself moved by the period over half of `least`
words or more.  So every word of it lies in a gram of that many words that its text has twice, and whole runs
lie in stretches of such words: only those go into a suffix tree.  Documents are apart: words of different ones
never count as equal there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, narrow, tidied, utf8
from .tandem import maximal_runs
from .text import mix64
from .words import NOT_SPACE, Words

LEAST = 12
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

#: From a document's id and number of words: (a, p), so that each word i >= a reads as word a + (i - a) % p; or None.
Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def _grams_again(ids: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Whether the text has the `width` words from each word on (none beyond its end) at another place too."""
    n = len(ids) - width + 1
    again = np.zeros(len(ids), dtype=bool)
    if n < 2:
        return again
    key = mix64(owner.astype(np.uint64) + np.uint64(1))[:n]
    for j in range(width):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64))
    whole = np.flatnonzero(owner[:n] == owner[width - 1 :])
    order = np.argsort(key[whole])
    same = np.diff(key[whole][order]) == 0
    again[whole[order[1:][same]]] = True
    again[whole[order[:-1][same]]] = True
    return again


def runs_of_words(ids: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of the maximal runs of `least` words or more, by start and period; `owner` is each word's text, ascending."""
    width = (least + 1) // 2
    again = np.flatnonzero(_grams_again(ids, owner, width))
    none = np.empty(0, np.int64)
    if not len(again):
        return none, none, none
    new = np.concatenate([[True], (np.diff(again) > width) | (np.diff(owner[again]) > 0)])
    begin = again[new]
    end = again[np.append(np.flatnonzero(new)[1:] - 1, len(again) - 1)] + width
    begin, end = begin[end - begin >= least], end[end - begin >= least]
    if not len(begin):
        return none, none, none
    size = end - begin
    into = np.cumsum(size + 1) - size  # each stretch follows a mark of its own, and one more ends the last
    values = np.zeros(into[-1] + size[-1] + 1, dtype=np.int64)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    place = at + np.repeat(begin, size)
    values[at + np.repeat(into, size)] = owner[place] * (ids.max() + 1) + ids[place]
    marks = np.append(into - 1, len(values) - 1)
    values[marks] = -1 - np.arange(len(marks))
    start, length, period = maximal_runs(values)
    long = (length >= least) & (length >= 2 * period)
    start, length, period = start[long], length[long], period[long]
    stretch = np.searchsorted(into, start, side="right") - 1
    start = start - into[stretch] + begin[stretch]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def periodic_runs(docs: DataFrame, least: int = LEAST, rewrite: Rewrite | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period, by start and period), collapsed.

    A run is a stretch of words (maximal runs of other bytes than white space, numbered from 0) with smallest period q, of
    max(least, 2 * q) words or more, that can't be extended with that period.  `collapsed` has the words that
    no run holds after its first q words, joined by single spaces.  `rewrite` may have words of a
    document read as earlier ones before the search.

    Documents are handled one by one, each whole; a very long text is one suffix tree over its repeated stretches.
    Null and empty texts have no words, no runs and an empty `collapsed`; a repeated row gives its result again; a null id stays
    null (`rewrite` gets None); an empty table gives an empty result; other columns are not read, whatever their names.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 4_000_000):
            words = Words(utf8(batch.column("text")), NOT_SPACE)
            ids, owner, before = words.numbered()[0], words.owners(), words.before
            source = np.arange(len(words))
            if rewrite:
                for d, (doc, n) in enumerate(zip(batch.column("doc_id").to_pylist(), words.counts.tolist())):
                    if n and (rule := rewrite(doc, n)):
                        a, p = rule
                        source[before[d] + a : before[d + 1]] = before[d] + a + np.arange(n - a) % p
                ids = ids[source]
            start, length, period = runs_of_words(ids, owner, least)
            change = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            kept = np.cumsum(change[:-1]) == 0
            ends = np.concatenate([[0], np.cumsum(kept)])[before[1:]]
            held = np.searchsorted(start, before)
            runs = pa.StructArray.from_arrays([pa.array(start - before[np.searchsorted(before, start, side="right") - 1]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words.counts), pa.ListArray.from_arrays(pa.array(held, pa.int32()), runs), words.joined(source[kept], ends).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return narrow(docs, id_col, text_col).mapInArrow(tidied(find), RUNS)


def run_digests(found: DataFrame) -> DataFrame:
    """The digest columns of `periodic_runs`: doc_id, n_runs, the longest run (ties: smallest start, then period), hashes of all runs and of the text left."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
