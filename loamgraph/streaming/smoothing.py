"""Exponential smoothing and change flags over a stream, in order of event time whatever the order of arrival."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key string, event_id long, sec long, value double, ewma double, changed boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Held rows: those of one slot of time are sorted together, and so many are written or given out at once.
ROW = np.dtype([("ms", np.int64), ("event_id", np.int64), ("value", np.float64)])
SLOT_MS, WRITTEN, GIVEN = 86_400_000, 100_000, 10_000


class Smoother(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then smooths them in order of time and id.

    State: the rows held, packed in blocks by slots of time, each slot's blocks and first row, and the last smoothed value with its time.  Only one slot's
    rows are in memory at once.  A timer at the first held row's time fires once the watermark is
    there; a key without held rows has no timer.  After `idle_ms` without rows a key's value is let go, so that a key that comes back starts anew.
    """

    def __init__(self, rate: float, threshold: float, idle_ms: int):
        self.rate, self.threshold, self.idle_ms = rate, threshold, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.blocks = handle.getMapState("blocks", "slot long, number int", "rows binary")
        self.slots = handle.getMapState("slots", "slot long", "blocks int, first long")
        self.last = handle.getValueState("last", "ms long, ewma double")

    def _known(self) -> dict[int, tuple[int, int]]:
        """The slots with held rows: how many blocks, and the first row's time."""
        return {slot: (blocks, first) for (slot,), (blocks, first) in self.slots.iterator()} if self.slots.exists() else {}

    def _hold(self, rows: np.ndarray, known: dict[int, tuple[int, int]]) -> None:
        slot = rows["ms"] // SLOT_MS
        rows = rows[np.argsort(slot, kind="stable")]
        for s, n in zip(*(x.tolist() for x in np.unique(slot, return_counts=True))):
            own, rows = rows[:n], rows[n:]
            number, first = known.get(s, (0, int(own["ms"][0])))
            self.blocks.updateValue((s, number), (own.tobytes(),))
            known[s] = (number + 1, min(first, int(own["ms"].min())))
            self.slots.updateValue((s,), known[s])

    def _take(self, slot: int, blocks: int) -> np.ndarray:
        """A slot's rows, sorted, which are held no longer."""
        rows = np.concatenate([np.frombuffer(self.blocks.getValue((slot, i))[0], ROW) for i in range(blocks)])
        for i in range(blocks):
            self.blocks.removeKey((slot, i))
        self.slots.removeKey((slot,))
        return rows[np.lexsort((rows["value"], rows["event_id"], rows["ms"]))]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, first, held, n = None, None, [], 0
        for batch in rows:
            batch = batch[batch["value"].notna()]
            if len(batch):
                own = np.empty(len(batch), ROW)
                for c in ROW.names:
                    own[c] = batch[c]
                low = int(own["ms"].min())
                first = low if first is None else min(first, low)
                held.append(own)
                n += len(own)
            if n >= WRITTEN:
                known = self._known() if known is None else known
                self._hold(np.concatenate(held), known)
                held, n = [], 0
        if held:
            self._hold(np.concatenate(held), self._known() if known is None else known)
        if first is not None:
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        ms, mean = self.last.get() if self.last.exists() else (None, None)
        for slot in sorted(s for s, (_, first) in known.items() if first <= now):
            rows = self._take(slot, known.pop(slot)[0])
            ready = int(np.searchsorted(rows["ms"], now, side="right"))
            if ready < len(rows):
                self._hold(rows[ready:], known)
            for a in range(0, ready, GIVEN):
                out = []
                for at, event_id, value in rows[a : min(ready, a + GIVEN)].tolist():
                    if ms is None or at - ms > self.idle_ms:
                        mean = value
                    else:
                        mean += (1 - math.exp(-self.rate * (at - ms) / 1000)) * (value - mean)
                    ms = at
                    out.append((key[0], event_id, at // 1000, value, mean, abs(value - mean) > self.threshold))
                yield pd.DataFrame(out, columns=["key", "event_id", "sec", "value", "ewma", "changed"])
            self.last.update((ms, mean))
        if known:
            self.handle.registerTimer(min(first for _, first in known.values()))
        elif ms is not None and now - ms > self.idle_ms:
            self.last.clear()
        elif ms is not None:
            self.handle.registerTimer(ms + self.idle_ms + 1)

    def close(self) -> None:
        pass


def smoothed(stream: DataFrame, rate: float, threshold: float, late: str = "1 hour", idle: float = 365 * 86400.0) -> DataFrame:
    """key, event_id, sec, value, ewma, changed: value is smoothed with alpha = 1 - exp(-rate * seconds since the key's row before).

    Rows of equal time go by id.  Rows come out once the watermark, `late` behind the newest row, has passed them; rows that arrive behind it are dropped, null values are
    skipped, and after `idle` seconds without a row a key starts anew.  A key's first value is smoothed to itself.  The session needs the RocksDB state store (`rocks`).
    """
    rows = stream.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value").withWatermark("ts", late)
    rows = rows.withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("key").transformWithStateInPandas(Smoother(rate, threshold, int(idle * 1000)), OUT, "append", "eventTime")


class rocks:
    """While it is open, queries that start keep their state in RocksDB."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.before = self.conf.get(STORE, None)
        self.conf.set(STORE, ROCKS)

    def __exit__(self, *_) -> None:
        self.conf.unset(STORE) if self.before is None else self.conf.set(STORE, self.before)
