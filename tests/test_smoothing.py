"""The smoothing stream: several micro-batches out of order, late rows, keys that come back."""

import math
import random

import pandas as pd
import pytest

from loamgraph.streaming import series as stream
from loamgraph.streaming import smoothing

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def by_hand(rows, rate, idle):
    out, last = {}, {}
    for key, sec, i, value in sorted(rows):
        before, mean = last.get(key, (None, None))
        mean = value if before is None or sec - before > idle else mean + (1 - math.exp(-rate * (sec - before))) * (value - mean)
        last[key] = (sec, mean)
        out[i] = mean
    return out


def test_batches_out_of_order(spark, tmp_path):
    rng = random.Random(6)
    rows = [(key, 1_000_000 + 60 * k + rng.randint(0, 50), 2 * k + j, round(rng.uniform(0, 100), 3)) for k in range(150) for j, key in enumerate("ab") if key == "a" or not 40 < k < 110]
    # Up to 20 minutes late, over five files in order of arrival; then one row far behind the watermark and one without a value.
    arrival = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 1200))
    batches = [arrival[len(arrival) * i // 5 : len(arrival) * (i + 1) // 5] for i in range(5)]
    batches.append([("a", 1_000_000, 9000, 50.0), ("a", 1_020_000, 9001, None), ("b", 1_020_000, 9002, 1.0)])
    batches.append([("a", 1_030_000, 9003, 5.0), ("b", 1_030_001, 9004, 6.0)])
    for k, batch in enumerate(batches):
        frame = spark.createDataFrame([(i, s, key, v) for key, s, i, v in batch], "event_id long, sec long, event_type string, value double")
        frame.selectExpr("event_id", "timestamp_seconds(sec) AS ts", "0L AS user_id", "event_type", "value", "'' AS props").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(k)))
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    idle = 3600.0
    with smoothing.rocks(spark):
        out = stream.drained(smoothing.smoothed(source, 0.001, 20.0, "30 minutes", idle), str(tmp_path / "out"))
    got = {r.event_id: r for r in out.collect()}
    want = by_hand([r for r in rows + [("b", 1_020_000, 9002, 1.0)]], 0.001, idle)
    passed = {i for key, s, i, v in rows}
    assert passed <= set(got) and 9000 not in got and 9001 not in got
    for i in passed:
        assert got[i].ewma == pytest.approx(want[i]), i
        assert got[i].changed == (abs(got[i].value - want[i]) > 20)


def test_a_key_holds_one_slot_of_time_and_gives_out_parts(spark, tmp_path):
    rng = random.Random(8)
    days = 3
    rows = [("a", rng.randrange(86_400 * days), i, round(rng.uniform(0, 100), 3)) for i in range(days * 8000)] + [("a", 86_400 * days + 7200, -1, 1.0)]
    frame = spark.createDataFrame([(i, s, key, v) for key, s, i, v in rows], "event_id long, sec long, event_type string, value double")
    frame.selectExpr("event_id", "timestamp_seconds(sec) AS ts", "0L AS user_id", "event_type", "value", "'' AS props").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    with smoothing.rocks(spark):
        out = stream.drained(smoothing.smoothed(source, 0.001, 20.0), str(tmp_path / "out"))
    got, want = {r.event_id: r.ewma for r in out.collect()}, by_hand(rows[:-1], 0.001, math.inf)
    assert got == pytest.approx(want)

    class Kept:
        """A state of one key, in memory."""

        def __init__(self):
            self.rows, self.timers, self.most = {}, [], 0

        def getMapState(self, name, *_):
            return Table(self, name)

        def getValueState(self, name, *_):
            return Table(self, name)

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Table:
        def __init__(self, kept, name):
            self.kept, self.own = kept, kept.rows.setdefault(name, {})

        def exists(self):
            return bool(self.own)

        def iterator(self):
            return iter(list(self.own.items()))

        def getValue(self, key):
            return self.own[key]

        def get(self):
            return self.own[()]

        def updateValue(self, key, value):
            self.kept.most = max([self.kept.most, *(len(v) for v in value if isinstance(v, bytes))])
            self.own[key] = value

        def update(self, value):
            self.own[()] = value

        def removeKey(self, key):
            del self.own[key]

        def clear(self):
            self.own.clear()

    class Now:
        def getCurrentWatermarkInMs(self):
            return 86_400_000 * days + 1000

    state, worker = Kept(), smoothing.Smoother(0.001, 20.0, 10**12)
    worker.init(state)
    frames = (pd.DataFrame([(s * 1000, i, v) for _, s, i, v in rows[a : a + 5000]], columns=["ms", "event_id", "value"]) for a in range(0, len(rows), 5000))
    assert list(worker.handleInputRows(("a",), frames, Now())) == []
    assert len(state.rows["slots"]) == days + 1 and state.most < 24 * 8500
    parts = list(worker.handleExpiredTimer(("a",), Now(), None))
    # All rows that are ready come out, in parts; the one ahead of the watermark stays, with its timer.
    assert len(parts) == days and max(map(len, parts)) < 8500 and sum(map(len, parts)) == days * 8000
    assert dict(pd.concat(parts)[["event_id", "ewma"]].values) == pytest.approx(want)
    assert list(state.rows["slots"]) == [(days,)] and state.timers[-1] == (86_400 * days + 7200) * 1000
