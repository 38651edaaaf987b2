"""The hysteresis stream's function, without a session."""

import random
from unittest.mock import MagicMock

import pandas as pd

from loamgraph.streaming import series as stream


def test_hysteresis_gives_out_parts(monkeypatch):
    """The function that takes a key's rows, called with a state in memory."""
    caught = {}

    class Rows:
        def select(self, *_):
            return self

        def groupBy(self, *_):
            return self

        def applyInPandasWithState(self, step, *_):
            caught["step"] = step

    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value

    monkeypatch.setattr(stream, "F", MagicMock())
    stream.hysteresis(Rows(), 50.0, 10.0)
    rng = random.Random(4)
    rows = [(pd.Timestamp(rng.randrange(10**6), unit="s"), i, rng.choice([rng.uniform(0, 100), 55.0, None])) for i in range(25_000)]
    state = State()
    parts = list(caught["step"](("k",), (pd.DataFrame(rows[a : a + 9000], columns=["ts", "event_id", "value"]).astype({"value": float}) for a in range(0, len(rows), 9000)), state))
    side, want = None, []
    for _, i, v in sorted(rows, key=lambda r: r[:2]):
        side = None if v is None else "H" if v > 60 else "L" if v <= 40 else side or ("H" if v > 50 else "L")
        if v is not None:
            want.append(("k", i, side, max(v, 60.0) if side == "H" else min(v, 40.0)))
    assert len(parts) == 3 and max(map(len, parts)) <= 10_000
    assert [tuple(r) for r in pd.concat(parts).values] == want and state.kept == (side,)
