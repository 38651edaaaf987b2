import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loamgraph.llm.fingerprints import _ranges, document_fingerprints, edited, fingerprints, likeness, written
from loamgraph.llm.text import mix64
from loamgraph.llm.winnow import gram_hashes, window_minima

from .helpers import awkward, table


@pytest.mark.parametrize("k,w,block", [(4, 5, 1 << 20), (4, 5, 64), (16, 64, 200), (1, 1, 50), (8, 3, 1 << 20)])
def test_windows_by_brute_force(monkeypatch, k, w, block):
    monkeypatch.setattr("loamgraph.llm.winnow.BLOCK", block)
    rng = np.random.default_rng(k * 100 + w)
    docs = [rng.integers(0, 3, n) for n in (0, 1, k, k + w - 2, k + w - 1, 90, 400, 1000)]
    values = mix64(np.concatenate(docs).astype(np.uint64) + np.uint64(5))
    sizes = np.array([len(d) for d in docs])
    doc, pos, h, lo, hi = window_minima(values, sizes, k, w)
    got = {(d, s): p for d, p, a, b in zip(doc.tolist(), pos.tolist(), lo.tolist(), hi.tolist()) for s in range(a, b + 1)}
    before = np.concatenate([[0], np.cumsum(sizes)])
    expected = {}
    for i, n in enumerate(sizes.tolist()):
        if n >= k:
            keys = (gram_hashes(values[before[i] : before[i] + n], k)[: n - k + 1] >> np.uint64(24)).tolist()
            for s in range(n - k - w + 2):
                expected[i, s] = min(range(s, s + w), key=lambda p: (keys[p], -p))
    assert got == expected


def test_shared_run_is_found():
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    for _ in range(30):
        run = text(16 + 64 - 1)
        a, b = fingerprints([text(300) + run + text(200), text(111) + run + text(20)])
        assert set(a[:, 1].tolist()) & set(b[:, 1].tolist())


def test_against_plain_rules(spark):
    texts = awkward(random.Random(2))
    ids = [7 * i + 1 for i in range(len(texts))]
    rows = {r.doc_id: r for r in document_fingerprints(table(spark, texts[::-1], ids[::-1])).collect()}
    assert sorted(rows) == ids
    plain = [t or "" for t in texts]
    for k, i in enumerate(ids):
        after = plain[(k + 1) % len(plain)]
        half = len(plain[k]) // 2
        new = plain[k][: len(plain[k]) - half] + after[:half]
        assert new == edited(plain[k], after)
        a, b, c = fingerprints([plain[k]])[0], fingerprints([new])[0], fingerprints([after])[0]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(plain[k]), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (written(a), written(b))
        assert (r.near_edited, r.near_next) == (likeness(a, b), likeness(a, c))


def test_edges(spark):
    assert document_fingerprints(table(spark, [])).count() == 0
    (one,) = document_fingerprints(table(spark, ["abcd"], [9])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    rows = document_fingerprints(table(spark, ["b" * 90, "a" * 90, None, "a" * 90], [4, 4, None, 4])).collect()
    assert len(rows) == 4 and len({r.fingerprint for r in rows if r.n_chars}) == 2


def test_memory_of_a_task_is_bounded():
    """Comparing takes memory by blocks of texts, however large the batch: 4,000,000 characters come in one here."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh ", k=2000)) for _ in range(2000)]
    n = len(texts)
    columns = {"target": pa.array([0] * n, pa.int32()), "after": pa.array([0] * (n - 1) + [1], pa.int32()), "doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts)}
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    tracemalloc.start()
    try:
        rows = sum(out.num_rows for out in _ranges(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == n - 1
    assert peak < 40e6


def test_one_python_worker_a_task(spark):
    plan = document_fingerprints(table(spark, ["a" * 90, "b"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
