"""Runs against brute force: the tandem repeat method on small alphabets, and whole documents."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loamgraph.llm.periods import periodic_runs, run_digests
from loamgraph.llm.queries import planted_period
from loamgraph.llm.tandem import maximal_runs

from .helpers import awkward, table


def runs_by_hand(words, least=2):
    """All maximal runs, by trying every period."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(words[i : j + q - d] == words[i + d : j + q] for d in range(1, q)):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted((s, n, q) for s, n, q in found)


def periodic(rng, n, symbols):
    words = [rng.randrange(symbols) for _ in range(n)]
    p = rng.randint(1, max(1, n))
    return [words[i % p] for i in range(n)] if rng.random() < 0.4 else words


def test_maximal_runs_of_small_alphabets():
    rng = random.Random(5)
    for _ in range(1500):
        words = periodic(rng, rng.randint(0, 40), rng.choice([1, 2, 2, 3, 4]))
        start, length, period = maximal_runs(np.array([-1, *words, 10**6]))
        assert sorted(zip((start - 1).tolist(), length.tolist(), period.tolist())) == runs_by_hand(words)


def digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    rule = planted_period(doc_id, len(words)) if words else None
    if rule:
        words = words[: rule[0]] + [words[rule[0] + i % rule[1]] for i in range(len(words) - rule[0])]
    runs = runs_by_hand(words, 12)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best and (*best, 1000 * best[1] // best[2]) or (None,) * 4),
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return [*awkward(rng), *(" ".join(map(str, periodic(rng, rng.randint(0, 150), rng.choice([1, 2, 3, 40])))) for _ in range(150)), "a b c " * 5 + "d e f g h i j " * 3, "é " * 3000, " ".join(f"w{i % 700}" for i in range(3000))]


def test_documents(spark, texts):
    ids = [None if i % 40 == 7 else -(2**63) if i % 40 == 8 else i % 97 for i in range(len(texts))]
    docs = table(spark, texts, ids)
    got = [tuple(r) for r in run_digests(periodic_runs(docs.union(docs), rewrite=planted_period)).collect()]
    want = [digest(i, t) for i, t in zip(ids, texts)] * 2
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids if i is not None)


def test_runs_and_text_left(spark):
    row = periodic_runs(table(spark, ["x " + "a b c " * 5 + "y"])).first()
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed) == (17, [(1, 15, 3)], "x a b c y")


def test_empty_table(spark):
    assert run_digests(periodic_runs(table(spark, []))).count() == 0
