import random
import re

import numpy as np
import pytest

import loamgraph.llm.jaccard as jaccard
from loamgraph.llm.jaccard import keep_one, similarity_components
from loamgraph.llm.signature_tree import bitmap, build, dual_join

from .helpers import awkward, table


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(ids, texts, width, percent):
    sets = [shingle_set(t, width) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, d in enumerate(ids))


def family(rng, size, edits, words=120):
    base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"e{rng.randint(0, 9999)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("width,percent,block", [(3, 90, 512), (5, 80, 512), (3, 90, 4), (2, 60, 4)])
def test_against_brute_force(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rng = random.Random(width)
    texts = awkward(rng) + family(rng, 60, 4) + family(rng, 60, 9) + family(rng, 30, 14, 60) + [" ".join(rng.choice("ab c d e f g h".split()) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    rng.shuffle(texts)
    ids = list(range(100, 100 + len(texts)))
    rows = similarity_components(table(spark, texts, ids), width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute(ids, texts, width, percent)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_tree_visits_every_link(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        for _ in range(4):
            keep = base[rng.random(len(base)) > rng.random() * 0.2]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, 3).astype(np.uint64)])))
    seen = set()
    dual_join(build([len(s) for s in sets], [bitmap(s) for s in sets]), percent, lambda i, j: seen.add((min(i, j), max(i, j))), lambda x, y: False)
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in seen
    assert len(seen) < len(sets) * (len(sets) - 1) // 4


def test_nulls_repeated_rows_and_empty(spark):
    text = "one two three four five"
    rows = similarity_components(table(spark, [text, text, text.upper(), None, "\t", "x"], [None, 4, 4, 9, 8, 7])).collect()
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id) for r in rows])) == sorted(map(str, [(None, 3, None), (4, 3, None), (4, 3, None), (9, 0, 9), (8, 0, 8), (7, 1, 7)]))
    assert similarity_components(table(spark, [])).count() == 0


def test_keep_one(spark):
    rng = random.Random(5)
    texts = family(rng, 5, 1) + ["short", None, None]
    out = keep_one(table(spark, texts))
    assert sorted(r.doc_id for r in out.collect()) == [0, 5, 6, 7]
    assert out.columns == table(spark, texts).columns


@pytest.mark.parametrize("words", [1, 2, 3, 4])
def test_a_partition_shorter_than_a_shingle(spark, words):
    text = " ".join("abcd"[:words])
    assert [len(s) for s in jaccard.shingles([text.encode()], 5)] == [1]
    docs = table(spark, [text, text + " e f g h"]).repartition(2, "doc_id")
    assert keep_one(docs, width=5, percent=80).count() == 2
