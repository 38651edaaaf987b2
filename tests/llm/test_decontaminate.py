"""Decontamination against a search of every window in every text."""

import hashlib
import random
import re

import pytest

from loamgraph.llm.decontaminate import contamination, contamination_digests

from .helpers import awkward, table

ITEM = "item_id string, text string, rid long, window string, n long"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(doc_id, text, items, size):
    words, hit, found = words_of(text), set(), set()
    for item, own in items:
        own = words_of(own)
        n = min(size, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item or "")
    return (doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1, "w", 2) for i, t in items], ITEM)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    passage = lambda n, k=6: " ".join(rng.choice("the of and a é B2 c_d to".split() + [f"w{rng.randrange(k)}"]) for _ in range(n))
    items = [(str(i), passage(rng.choice([1, 2, 3, 5, 9, 10, 11, 30]) if i < 8 else rng.randint(8, 40), 200)) for i in range(30)]
    items += [("3", passage(15)), (None, passage(12)), ("x", None), ("y", "?!"), ("z", items[4][1]), ("long", "q r s"), items[9]]
    texts = awkward(rng)
    for _ in range(120):
        parts = [passage(rng.randint(0, 40), 300)]
        for _ in range(rng.randint(0, 3)):
            own = words_of(rng.choice(items)[1])
            a = rng.randint(0, len(own))
            parts += [", ".join(own[a : a + rng.randint(1, 30)]).upper(), passage(rng.randint(0, 10), 300)]
        texts.append(" ".join(parts))
    return items, texts


@pytest.mark.parametrize("size, shingle", [(10, 3), (4, 2), (3, 3), (12, 1)])
def test_documents(spark, corpus, size, shingle):
    items, texts = corpus
    ids = [None if i % 30 == 7 else -(2**63) if i % 30 == 8 else i % 70 for i in range(len(texts))]
    docs = table(spark, texts, ids)
    got = [tuple(r) for r in contamination_digests(contamination(docs.union(docs), benchmark(spark, items), size, shingle)).collect()]
    want = [by_hand(i, t, items, size) for i, t in zip(ids, texts)] * 2
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert 20 < sum(w[-1] for w in want) < 2 * len(texts)


def test_full_filter_changes_nothing(spark, corpus, monkeypatch):
    from loamgraph.llm import decontaminate

    monkeypatch.setattr(decontaminate, "LEAST_SLOTS", 4)
    monkeypatch.setattr(decontaminate, "MOST_SLOTS", 4)
    items, texts = corpus
    got = [tuple(r) for r in contamination_digests(contamination(table(spark, texts[:60]), benchmark(spark, items))).collect()]
    assert sorted(map(str, got)) == sorted(str(by_hand(i, t, items, 10)) for i, t in enumerate(texts[:60]))


def test_empty_tables(spark):
    docs, none = table(spark, ["a b c", None]), benchmark(spark, [])
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in contamination(docs, none).collect()) == [(0, 0, []), (3, 0, [])]
    assert contamination(docs.limit(0), benchmark(spark, [("1", "a b c")])).count() == 0
    assert [r.n_hit for r in contamination(docs, benchmark(spark, [("1", "A, b!")])).orderBy("doc_id").collect()] == [2, 0]
