import hashlib
import random
import re

from loamgraph.llm.exact_dedup import drop_copies, exact_groups

from .helpers import awkward, table


def brute(ids, texts):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    out = []
    for i, n in zip(ids, norm):
        own = [j for j, m in zip(ids, norm) if m == n]
        out.append((i, min(own), len(own), i == min(own), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out)


def test_against_brute_force(spark):
    texts = awkward(random.Random(1)) + ["same  text", "same\ttext", "same text ", "É", "é"]
    ids = [5 * i % 101 for i in range(len(texts))]
    rows = exact_groups(table(spark, texts, ids)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == brute(ids, texts)


def test_collisions_are_told_apart(spark, monkeypatch):
    import loamgraph.llm.exact_dedup as E
    from pyspark.sql import functions as F

    monkeypatch.setattr(E, "key128", lambda name: F.unhex(F.md5(F.length(F.col(name)).cast("string"))))
    texts = ["aa", "bb", "aa", "ccc", None]
    rows = E.exact_groups(table(spark, texts)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == [(0, 0, 2, True), (1, 1, 1, True), (2, 0, 2, False), (3, 3, 1, True), (4, 4, 1, True)]


def test_nulls_and_empty(spark):
    rows = exact_groups(table(spark, ["a", "a", None, ""], [None, 3, 8, 7])).collect()
    assert sorted(map(str, [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows])) == sorted(map(str, [(None, None, 2, True), (3, None, 2, False), (8, 7, 2, False), (7, 7, 2, True)]))
    assert exact_groups(table(spark, [])).count() == 0


def test_drop_copies(spark):
    docs = table(spark, ["a b", "a  b", "c", None, ""], [4, 2, 1, 9, 8])
    out = drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 8]
