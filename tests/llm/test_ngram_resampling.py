"""Resampling by n-grams against plain counts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pyspark.sql.functions as F
import pytest

from loamgraph.llm import ngram_resampling
from loamgraph.llm.ngram_resampling import importance_resample, ranked

from .helpers import awkward, table
from .test_decontaminate import benchmark, words_of


def grams_of(text, longest):
    words = words_of(text)
    return Counter(" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1))


def by_hand(rows, target, longest, buckets, least, percent):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    spread = lambda texts: sum((Counter({}) if t is None else Counter(bucket(g) for g, n in grams_of(t, longest).items() for _ in range(n)) for t in texts), Counter())
    s, t = spread([x for _, x in rows]), spread(target)
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s.total() + buckets)) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for doc, text in rows:
        grams = grams_of(text, longest)
        weight = sum(n * gain(bucket(g)) for g, n in grams.items())
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, grams.total(), weight, score, None, len(words_of(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return sorted(str(tuple(r[:5])) for r in out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    texts = awkward(rng) + [" ".join(rng.choice("the of and É é b2".split() + [f"w{rng.randrange(99)}"]) + rng.choice(["", ",", ".\n"]) for _ in range(rng.randint(0, 80))) for _ in range(120)]
    ids = [None if i % 30 == 7 else -(2**63) if i % 30 == 8 else i % 90 for i in range(len(texts))]
    return list(zip(ids, texts)) * 2


@pytest.mark.parametrize("longest, buckets, least, percent", [(1, 10_000, 20, 10), (2, 50, 5, 50), (3, 1000, 0, 100)])
def test_documents(spark, rows, longest, buckets, least, percent):
    target = ["the w1 w2 of w3.", None, "b2 b2", "", "w7 É"]
    docs = table(spark, [t for _, t in rows], [i for i, _ in rows])
    got = importance_resample(docs, benchmark(spark, [("1", t) for t in target]), longest, buckets, least, percent).collect()
    assert sorted(str(tuple(r)) for r in got) == by_hand(rows, target, longest, buckets, least, percent)


def test_empty_tables(spark):
    docs, none = table(spark, ["a b c " * 9, None]), benchmark(spark, [])
    got = importance_resample(docs, none, percent=100).orderBy("doc_id").collect()
    assert [(r.n_features, r["rank"]) for r in got] == [(27, 1), (0, None)]
    assert importance_resample(docs.limit(0), benchmark(spark, [("1", "a")])).count() == 0


def test_ranks_of_equal_rows_follow_each_other(spark):
    rows = spark.range(5000).selectExpr("id", "1 AS score")
    got = ranked(rows, [F.col("score").desc(), F.col("id").asc()], "ranks").orderBy("id").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))


def test_nothing_grows_with_the_distinct_words(spark, monkeypatch):
    written = {}

    def counted(df, name, keep=ngram_resampling.staged):
        out = keep(df, name)
        written[name] = (out.count(), any(f.dataType.typeName() == "array" for f in out.schema))
        return out

    monkeypatch.setattr(ngram_resampling, "staged", counted)
    texts = [" ".join(f"w{300 * i + j}" for j in range(300)) for i in range(50)]
    ngram_resampling.importance_resample(table(spark, texts), benchmark(spark, [("1", "w1 w2")]), buckets=100, least_words=0).count()
    # 15,000 distinct words: at most a row for each bucket or document is written, and no array of a block's words.
    assert written and all(rows <= 100 and not arrays for rows, arrays in written.values()), written
