import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgraph.llm.language import fit, identify, keep_identified
from loamgraph.llm.quality import BUCKETS, features, resample, threshold

from .helpers import awkward, table

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = fit(docs.where("doc_id % 2 = 0"), sample_rows=300)
    rows = identify(docs.where("doc_id % 2 = 1"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.language == r.lang for r in rows) / len(rows) > 0.97
    assert sum(r.accepted for r in rows) / len(rows) > 0.97


def test_evidence_decides_short_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = fit(docs, sample_rows=300)
    rows = [(1, "de", "plain.org", ""), (2, "de", "x.fr", ""), (3, "de", "plain.org", '<html lang="fr">'), (4, "\x01\x02\x03" * 300, "plain.org", ""), (5, None, "x.fr", ""), (6, "qqq", None, None)]
    found = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, source string, page string"), model, markup_col="page").collect()}
    assert found[5].language is None and not found[5].accepted
    assert not found[4].accepted
    long_text = docs.where("lang = 'de'").limit(1).first().text
    mixed = spark.createDataFrame([(1, long_text[:12], "a.de"), (2, long_text[:12], "b.fr"), (3, long_text, "b.fr")], "doc_id long, text string, source string")
    judged = {r.doc_id: r for r in identify(mixed, model).collect()}
    assert judged[3].language == "de" and judged[1].language == "de"


def test_language_edges(spark):
    docs = table(spark, awkward(random.Random(1)))
    out = keep_identified(docs)
    assert out.columns == docs.columns and out.where("text is null or text = ''").count() == 0
    assert keep_identified(table(spark, [])).count() == 0
    assert identify(docs, fit(docs.withColumn("lang", F.lit(None).cast("string")))).where("accepted").count() == 0


def test_features():
    slots, before = features([b"a b c", b"", b"one", b" A  b "])
    assert before.tolist() == [0, 5, 5, 6, 9]
    assert slots[0] == slots[6] and slots[1] == slots[7] and (slots < BUCKETS).all()


@pytest.mark.parametrize("k", [1, 7, 50, 99, 100])
def test_exact_top_k(spark, k):
    rng = np.random.default_rng(k)
    values = np.concatenate([rng.integers(-(2**62), 2**62, 60), np.full(40, 12345)]).tolist()
    t, more = threshold(spark.createDataFrame([(v,) for v in values], "x long"), "x", k)
    ordered = sorted(values, reverse=True)
    assert t == ordered[k - 1] and sum(v > t for v in values) + more == k


def test_resampling(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    rows = resample(docs, train, keep=0.85).collect()
    assert sum(r.kept for r in rows) == int(np.ceil(0.85 * docs.count())) and len(rows) == docs.count()
    held = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1").collect()}
    good = [r.kept for r in rows if held.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if held.get(r.doc_id) == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def test_resampling_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert resample(table(spark, []), labels).count() == 0
    rows = resample(table(spark, awkward(random.Random(2))), labels, keep=0.5).collect()
    assert sum(r.kept for r in rows) == -(-len(rows) // 2)
    assert len(resample(table(spark, ["a", "a", None], [None, 1, 1]), labels.limit(0)).collect()) == 3


def test_rare_languages_are_fitted(spark):
    common = [(i, f"the common words of row {i} and nothing else", "en", "s") for i in range(600)]
    rare = [(1000 + i, "ŋŵâ ẑôŧ ĝĥĵ " * 20 + str(i), "xx", "s") for i in range(3)]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, lang string, source string")
    model = fit(docs, sample_rows=20)
    assert model.languages == ("en", "xx")
    found = {r.doc_id: r for r in identify(docs, model).collect()}
    assert all(found[1000 + i].language == "xx" and found[1000 + i].accepted for i in range(3))
    # Identical rows don't keep a language out, whichever side of the limit their hash falls on.
    copies = spark.createDataFrame([(None, "ŋŵâ ẑôŧ ĝĥĵ " * 20, "xx", "s")] * 500 + common, "doc_id long, text string, lang string, source string")
    assert identify(copies, fit(copies, sample_rows=20)).where("doc_id is null and language = 'xx' and accepted").count() == 500


def test_fusion_against_bayes(spark):
    """Every posterior against Bayes' rule in plain Python, over texts, declarations, suffixes and hosts."""
    from loamgraph.llm import language as L

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = fit(docs, sample_rows=200)
    langs, rng = list(model.languages), random.Random(3)
    texts = [r.text for r in docs.limit(60).collect()]
    rows = []
    for i in range(200):
        text = rng.choice(texts)
        a = rng.randint(0, len(text) // 2)
        suffix, declared = rng.choice([*langs, "org"]), rng.choice([*langs, "zz", None])
        rows.append((i, text[a : a + rng.choice([0, 2, 3, 5, 9, 30])], f"h{rng.randint(0, 6)}.{suffix}", f'<html lang="{declared}">' if declared else ""))
    found = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string, source string, page string"), model, markup_col="page").collect()}
    scores, sizes = L.text_scores(model, [r[1].encode() for r in rows])

    def shares(logs):
        e = np.exp(np.array(logs) - max(logs))
        return e / e.sum()

    def evidence(name, right):
        return [0.0 if name not in langs else np.log(right if x == name else (1 - right) / (len(langs) - 1)) for x in langs] + [0.0]

    evidences, hosts, suffixes = [], {}, {}
    flat = [np.log((1 - L.NO_LANGUAGE) / len(langs))] * len(langs) + [np.log(L.NO_LANGUAGE)]
    for (_, _, host, page), own, n in zip(rows, scores, sizes):
        suffix, declared = host.split(".")[1], page.split('"')[1] if page else ""
        evidences.append(own + evidence(declared, L.DECLARED_RIGHT) + evidence(suffix, L.SUFFIX_RIGHT))
        if n:
            soft = shares(evidences[-1] + flat)[:-1]
            hosts[host] = hosts.get(host, 0) + soft
            suffixes[suffix] = suffixes.get(suffix, 0) + soft
    whole = sum(suffixes.values())
    overall = (whole + 1) / (whole.sum() + len(langs))
    for (i, _, host, _), logs, n in zip(rows, evidences, sizes):
        if not n:
            assert found[i].language is None and not found[i].accepted
            continue
        near = suffixes[host.split(".")[1]]
        near = (near + L.STRENGTH * overall) / (near.sum() + L.STRENGTH)
        prior = (hosts[host] + L.STRENGTH * near) / (hosts[host].sum() + L.STRENGTH)
        p = shares(logs + np.append(np.log((1 - L.NO_LANGUAGE) * prior), np.log(L.NO_LANGUAGE)))
        assert abs(found[i].posterior - p.max()) < 2e-6
        if np.sort(p)[-1] - np.sort(p)[-2] > 1e-6:
            assert found[i].language == [*langs, None][int(p.argmax())]


def test_each_evidence_turns_a_decision(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = fit(docs, sample_rows=200)
    a, b = model.languages[:2]
    neutral = "\x00\x00\x00"
    # As many documents of either language, so that neither is likely from the start.
    texts = [(r.text, host) for lang, host in ((a, "known"), (b, "other")) for r in docs.where(F.col("lang") == lang).limit(40).collect()]
    own = [(100 + i, text, host, "", "") for i, (text, host) in enumerate(texts)]
    rows = [(1, neutral, "u1", f'<p lang="{a}">', ""), (2, neutral, "u2", f'<p lang="{b}">', ""), (3, neutral, "u3", "", f"x.{a}"), (4, neutral, "u4", "", f"x.{b}"), (5, neutral, "known", "", ""), (6, neutral, "other", "", "")]
    table_ = spark.createDataFrame(rows + own, "doc_id long, text string, host string, page string, url string")
    found = {r.doc_id: r.language for r in identify(table_, model, host_col="host", markup_col="page", address_col="url").collect()}
    assert [found[i] for i in (1, 2, 3, 4, 5, 6)] == [a, b, a, b, a, b]


def test_resampling_against_plain_counts(spark):
    """Ratios, weights, variates and the k largest keys, each in plain Python."""
    from collections import Counter

    from loamgraph.llm import quality as Q
    from loamgraph.llm.text import mix64

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    slots = {i: features([t])[0].tolist() for i, t in texts.items()}
    raw, target = Counter(), Counter()
    for i, own in slots.items():
        raw.update(own)
        if i in good:
            target.update(own)
    p, q = (sum(c.values()) + BUCKETS for c in (target, raw))
    ratio = lambda s: np.log((target[s] + 1) / p) - np.log((raw[s] + 1) / q)
    lowest = min(ratio(s) for s in range(BUCKETS))
    keys = {}
    rows = {r.doc_id: r for r in resample(docs, labels, keep=0.6).collect()}
    for i, own in slots.items():
        weight = np.mean([ratio(s) for s in own]) * min(len(own), Q.STRENGTH) if own else lowest * Q.STRENGTH
        h = mix64(mix64(np.array([i], dtype=np.uint64)) + np.uint64(7))[0]
        keys[i] = weight - np.log(-np.log((float(int(h) >> 11) + 0.5) / 2**53))
        assert abs(rows[i].log_weight - weight) < 1e-6 and abs(rows[i].sort_key - keys[i]) < 1e-6
    k = int(np.ceil(0.6 * len(texts)))
    assert {i for i, r in rows.items() if r.kept} == set(sorted(keys, key=keys.get, reverse=True)[:k])
