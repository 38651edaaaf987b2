import hashlib
import random

import pyarrow as pa
import pytest
import xxhash

from loamgraph.llm.repeats import _finer, drop_repeats, finer_widths, repeat_digests
from loamgraph.llm.suffix import SEPARATOR, Block, common_prefixes, repeated_starts, suffix_order

from .helpers import awkward, table


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            count[r[i : i + length]] = count.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_suffix_order_and_prefixes(seed):
    rng = random.Random(seed)
    depth = rng.choice([3, 8, 9, 16, 20])
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 60))).encode() for _ in range(5)]
    texts += texts[: seed % 3] + [b"a" * (seed % 50)]
    data = SEPARATOR.join(texts) + SEPARATOR
    block = Block(data, depth)
    order = suffix_order(block)
    assert sorted(order.tolist()) == list(range(len(data)))
    cut = [data[i : i + depth] for i in order]
    assert cut == sorted(cut)
    for (a, b), n in zip(zip(order, order[1:]), common_prefixes(block, order)):
        x, y = data[a : a + depth], data[b : b + depth]
        assert n == next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    count = {}
    for t in texts:
        for i in range(len(t) - depth + 1):
            count[t[i : i + depth]] = count.get(t[i : i + depth], 0) + 1
    expected = []
    for t in texts:
        expected += [i + depth <= len(t) and count[t[i : i + depth]] > 1 for i in range(len(t))] + [False]
    assert repeated_starts(texts, depth).tolist() == expected


@pytest.mark.parametrize("length,cap", [(200, 8_000_000), (40, 8_000_000), (40, 1)])
def test_against_brute_force(spark, length, cap):
    texts = awkward(random.Random(length))
    rows = repeat_digests(table(spark, texts), length, bucket_bytes=cap).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(texts)
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_nulls_repeated_ids_and_empty(spark):
    text = "word " * 60
    rows = repeat_digests(table(spark, [text, text, "other", text, None], [None, 3, 3, 3, None])).collect()
    assert sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in rows) == sorted([(True, 300, 300), (False, 300, 300), (False, 5, 0), (False, 300, 300), (True, 0, 0)])
    assert repeat_digests(table(spark, [])).count() == 0


def test_drop_keeps_columns_and_characters(spark):
    a = "é" * 150
    docs = table(spark, ["x" + a + "yy", a + "!ü", "fine", None])
    out = drop_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {0: ("xyy", 3), 1: ("!ü", 2), 2: ("fine", 4), 3: (None, None)}


def test_texts_under_a_null_id_that_share_hash_bits(spark):
    passage = " ".join(f"w{i}" for i in range(80))
    low = {xxhash.xxh64_intdigest(f"{passage} tail {i}", 42) & (2**24 - 1): f"{passage} tail {i}" for i in range(20_000)}
    clean = next(c for c in (f"clean text {j}" for j in range(20_000)) if xxhash.xxh64_intdigest(c, 42) & (2**24 - 1) in low)
    repeated = low[xxhash.xxh64_intdigest(clean, 42) & (2**24 - 1)]
    docs = table(spark, [repeated, clean, f"{passage} other end"], [None, None, 1])
    assert docs.where("doc_id is null").selectExpr("xxhash64(text) & 16777215 h").distinct().count() == 1
    got = {(r.n_bytes, r.n_removed > 0, r.kept_sha256 == hashlib.sha256(clean.encode()).hexdigest()) for r in repeat_digests(docs).collect()}
    assert got == {(len(repeated), True, False), (len(clean), False, True), (len(passage) + 10, True, False)}
    assert clean in {r.text for r in drop_repeats(docs).collect()}


def test_periodic_texts_are_one_row_a_piece():
    line = "Is onhe. "
    text = ("begin " + line * 300 + "end").encode()
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([b"p"]), pa.array([text]), pa.array([3])], names=["bucket", "part", "bytes", "copies"])
    for width in finer_widths(200):
        found = [r for b in _finer(200, width)(iter([batch])) for r in b.to_pylist()]
        assert len(found) <= 220 if width == 200 else len(found) <= 40
        starts = [at + i for r in found for at in r["ats"] for i in range(len(r["bytes"]) - 199)]
        assert sorted(starts) == list(range(len(text) - 199))
        assert all(text[at : at + len(r["bytes"])] == r["bytes"] and r["copies"] == 3 * len(r["ats"]) for r in found for at in r["ats"])


@pytest.mark.parametrize("cap", [8_000_000, 500])
def test_periodic_texts_in_large_buckets(spark, cap):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 90))) + "Is onhe. " * rng.randint(5, 40) + "".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 90))) for _ in range(30)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_digests(table(spark, texts), 60, bucket_bytes=cap).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 60)
