import random

import numpy as np
import pytest

from loamgraph.llm.pieces import best_segmentation, default_path, pieces
from loamgraph.llm.token_counts import CountTrie, token_counts
from loamgraph.llm.viterbi import Viterbi, encode_decode

from .helpers import awkward, table

PARTS = [" ", "  ", "a", "the", "B", "é", "1", "日本", "😀", "\n", "①", "ing", "er", "Th", "▁"]


@pytest.fixture(scope="module")
def model():
    return pieces(default_path())


def plain_ids(model, text):
    out = []
    for word in model.words(text):
        for p in best_segmentation(model, word)[1]:
            out += [model.ids[p]] if p in model.ids else [model.byte_ids[b] for b in p.encode()]
    return out


@pytest.mark.parametrize("memory,nodes", [(400_000, 1_500_000), (40, 300)])
def test_against_plain_programme(model, memory, nodes):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(600)] + [t or "" for t in awkward(rng)[:15]]
    coder, trie = Viterbi(model, memory), CountTrie(model, nodes)
    for a in range(0, len(texts), 60):
        for t, data in zip(texts[a : a + 60], coder.encode(texts[a : a + 60])):
            ids = np.frombuffer(data, "<i4")
            assert ids.tolist() == plain_ids(model, t)
            assert trie.counts_of(t) == (len(model.words(t)), len(ids))
            assert coder.decode(ids) == t.replace("▁", " ")


def test_long_words(model):
    rng = random.Random(12)
    letters = [chr(0x3040 + i) for i in range(80)] + [chr(0x4E00 + 37 * i) for i in range(200)] + ["😀", "a", "b", "th"]
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (47, 48, 49, 500, 4000)]
    texts += ["a" * 3000, "".join(rng.choice("abcdefgh0123=/+") for _ in range(3000)), "x" * 60 + " " + "日本" * 900, "the" * 400]
    coder, trie = Viterbi(model), CountTrie(model)
    for t, data in zip(texts, coder.encode(texts)):
        ids = np.frombuffer(data, "<i4")
        assert ids.tolist() == plain_ids(model, t) and coder.decode(ids) == t
        assert trie.counts_of(t)[1] == len(ids)
        for w in model.words(t):
            assert "".join(coder._parts(w)) == w


def test_library_agrees_on_plain_words(model):
    """The library, told that the same pieces are a unigram model, gives the same ids where its single precision is exact."""
    import sentencepiece

    data = open(default_path(), "rb").read()
    mark = b"\x12\x06tok_v0\x18"
    at = data.index(mark + b"\x02") + len(mark)
    library = sentencepiece.SentencePieceProcessor(model_proto=data[:at] + b"\x01" + data[at + 1 :])
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    score = lambda ids: sum(model.scores[model.names[i]] for i in ids)
    same = 0
    for w, data in zip(words, Viterbi(model).encode(words)):
        ids, other = np.frombuffer(data, "<i4").tolist(), library.encode(w)
        same += ids == other
        assert score(ids) >= score(other)
    assert same >= 0.998 * len(words)


def test_tables(spark, model):
    texts = awkward(random.Random(9))
    rows = {r.doc_id: r for r in encode_decode(table(spark, texts)).collect()}
    counts = {r.doc_id: r for r in token_counts(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = plain_ids(model, t or "")
        assert list(rows[i].ids) == ids and rows[i].exact and rows[i].n_ids == counts[i].n_tokens == len(ids)
        assert counts[i].n_bytes == len((t or "").encode())
    for op in (encode_decode, token_counts):
        assert op(table(spark, [])).count() == 0
        assert sorted(str(r.doc_id) for r in op(table(spark, ["a", None, "a"], [None, 1, 1])).collect()) == ["1", "1", "None"]
