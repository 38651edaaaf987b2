import random
import zlib

import numpy as np
import pytest

from loamgraph.llm.packing import hilbert_keys, pack
from loamgraph.llm.token_files import read_block, read_image, read_tokens, token_round_trip, write_image, write_tokens
from loamgraph.llm.tokens import Encoder, default_path

from .helpers import awkward, table


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("memory", [600_000, 50])
def test_encoder_is_the_library(library, memory):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "23", "'s", ".", "!!", "<|endoftext|>", "\xa0", "　", "x", "\x1c", "\x85", "​", "日本", "😀", "\r\n", "don't", "a.b", "(x)", "×", "÷", "ɏ", "Ωmega", "–", "“q”", "\u3000", "<b>", "<|", ", ", ".\n", "z" * 23, "é" * 12, "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + [t or "" for t in awkward(rng)]
    own = Encoder(default_path(), memory)
    for a in range(0, len(texts), 100):
        # The second time all pieces are known, unless they have been forgotten.
        for _ in range(2):
            for t, ids in zip(texts[a : a + 100], own.encode(texts[a : a + 100])):
                assert np.frombuffer(ids, "<u4").tolist() == library(t)


def test_encoder_cuts_across_chunks_and_windows(library, monkeypatch):
    from loamgraph.llm import tokens

    monkeypatch.setattr(tokens, "_CHUNK", 7)
    monkeypatch.setattr(tokens, "_WINDOW", 5)
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "Bé", " ", " ", "\n", ". ", "12", "\u2003", "–", "<|endoftext|>", "w" * 30]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    own = Encoder(default_path(), 40)
    for a in range(0, len(texts), 20):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts[a : a + 20])] == list(map(library, texts[a : a + 20]))


@pytest.mark.parametrize("unit", [1, 8])
@pytest.mark.parametrize("block", [7, 65536])
def test_file_round_trip(unit, block):
    rng = np.random.default_rng(block)
    docs = [(i - 2, rng.integers(0, 50257, n).astype("<u4").tobytes()) for i, n in enumerate([0, 1, 6, 7, 8, 100, 0])]
    image = write_image(docs, unit, block)
    assert [(i, x.tobytes()) for i, x in read_image(image)] == docs
    flat = np.frombuffer(b"".join(d for _, d in docs), "<u4")
    assert read_block(image, 0).tolist() == flat[:block].tolist()
    assert list(read_image(write_image([]))) == []


def test_tokens_of_a_table(spark, library):
    texts = awkward(random.Random(4))
    ids = [3 * i for i in range(len(texts))]
    rows = sorted(token_round_trip(table(spark, texts[::-1], ids[::-1])).collect())
    start = 0
    for r, i, t in zip(rows, ids, texts):
        own = np.array([*library(t), 2], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert len(rows) == len(texts)
    small = read_tokens(write_tokens(table(spark, texts, ids), file_ids=10), with_ids=True).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in small) == [tuple(r) for r in rows]
    assert {r.doc_id: list(r.ids) for r in small}[6] == [*library(texts[2]), 2]
    assert token_round_trip(table(spark, [])).count() == 0
    assert sorted(map(str, [(r.doc_id, r.n_tokens) for r in token_round_trip(table(spark, ["a", "a", None], [None, 1, 1])).collect()])) == sorted(map(str, [(None, 2), (1, 2), (1, 1)]))


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3)])
def test_curve_goes_to_neighbours(dims, bits):
    n = 1 << bits
    grid = np.stack(np.meshgrid(*[np.arange(n)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = hilbert_keys(grid, bits)
    assert sorted(keys.tolist()) == list(range(n**dims))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing(spark, library):
    texts = awkward(random.Random(5)) + ["word " * 3000]
    rows = pack(table(spark, texts)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, own in by_doc.items():
        ids = np.array([*library(texts[i]), 0], dtype="<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0
    assert pack(table(spark, [])).count() == 0
    few = pack(table(spark, ["a", None, "b"], [None, 2, 2])).collect()
    assert sum(r.length for r in few) == 5 and {r.doc_id for r in few} == {None, 2}
