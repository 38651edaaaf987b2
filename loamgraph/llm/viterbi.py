"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Words of equal length advance together, one character at a time.  The hashes of all their
substrings that end there probe the sorted hashes of the pieces of that length; the best of the
lengths is kept with a back-pointer, and the ids are read off backwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import STORES, blocks, narrow, release
from .pieces import SPACE, Pieces, default_path, pieces
from .text import mix64

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of one length that advance together; long words advance in smaller companies.
CELLS = 400_000
#: Longer words are cut where no piece spans, so that their parts advance together.
LONG = 48


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")


class Viterbi:
    """Encodes words with the ids of their best segmentation; keeps words seen, in two bounded generations."""

    def __init__(self, model: Pieces, memory: int = 400_000):
        self.model, self.memory = model, memory
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        by_size: dict[int, list[str]] = {}
        for p in model.scores:
            by_size.setdefault(len(p), []).append(p)
        self.sizes = sorted(by_size, reverse=True)
        self.tables = {}
        for size, own in by_size.items():
            keys = self._hash(_codes(own).reshape(-1, size))
            order = np.argsort(keys)
            if (np.diff(keys[order]) == 0).any():
                raise AssertionError("two pieces have one hash")
            self.tables[size] = (keys[order], np.array([model.scores[p] for p in own])[order], np.array([model.ids[p] for p in own], dtype=np.int64)[order])

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), dtype=np.uint64)
        for j in range(codes.shape[1]):
            h = h * _BASE + mix64(codes[:, j].astype(np.uint64) + np.uint64(1))
        return h

    def _company(self, words: list[str], n: int) -> list[np.ndarray]:
        """The ids of words that all have n characters."""
        m = len(words)
        codes = _codes(words).reshape(m, n)
        # Prefix hashes: the hash of i..j is H[j] - H[i] * base**(j - i).
        prefix = np.zeros((n + 1, m), dtype=np.uint64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * _BASE + mix64(codes[:, j].astype(np.uint64) + np.uint64(1))
        best = np.zeros((n + 1, m))
        size_of = np.zeros((n + 1, m), dtype=np.int64)
        id_of = np.full((n + 1, m), -1, dtype=np.int64)
        powers = np.multiply.accumulate(np.full(max(self.sizes) + 1, _BASE, dtype=np.uint64))
        for end in range(1, n + 1):
            # A character without a piece is the last choice of all, where nothing else ends.
            top = np.full(m, -np.inf)
            for size in self.sizes:
                if size > end:
                    continue
                keys, scores, ids = self.tables[size]
                h = prefix[end] - prefix[end - size] * powers[size - 1]
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = keys[at] == h
                total = np.where(hit, best[end - size] + scores[at], -np.inf)
                if size == 1:
                    total = np.where(hit, total, best[end - 1] + self.model.unknown)
                better = total > top
                top = np.where(better, total, top)
                size_of[end] = np.where(better, size, size_of[end])
                id_of[end] = np.where(better, np.where(hit, ids[at], -1), id_of[end])
            best[end] = top
        # All words step back together; a word that is at its start rests.
        at = np.full(m, n)
        steps = []
        rows = np.arange(m)
        while (at > 0).any():
            steps.append((np.where(at > 0, id_of[at, rows], -2), at.copy()))
            at = at - np.where(at > 0, size_of[at, rows], 0)
        ids = np.stack([s for s, _ in reversed(steps)], axis=1)
        out = []
        lacking = (ids == -1).any(axis=1)
        for i in range(m):
            own = ids[i][ids[i] != -2]
            if lacking[i]:
                ends = np.array([p[i] for _, p in reversed(steps)])[ids[i] != -2]
                full: list[int] = []
                for piece, end in zip(own.tolist(), ends.tolist()):
                    full += [piece] if piece >= 0 else [self.model.byte_ids[b] for b in words[i][end - 1].encode("utf-8", "surrogatepass")]
                own = np.array(full)
            out.append(own.astype("<i4"))
        return out

    def _parts(self, word: str) -> list[str]:
        """The word cut wherever no piece spans the cut: the best segmentation of the whole is that of its parts in turn."""
        n = len(word)
        codes = mix64(_codes([word]).astype(np.uint64) + np.uint64(1))
        spanned = np.zeros(n + 1, dtype=np.int32)
        h = np.zeros(n, dtype=np.uint64)
        for size in range(1, min(n, max(self.sizes)) + 1):
            h = h[: n - size + 1] * _BASE + codes[size - 1 :]
            if size > 1 and size in self.tables:
                keys = self.tables[size][0]
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                starts = np.flatnonzero(keys[at] == h)
                np.add.at(spanned, starts + 1, 1)
                np.add.at(spanned, starts + size, -1)
        cuts = [0, *(np.flatnonzero(np.cumsum(spanned)[1:n] == 0) + 1).tolist(), n]
        return [word[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > self.memory:
            self.older, self.known = self.known, {}
        by_length: dict[int, list[str]] = {}
        cut: dict[str, list[str]] = {}
        for w in words:
            if w in self.older:
                self.known[w] = self.older[w]
            elif len(w) > LONG:
                cut[w] = self._parts(w)
            else:
                by_length.setdefault(len(w), []).append(w)
        found: dict[str, bytes] = {}
        for p in set().union(*cut.values()):
            by_length.setdefault(len(p), []).append(p)
        for n, own in by_length.items():
            step = max(1, CELLS // n)
            for a in range(0, len(own), step):
                part = own[a : a + step]
                for w, ids in zip(part, self._company(part, n)):
                    found[w] = ids.tobytes()
        whole = {w: b"".join(map(found.__getitem__, parts)) for w, parts in cut.items()}
        self.known.update((w, whole[w] if w in whole else found[w]) for w in words if w not in self.known)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian int32 bytes."""
        cut = []
        for t in texts:
            if not t:
                cut.append([])
            elif "  " in t or t[0] == " " or t[-1] == " " or SPACE in t:
                cut.append(self.model.words(t))
            else:
                cut.append([SPACE + w for w in t.split(" ")])
        words = set().union(*cut)
        missing = {w for w in words if w not in self.known}
        if len(self.known) + len(missing) > self.memory:
            missing = words
        if missing:
            self.learn(missing)
        return [b"".join(map(self.known.__getitem__, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: U+2581 is a space, byte pieces are bytes, and the first space is the one put before the text."""
        text = b"".join(map(self.model.decoded.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_coders: dict[str, Viterbi] = {}
STORES["viterbi"] = [_coders]


def coder(path: str) -> Viterbi:
    if path not in _coders:
        _coders[path] = Viterbi(pieces(path))
    return _coders[path]


def encode_decode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_ids, ids, ids_crc32 (of little-endian unsigned 32-bit ids), exact.

    `exact` tells that decoding the ids gives the text back; U+2581 in a text comes back as a space.  One pass
    without a shuffle.  Null counts as empty and has no ids; very long texts are encoded whole, words of over LONG characters in parts
    that no piece spans; ties go as in `pieces`; other columns are not read; rows with null or repeated ids are
    encoded like any other; an empty table gives an empty result.
    """
    path = model or default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("viterbi")
        own = coder(path)
        for batch in blocks(batches, "text", 2_000_000):
            texts = batch.column("text").to_pylist()
            data = own.encode(texts)
            ids = [np.frombuffer(d, dtype="<i4") for d in data]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(data), dtype="<i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), values),
                    pa.array([zlib.crc32(d) for d in data], pa.int64()),
                    pa.array([own.decode(x) == t for x, t in zip(ids, texts)]),
                ],
                names=["doc_id", "n_ids", "ids", "ids_crc32", "exact"],
            )

    return narrow(docs, id_col, text_col).mapInArrow(encode, "doc_id long, n_ids long, ids array<int>, ids_crc32 long, exact boolean")
