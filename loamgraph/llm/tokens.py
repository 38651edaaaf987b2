"""Token ids of whole texts, by the tokenizers library, one batch at a time.

A byte-level tokenizer splits before a space or line feed that stands before a character other than white
space, and between a letter or digit and a mark.  So the pieces between such places are
encoded once each; most pieces of a text have been seen before.  Pieces are found, looked up and put together in
numpy: a piece of at most 23 bytes is three words of 64 bits with its length, which are its whole key.
"""

from __future__ import annotations

import json
import os
import re
import string

import numpy as np

from .common import STORES
from .text import mix64

#: Pieces that go to the library in one run, that are looked up together, and bytes that are cut together.
_RUN = 500
_CHUNK = 400_000
_WINDOW = 4_000_000
#: Longer pieces are looked up as bytes.
_SHORT = 23

_SPACE, _FEED = 32, 10


def _flags(*members: int) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_GAP = _flags(_SPACE, _FEED)
#: First bytes of characters that are white space, and of those that may be.
_BLANK = _flags(*range(9, 14), *range(28, 33))
_PERHAPS = _flags(0xC2, 0xE1, 0xE2, 0xE3)
_PLAIN = _flags(*(ord(c) for c in string.ascii_letters + string.digits))
#: Bytes that words of letters below U+0240 consist of, once the two signs among them are excepted; a piece's lead counts too.
_LETTERS = _flags(*(ord(c) for c in string.ascii_letters), *range(0x80, 0xC0), *range(0xC3, 0xC9))
_HEADS = np.array([[(1 << 8 * min(max(n - at, 0), 8)) - 1 for n in range(_SHORT + 1)] for at in (0, 8, 16)], dtype=np.uint64)


def _wide_blank(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the characters of two or three bytes at the places are white space."""
    x, y, z = a[at], a[at + 1], a[at + 2]
    found = (x == 0xC2) & ((y == 0x85) | (y == 0xA0))
    found |= (x == 0xE1) & (y == 0x9A) & (z == 0x80)
    found |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
    return found | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)


def _byte_letters() -> np.ndarray:
    """Code points of the byte-level letters: most bytes stand for themselves, the others follow 255 in ascending order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out = np.arange(256, dtype="<u4")
    others = sorted(set(range(256)) - plain)
    out[others] = 256 + np.arange(len(others))
    return out


class Encoder:
    """Ids of texts as little-endian uint32 bytes, the same as `Tokenizer.encode(text, add_special_tokens=False)`.

    `memory` bounds the pieces kept (about 60 bytes a piece): beyond it all are forgotten, which costs time only.
    """

    def __init__(self, path: str, memory: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory = memory
        size = self.tokenizer.get_vocab_size()
        pieces = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.opens = {b" ": np.array([p.startswith("Ġ") for p in pieces]), b"\n": np.array([p.startswith("Ċ") for p in pieces])}
        self.size = size
        #: Added tokens are cut out of the text first: one with white space of its own, or that takes it from its sides, could cross a split.
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        spec = json.loads(self.tokenizer.to_str())
        self.splits = self._byte_level(spec) and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        self.marks = _flags(*(ord(c) for c in set(string.punctuation) - {"'"} - set("".join(t.content for t in added))))
        #: White space before an added token stands at the end of what the pattern sees; eight bytes tell the token well enough.
        self.added = [t.content.encode()[:8] for t in added if t.content]
        self.doubts = _PERHAPS | _flags(*(c[0] for c in self.added))
        self.letters = None
        if self.splits and not any(t.content.isalpha() for t in added):
            self.letters = self._letters_only(spec["model"])
        self.translate = _byte_letters()
        slots = 1 << (2 * (memory + _CHUNK) - 1).bit_length()
        self.table = np.full(slots, -1, dtype=np.int32)
        self.keys = np.empty((memory + _CHUNK, 3), dtype=np.uint64)
        self.at = np.empty(memory + _CHUNK, dtype=np.int64)
        self.n = np.empty(memory + _CHUNK, dtype=np.int32)
        self._forget()

    def _forget(self) -> None:
        self.table.fill(-1)
        self.long: dict[bytes, int] = {}
        self.count = 0
        self.pool = np.empty(1 << 16, dtype="<u4")
        self.used = 0

    def _byte_level(self, spec: dict) -> bool:
        pre = spec.get("pre_tokenizer") or {}
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", False) and not spec.get("normalizer")

    def _letters_only(self, model: dict):
        """The same merges for words of letters alone, which the pattern never splits: it needs no pattern and no offsets."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type") != "BPE" or not plain or "Ċ" not in model["vocab"]:
            return None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        own = Tokenizer(models.BPE(model["vocab"], merges, cache_capacity=0))
        own.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        return own

    def _starts(self, a: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where pieces start, in texts laid end to end; `a` has some bytes more than they do."""
        size = int(ends[-1])
        starts = np.zeros(size, dtype=bool)
        for x in range(0, size, _WINDOW):
            y = min(x + _WINDOW, size)
            here, after = a[x:y], a[x + 1 : y + 1].copy()
            last = ends[np.searchsorted(ends, x, "right") : np.searchsorted(ends, y, "right")] - 1 - x
            after[last] = _SPACE
            blank = _GAP[after]
            gap = np.flatnonzero(_GAP[here] & ~_BLANK[after]) + x
            starts[gap] = True
            doubt = gap[self.doubts[a[gap + 1]]]
            starts[doubt[_wide_blank(a, doubt + 1)]] = False
            for content in self.added:
                like = np.ones(len(doubt), dtype=bool)
                for j, byte in enumerate(content):
                    like &= a[doubt + 1 + j] == byte
                starts[doubt[like]] = False
            # A text's first byte has nothing before it, and starts a piece anyway.
            mark = np.flatnonzero(self.marks[here] & blank) + x
            starts[mark[_PLAIN[a[np.maximum(mark, 1) - 1]]]] = True
        starts[0] = True
        starts[ends[:-1]] = True
        return np.flatnonzero(starts)

    def _entries(self, data: bytes, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's entry, and the pieces that new entries were made for, in their order."""
        entry = np.empty(len(starts), dtype=np.int64)
        fresh = []
        long = n > _SHORT
        for i in np.flatnonzero(long).tolist():
            piece = data[starts[i] : starts[i] + n[i]]
            if piece not in self.long:
                self.long[piece] = self.count
                self.count += 1
                fresh.append(np.array([i]))
            entry[i] = self.long[piece]
        todo = np.flatnonzero(~long)
        words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
        s, m = starts[todo], n[todo]
        k = [words[s + 8 * j] & _HEADS[j][m] for j in range(3)]
        k[2] |= m.astype(np.uint64) << np.uint64(56)
        mixed = mix64(k[0] ^ mix64(k[1] ^ mix64(k[2])))
        slots = np.uint64(len(self.table) - 1)
        slot = (mixed & slots).astype(np.int64)
        k = np.stack(k, axis=1)
        while len(todo):
            held = self.table[slot]
            empty = np.flatnonzero(held < 0)
            if len(empty):
                # Pieces that meet in an empty slot: the last to write has it, the others compare with it.
                mine = -2 - np.arange(len(empty), dtype=np.int32)
                self.table[slot[empty]] = mine
                won = empty[self.table[slot[empty]] == mine]
                new = self.count + np.arange(len(won))
                self.table[slot[won]] = new
                self.keys[new] = k[won]
                self.count += len(won)
                fresh.append(todo[won])
                held = self.table[slot]
            known = self.keys[held]
            same = (known[:, 0] == k[:, 0]) & (known[:, 1] == k[:, 1]) & (known[:, 2] == k[:, 2])
            entry[todo[same]] = held[same]
            left = np.flatnonzero(~same)
            todo, k, slot = todo[left], k[left], (slot[left] + 1) & (len(self.table) - 1)
        return entry, np.concatenate(fresh) if fresh else np.empty(0, np.int64)

    def _keep(self, entries: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> None:
        """Stores the ids of pieces, one after another; each starts at its place."""
        size = self.used + len(ids)
        if size > len(self.pool):
            grown = np.empty(max(size, 2 * len(self.pool)), dtype="<u4")
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : size] = ids
        self.at[entries] = self.used + starts
        self.n[entries] = np.diff(starts, append=len(ids))
        self.used = size

    def _learn(self, a: np.ndarray, starts: np.ndarray, n: np.ndarray, entries: np.ndarray) -> None:
        """Ids of the pieces that the entries are made for.

        They go to the library in long runs, cut where an id opens with a space or line feed.
        """
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        flat = a[at]
        ends = np.cumsum(n)
        first = ends - n
        led = _GAP[flat[first]]
        loose = ~_LETTERS[flat]
        loose[first] = ~led
        sign = np.flatnonzero(flat[:-1] == 0xC3)
        loose[sign] |= (flat[sign + 1] == 0x97) | (flat[sign + 1] == 0xB7)
        loose[ends[~led] - 1] = True
        letters = np.add.reduceat(loose, first, dtype=np.int64) == 0
        letters &= led & (n > 1) & (self.letters is not None)
        inner = _GAP[flat]
        inner[first] = False
        single = ~led | (np.add.reduceat(inner, first, dtype=np.int64) > 0)

        def text(chosen: np.ndarray) -> np.ndarray:
            m = n[chosen]
            return flat[np.repeat(first[chosen] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]

        bare = np.flatnonzero(letters)
        both = self.opens[b" "] | self.opens[b"\n"]
        for x in range(0, len(bare), _RUN):
            run = bare[x : x + _RUN]
            chars = self.translate[text(run)].tobytes().decode("utf-32-le")
            chars = chars.replace("Ġ", " Ġ").replace("Ċ", " Ċ ")
            self._cut(entries[run], np.array(self.letters.encode_batch_fast([chars[1:]], add_special_tokens=False)[0].ids, dtype="<u4"), both)
        for lead, opens in self.opens.items():
            rest = np.flatnonzero(~letters & ~single & (flat[first] == lead[0]))
            for x in range(0, len(rest), _RUN):
                run = rest[x : x + _RUN]
                self._cut(entries[run], self._plain([text(run).tobytes().decode()])[0], opens)
        alone = np.flatnonzero(~letters & single)
        for x in range(0, len(alone), _RUN):
            run = alone[x : x + _RUN]
            for e, ids in zip(run, self._plain([flat[first[i] : ends[i]].tobytes().decode() for i in run])):
                self._keep(entries[e : e + 1], ids, np.zeros(1, np.int64))

    def _cut(self, entries: np.ndarray, ids: np.ndarray, opens: np.ndarray) -> None:
        starts = np.flatnonzero(opens[ids])
        if len(starts) != len(entries):
            raise AssertionError("pieces and ids don't match")
        self._keep(entries, ids, starts)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return [x.tobytes() for x in self._plain(texts)]
        raw = [t.encode() for t in texts]
        out = [b""] * len(raw)
        full = [i for i, r in enumerate(raw) if r]
        if not full:
            return out
        ends = np.cumsum([len(raw[i]) for i in full])
        data = b"".join([*raw, bytes(32)])
        del raw
        a = np.frombuffer(data, dtype=np.uint8)
        starts = self._starts(a, ends)
        n = np.diff(starts, append=ends[-1])
        parts, before = [], [np.zeros(1, dtype=np.int64)]
        for x in range(0, len(starts), _CHUNK):
            if self.count > self.memory or self.used > 8 * max(self.memory, 50_000):
                self._forget()
            s, m = starts[x : x + _CHUNK], n[x : x + _CHUNK]
            old = self.count
            entry, fresh = self._entries(data, s, m)
            if len(fresh):
                self._learn(a, s[fresh], m[fresh], np.arange(old, self.count))
            held = self.n[entry].astype(np.int64)
            ahead = np.cumsum(held)
            parts.append(self.pool[np.repeat(self.at[entry] - (ahead - held), held) + np.arange(ahead[-1])])
            before.append(before[-1][-1] + ahead)
        ids = np.concatenate(parts).tobytes()
        sums = np.concatenate([before[0], *before[1:]])
        cuts = (4 * sums[np.searchsorted(starts, np.concatenate([[0], ends]))]).tolist()
        for i, y, z in zip(full, cuts, cuts[1:]):
            out[i] = ids[y:z]
        return out


_encoders: dict[str, Encoder] = {}
STORES["tokens"] = [_encoders]


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
