"""Words of blocks of texts as arrays: one buffer, the words' offsets in it, and a dictionary of integer ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words that any white space ends.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words of letters, digits and everything beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """All words of some texts: word i is data[offsets[i]:offsets[i + 1]], text d has words before[d] to before[d + 1]."""

    def __init__(self, texts: list[bytes], inside: np.ndarray, lower: bool = False):
        buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        own = inside[buf]
        edge = np.diff(own.view(np.int8), prepend=np.int8(0))
        starts = np.flatnonzero(edge == 1)
        self.data = _LOWER[buf[own]] if lower else buf[own]
        self.offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(edge == -1) - starts)]).astype(np.int64)
        self.before = np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        """The number of words of each text."""
        return np.diff(self.before)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.before) - 1), self.counts)

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """(ids, dictionary): the words as integers, equal for equal bytes, and the bytes of each integer."""
        words = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(np.ascontiguousarray(self.data))])
        coded = pc.dictionary_encode(words)
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary

    def joined(self, take: np.ndarray, ends: np.ndarray) -> pa.Array:
        """These words, joined by single spaces: text j has those from ends[j - 1] (or 0) to ends[j]."""
        size = self.offsets[take + 1] - self.offsets[take]
        gap = np.ones(len(take), dtype=np.int64)
        begins = np.concatenate([[0], ends[:-1]])
        gap[ends[ends > begins] - 1] = 0
        target = np.concatenate([[0], np.cumsum(size + gap)])
        out = np.full(target[-1], 0x20, dtype=np.uint8)
        if len(take):
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[at + np.repeat(target[:-1], size)] = self.data[at + np.repeat(self.offsets[take], size)]
        return pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(np.concatenate([[0], target[ends]]).astype(np.int64)), pa.py_buffer(out)])
