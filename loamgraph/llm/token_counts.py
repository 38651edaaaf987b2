"""Token counts by a trie of distinct words: forward scores are computed once for each shared prefix."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import STORES, blocks, narrow, release
from .pieces import SPACE, Pieces, default_path, pieces


#: Nodes of a worker's trie: it stays between tasks, so that later ones find the common prefixes.
NODES = 900_000
#: Bytes of one generation of known words' counts, of which a worker keeps two: about this for each word besides its characters.
COUNT_BYTES, ENTRY_BYTES = 60_000_000, 110


class CountTrie:
    """Each node stands for a prefix and holds its best score and the number of tokens of its best segmentation.

    A word's walk makes only the nodes that no earlier word has made; the count at its last
    node is its token count.  Beyond `most` nodes the trie starts anew, which costs time only.  Counts of words are kept
    apart, in two generations: words met again move to the newer one, and what the older one still has when the newer is full is forgotten.
    """

    def __init__(self, model: Pieces, most: int = NODES, count_bytes: int = COUNT_BYTES):
        self.model, self.most, self.count_bytes = model, most, count_bytes
        self.recent: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.held = 0
        self._clear()

    def _clear(self) -> None:
        self.below: list[dict[str, int]] = [{}]
        self.score = [0.0]
        self.tokens = [0]

    def count(self, word: str) -> int:
        found = self.recent.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                found = self._insert(word)
            self.recent[word] = found
            self.held += ENTRY_BYTES + len(word)
        return found

    def _insert(self, word: str) -> int:
        if len(self.score) > self.most:
            self._clear()
        below, score, tokens = self.below, self.score, self.tokens
        path = [0]
        node = 0
        for char in word:
            after = below[node].get(char)
            if after is None:
                after = len(score)
                below[node][char] = after
                below.append({})
                end = len(path)
                best, of = self._forward(word, end, path)
                score.append(best)
                tokens.append(of)
            path.append(after)
            node = after
        return tokens[node]

    def _forward(self, word: str, end: int, path: list[int]) -> tuple[float, int]:
        scores, score, tokens = self.model.scores, self.score, self.tokens
        best, of = None, 0
        for size in range(min(end, self.model.longest), 0, -1):
            own = scores.get(word[end - size : end])
            more = 1
            if own is None:
                if size > 1:
                    continue
                own, more = self.model.unknown, len(word[end - 1].encode("utf-8", "surrogatepass"))
            total = score[path[end - size]] + own
            if best is None or total > best:
                best, of = total, tokens[path[end - size]] + more
        return best, of

    def counts_of(self, text: str) -> tuple[int, int]:
        """The numbers of words and of tokens."""
        if not text:
            return 0, 0
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            words = self.model.words(text)
        else:
            words = [SPACE + w for w in text.split(" ")]
        # In order, words with a common prefix follow each other along the trie.
        for word in sorted({w for w in words if w not in self.recent}):
            self.count(word)
        total = sum(map(self.recent.__getitem__, words))
        if self.held > self.count_bytes:
            self.older, self.recent, self.held = self.recent, {}, 0
        return len(words), total


_tries: dict[str, CountTrie] = {}
STORES["tries"] = [_tries]


def trie_of(path: str) -> CountTrie:
    """The worker's trie: a closure would be unpickled anew, and empty, in each task."""
    if path not in _tries:
        _tries[path] = CountTrie(pieces(path))
    return _tries[path]


def token_counts(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_words, n_tokens.

    Tokens are those of the best unigram segmentation of each word (see `pieces`).  The
    work is one pass without a shuffle; a worker's trie shares prefixes over the documents of all its tasks.  Null and empty texts
    have no tokens; very long ones are counted whole, a word at a time; ties go as in `pieces`; rows with null or repeated ids are counted like any other; an empty table gives an empty result.
    """
    path = model or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release("tries")
        trie = trie_of(path)
        for batch in blocks(batches, "text", 4_000_000):
            texts = batch.column("text").to_pylist()
            found = list(chain.from_iterable(map(trie.counts_of, texts)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.compute.binary_length(batch.column("text")).cast(pa.int64()), pa.array(found[::2], pa.int64()), pa.array(found[1::2], pa.int64())], names=["doc_id", "n_bytes", "n_words", "n_tokens"])

    return narrow(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_words long, n_tokens long")
