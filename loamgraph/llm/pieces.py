"""The pieces and scores of a SentencePiece file, used as a unigram model.

A text becomes one string with a space before it and U+2581 for each space; a
segmentation's score is the sum of its pieces' scores, and the best one wins, ties going to the
longest last piece at the earliest end.  A character that no piece covers scores 10
less than the lowest piece and is written as its bytes' pieces.
"""

from __future__ import annotations

import re

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = {self.names[i]: model.get_score(i) for i in normal}
        self.ids = {self.names[i]: i for i in normal}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if model.unk_id() in self.byte_ids or any(not model.is_byte(i) for i in self.byte_ids):
            raise ValueError("the file has no byte pieces")
        if any(SPACE in p.lstrip(SPACE) for p in self.scores):
            raise ValueError("a piece crosses a word's start")
        self.longest = max(map(len, self.scores))
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        #: What each id adds to a decoded text.
        self.decoded = [b""] * n
        for i in normal:
            self.decoded[i] = self.names[i].replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.decoded[i] = bytes([b])

    def words(self, text: str) -> list[str]:
        """The text's words, each with the spaces before it; no piece crosses from one to the next."""
        if not text:
            return []
        return _WORDS.findall(SPACE + text.replace(" ", SPACE))


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(model: Pieces, texts: list[str]) -> list[list[str]]:
    return [model.words(t) for t in texts]


def best_segmentation(model: Pieces, word: str) -> tuple[float, list[str]]:
    """The plain dynamic programme over one word, for tests: its best score and its parts."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = None
        for size in range(min(end, model.longest), 0, -1):
            part = word[end - size : end]
            score = model.scores.get(part, model.unknown if size == 1 else None)
            if score is not None and (found is None or best[end - size][0] + score > found[0]):
                found = (best[end - size][0] + score, size)
        best.append(found)
    parts, at = [], len(word)
    while at:
        size = best[at][1]
        parts.append(word[at - size : at])
        at -= size
    return best[-1][0], parts[::-1]
