"""Small tables with nulls, ties, repeated rows, clashing columns and texts of all lengths."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, bucket long, start long"


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 7, None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng: random.Random, n: int, words: int = 300) -> str:
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n % words if n > words else n))


def awkward(rng: random.Random) -> list:
    shared = " ".join(prose(rng, 1) + str(i) for i in range(70))
    base = prose(rng, 120)
    return [None, "", " ", "a", "a", "A  b", "a b", "x" * 700, "x" * 250, base, base, base + " tail", "Z " + base, prose(rng, 50) + shared + prose(rng, 40), shared, "ünï " + shared + "!", "日本" * 150, "日本" * 150 + "語", prose(rng, 290) * 20, "<|endoftext|> a\n\n  b", "\t\n "]
