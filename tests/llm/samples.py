"""Small inputs with the awkward rows that every operator must take."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string"
VOWELS = "aeiou"


def prose(seed: int, words: int = 60) -> str:
    rng = random.Random(seed)
    pick = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice(VOWELS) for _ in range(rng.randint(1, 3)))
    return " ".join(pick() for _ in range(words))


def awkward() -> list[tuple]:
    """Null and empty texts, one very long, repeated rows and clashing extra columns."""
    texts = {0: None, 1: "", 2: "   \n\t ", 3: "word", 4: prose(4, 40_000), 5: prose(5), 6: prose(5), 8: "x" * 3000, 9: "ünï 漢字 😀 '"}
    rows = [(i, t, "en" if i % 2 else None, "s", None if t is None else len(t), 0.5, "z") for i, t in texts.items()]
    return [*rows, (7, prose(7), None, None, None, None, None), (7, prose(7), None, None, None, None, None), (None, prose(8), "de", "s", 1, 1.0, "q")]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def documents(spark, texts: dict):
    return frame(spark, [(i, t, None, None, None, None, None) for i, t in texts.items()])
