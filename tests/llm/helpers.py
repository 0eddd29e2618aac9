"""Small tables with every awkward case, shared by the tests of this folder."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, digest string, kept boolean, score double, place string, digest_ string, _digest string, _text string, text_mark string, _leaked long"


def docs(spark, rows):
    """(doc_id, text[, lang, source]) as documents with columns whose names the operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None, "k", "d", None, 0.5, "p", "a", "b", "c", "e", 7) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(words))


def awkward():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000, 5_000)
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, "   \n\t ", None, "a"), (4, prose(2, 60), "en", "a"), (5, prose(2, 60), "en", "b"), (5, prose(2, 60), "en", "b"),
        (None, prose(3, 40), "en", "a"), (None, prose(3, 40), None, None), (7, long, "en", "a"), (8, long, "en", "a"), (9, "x", "en", "a"), (10, "\U0001f600 é ß \x00 \x0b", "de", "a"),
        (11, prose(2, 60).replace(" ", "  "), "en", "a"),
    ]
