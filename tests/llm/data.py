"""Rows that are awkward on purpose."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size string, score string, row_ string, key string"


def words(rnd, n, vocabulary=400):
    return " ".join("".join(rnd.choice(("ka", "lo", "mi", "ner", "sta", "ing", "é", "po")) for _ in range(1 + rnd.randrange(4))) if rnd.random() < 0.5 else f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def awkward(spark, seed=1, n=30):
    """Nulls in every column, empty and very long texts, copies, repeated rows, extra columns with names in use."""
    rnd = random.Random(seed)
    texts = [words(rnd, rnd.randrange(5, 60)) for _ in range(n)]
    rows = [(i, t, rnd.choice(("en", "fr", None)), rnd.choice(("a", "b", "Ü", None)), len(t)) for i, t in enumerate(texts)]
    long = words(rnd, 30000)
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (102, " \t\n", "fr", "b", 3), (103, "!!! ???", None, "a", 7), (104, long, "en", "a", len(long))]
    rows += [(105, texts[0], "en", "b", 1), (106, texts[0], "en", "b", 1), (None, texts[1], "fr", None, None), (None, None, None, None, None), (3, texts[3], "en", "a", 5), (3, texts[3], "en", "a", 5), (107, "one two", "en", "a", 7)]
    rows += [(108, "a" * 20000, "en", "c", 20000), (109, "漢字" * 3000, "fr", "c", 6000)]
    return spark.createDataFrame([(*r, "x", "y", "z", "r", None) for r in rows], SCHEMA), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
