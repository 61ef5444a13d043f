"""Small documents that every corpus operator must stand."""

import random

from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, f string, row long, spans string, count int"


def documents(spark: SparkSession, texts, ids=None):
    """A documents table whose extra columns clash with names that operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}" if k % 5 else None, None if t is None else len(t), "x", 7, None, 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts() -> list:
    rnd = random.Random(5)
    words = "alpha beta gamma delta épée straße 世界 x1 42 don't end. stop! a b c".split()
    base = [rnd.choice(words) for _ in range(120)]
    near = list(base)
    near[60] = "changed"
    far = list(base)
    for i in range(0, 120, 9):
        far[i] = f"other{i}"
    return [
        None, "", " \t\r\n\x0b\x0c ", "one", "One", "two words", "four words in all", "five words make one shingle",
        " ".join(base), " ".join(base).upper(), "\n".join(base), " ".join(near), " ".join(far), " ".join(base),
        "same line here\n" * 40, "no-break space is a word part", "und " * 200, "\U0001f600 " * 60,
        " ".join(rnd.choice(words) for _ in range(6000)), "x" * 50_000, " ".join(f"w{rnd.randrange(900)}" for _ in range(700)),
    ]
