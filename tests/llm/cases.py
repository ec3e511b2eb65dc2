"""Documents every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
#: Names the operators use inside.
CLASHING = DOCS + ", _row STRING, _digest STRING, n BIGINT, segments STRING, matches STRING, entities STRING, kept INT"


def row(doc_id, text, clashing=False):
    base = (doc_id, text, None, "s", None if text is None else len(text))
    return base + (("r", "d", 1, "s", "m", "e", 1) if clashing else ())


def odd_texts():
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta.", "éàü", "x"]) + str(rng.randrange(50)) for _ in range(30_000))
    return [
        (1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, "one"), (6, " one \n"), (7, long), (8, long),
        (None, "no id"), (9, "repeated row"), (9, "repeated row"), (None, "no id"), (10, "日本語 😀 \x00 ▁ <|endoftext|>"),
        (11, "The quick brown fox jumps over the lazy dog " * 40),
    ]


def odd_docs(spark, clashing=False):
    schema = CLASHING if clashing else DOCS
    return spark.createDataFrame([row(i, t, clashing) for i, t in odd_texts()], schema)


def documents(spark, pairs):
    return spark.createDataFrame([row(i, t) for i, t in pairs], DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)
