"""Fixtures with the awkward rows that every operator must take: nulls, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

import random

SYLLABLES = "the on er in ha tion re ing ou st an der und ch de la que est en los ción".split()

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]) + "." for i in range(0, n, 12))


def documents(spark, extra: str | None = None):
    """Rows with nulls in every column, empty and very long texts, equal texts and repeated rows."""
    long_text = " ".join(prose(i) for i in range(200))
    rows = [
        (1, prose(1), "en", "a", 1),
        (2, prose(1), "en", None, None),
        (2, prose(1), "en", None, None),
        (3, None, None, None, None),
        (4, "", "de", "a", 0),
        (5, " \n\t ", None, "a", 4),
        (None, prose(2), "fr", "b", 7),
        (6, long_text, "en", "a", 9),
        (7, "ünï çödé 日本語 😀 a b\x0bc don't 12³", "es", "b", 3),
        (8, "word " * 400, "en", "b", 3),
        (9, "x" * 300_000, "en", "b", 3),
        (10, "#$% &|< *** " * 40, "de", "b", 3),
    ]
    frame = spark.createDataFrame(rows, DOC_SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in extra.split():
            frame = frame.withColumn(name, F.lit("clash"))
    return frame


def none_of(spark, schema: str = DOC_SCHEMA):
    return spark.createDataFrame([], schema)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
