"""Small tables for the tests of the text operators."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "é", "ß"]
    out = []
    for i in range(words):
        word = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        out.append(word + (".\n" if i % 23 == 22 else " "))
    return "".join(out).strip() + "."


def table(spark: SparkSession, rows: list[tuple], extra: bool = False) -> DataFrame:
    """Rows of (doc_id, text[, source]) as documents; ``extra`` adds columns whose names operators might use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else f"src{i % 3}", None if r[1] is None else len(r[1])) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        names = ("key", "part", "h", "g", "fp", "words", "lines", "digest", "block", "slot", "start", "length", "_rank", "kept", "host", "ids")
        for name in names:
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def awkward(long_words: int = 30_000) -> list[tuple]:
    """Null ids and texts, empty and blank texts, one very long text, repeated rows, and near copies."""
    base = prose(1, 300)
    return [
        (1, base), (2, base), (2, base), (3, base.replace("th", "ht", 1)), (4, None), (5, ""), (6, " \n\t "), (None, prose(2, 80)),
        (None, None), (7, prose(3, long_words)), (8, "short"), (9, "short"), (10, base[:200]), (11, base + " " + base), (-4, prose(4, 50)),
    ]
