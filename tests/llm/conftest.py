from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # Names that the operators use themselves, as columns that they must leave alone.
    + [T.StructField(c, T.StringType()) for c in ("n", "slot", "shard", "score", "spans", "piece", "length", "rank", "node", "blob", "key", "html", "word", "start")]
)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang]) rows, over several partitions, with columns whose names clash."""

    def docs(rows, parts: int = 3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), *["x"] * 14) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.repartition(parts) if rows else df

    return docs


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 7))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, a very long one, ties, repeated rows, a null id."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "one two"), (6, "one two"), (6, "one two"), (None, "one two three"), (8, "ünï ☃ 日本語 😀"), (9, "7"), (10, "\u0000 x"), (11, prose(2, 300)), (11, prose(3, 10))]
