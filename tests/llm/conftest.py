"""Fixtures for the training-data operators."""

from __future__ import annotations

import random

import pytest

WORDS = [f"w{i}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, extra columns with clashing names."""
    rng = random.Random(3)
    base = prose(rng, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "b"), (3, base.replace("w1 ", "x "), "en", "a"), (4, None, "en", "a"), (5, "", None, None), (6, " \n\t", "de", "b"), (7, "one two", "de", "b"), (8, "ONE  two", "de", None),
        (9, prose(rng, 30_000), "en", "a"), (10, "é" * 500 + " ü" * 200, "fr", "c"), (None, prose(rng, 60), "en", "a"), (11, prose(rng, 80), "en", "a"), (11, prose(rng, 80), "en", "a"), (12, "a " * 3000, "en", "c"),
    ]
    rows += [rows[0]]  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    from pyspark.sql import functions as F

    clash = ["size", "score", "kept", "piece", "rid", "component_id", "n_bytes", "node", "verdict", "host"]
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(7) for c in clash})
