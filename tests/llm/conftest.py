import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and very long texts, ties, repeated rows and strange characters."""
    rng = random.Random(1)
    long = " ".join(
        rng.choice(["alpha", "beta", "gamma,", "Delta.", "é", "e\u0301", "😀"]) + str(rng.randrange(3000))
        for _ in range(40_000)
    )
    rows = [
        (1, "one two three four five six seven.", "en", "a", 34),
        (2, "one two three four five six seven.", "en", "a", 34),
        (3, "", "en", "b", 0),
        (4, None, None, None, None),
        (5, " \t\n\x0b\x0c\r ", "en", "b", 7),
        (6, long, "en", "b", len(long)),
        (7, "word", "en", None, 4),
        (8, "Zwei W\u00f6rter", "de", "a", 12),
        (9, "one\u00a0two\u2003three \x1cfour", "en", "c", 20),
        (None, "no key here at all", "en", "a", 18),
        (10, "same row", "en", "a", 8),
        (10, "same row", "en", "a", 8),
        (11, "😀" * 50 + "\n\n" + "x" * 5000, "en", "a", 5052),
        (12, "a\n\nb\n\n\nc\n", "en", "a", 9),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same with further columns of the names that operators add or use."""
    from pyspark.sql import functions as F

    names = [
        "a.b c",
        "score",
        "predicted",
        "held_out",
        "shard",
        "SLOT",
        "grown_shard",
        "copy",
        "rate",
        "mix_key",
        "weight",
        "size",
        "fp",
        "component_id",
        "tree",
        "Root",
        "fingerprint",
        "next_text",
        "kept_text",
        "n_words",
        "removed",
        "base",
        "spans",
        "host",
        "path",
        "rule",
        "verdict",
        "count",
        "bucket",
        "first",
        "node",
        "a",
        "b",
        "n",
        "containment",
        "item_id",
        "url",
        "html",
    ]
    return odd.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
