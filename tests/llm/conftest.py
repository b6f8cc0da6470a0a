import os

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null cells, empty, blank and very long texts, repeated rows and ids, and columns named like others."""
    long = " ".join(f"w{i * i % 9973}" for i in range(40_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank.", "en", "a"),
        (2, None, "en", "a"), (3, "", "en", None), (4, " \t\n ", None, "b"), (5, long, "en", "b"), (5, long, "en", "b"),
        (None, "A text without an id that says a few words more.", "fr", "c"), (None, None, None, None),
        (6, "word", "de", "c"), (7, "word", "de", "c"), (8, "Ünïcödé ÇA ET LÀ, naïve façade", "fr", "d"), (8, "another text of id eight", "fr", "d"),
    ]
    clashing = "size long, row long, digest string, score double, node long, evidence double, kept string, shard string, carried int, words string, copies int, stays int"
    return spark.createDataFrame([(*r, 0, 1, 2, "d", 0.5, 3, 0.1, "no", "s", 4, "w", 9, 7) for r in rows], f"{DOCUMENT}, {clashing}")


@pytest.fixture(scope="session")
def no_documents(spark, odd_documents):
    return spark.createDataFrame([], odd_documents.schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session", autouse=True)
def tables():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
