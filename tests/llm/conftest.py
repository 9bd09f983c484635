import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, key string, digest string"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "", "en", "a", 0, 1, "k", "d"),
        (2, None, None, None, None, None, None, None),
        (None, "some text here", "en", "a", 14, 1, "k", "d"),
        (3, "some text here", "en", "a", 14, 1, "k", "d"),
        (3, "some text here", "en", "a", 14, 1, "k", "d"),
        (4, LONG, "en", "b", len(LONG), 1, "k", "d"),
        (5, LONG, "fr", "b", len(LONG), 1, "k", "d"),
        (6, " \t\n ", "de", None, 4, 1, "k", "d"),
        (7, "Größe 日本 \U0001f600 é", "de", "c", 13, 1, "k", "d"),
        (8, "1234 !!", "fr", "c", 7, 1, "k", "d"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
