import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    long_text = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, "alpha beta gamma", "en", 1), (1, "alpha beta gamma", "en", 1), (None, "no id here", "en", 2),
        (2, None, None, 3), (3, "", "de", 4), (4, long_text, "en", 5), (5, long_text + " end", "en", 6),
        (6, "!!! ???\n\n\t", "en", 7), (7, "été 中文 \U0001f600 straße", "fr", 8),
        (8, "mit license " * 3, "en", 9), (9, None, "en", 10), (2, "other text of document two", "en", 11),
    ]
    return spark.createDataFrame(
        [(*r, "x", 1, 2, "y") for r in rows],
        "doc_id bigint, text string, lang string, n_words int, sha string, bucket int, shard int, label string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)

