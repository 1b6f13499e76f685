import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with NULLs, empty and one-word texts, a long text, repeated rows and columns with clashing names."""
    long_text = " ".join(f"wörd{i % 977} z{i}" for i in range(6000)) + "\n\n  end"
    rows = [
        (1, "Plain words of a short text, and some more of them to read.", "en", "a"),
        (1, "Plain words of a short text, and some more of them to read.", "en", "a"),
        (2, None, "en", "a"), (3, "", None, None), (4, "one", "en", None), (5, long_text, "de", "b"),
        (6, " \t\n ", "fr", "b"), (None, "No key here, but words all the same.", None, "a"),
        (7, "Plain words of a short text, and some more of them to read.", "en", "b"),
        (8, "tie tie tie tie tie tie tie tie tie tie tie tie", "en", "b"), (9, "日本語の文章です。空白がない。" * 20, "ja", "c"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return frame.withColumns({c: F.lit("clash") for c in ("score", "k", "t", "part", "_q", "_w", "n", "size", "shard", "length", "kept")})


@pytest.fixture(scope="session")
def no_rows(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
