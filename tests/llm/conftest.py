import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 20_000 + "tail"


@pytest.fixture(scope="session")
def documents():
    """The smallest table, as pandas."""
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, empty and long texts, a repeated row, and a column with a clashing name."""
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, LONG, "en", "a", len(LONG)),
        (4, "one two three four five six seven", "en", "b", 34),
        (4, "one two three four five six seven", "en", "b", 34),
        (None, "no id here", None, "b", 10),
        (5, "x" * 50_000, "en", "a", 50_000),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.selectExpr("*", "'old' AS score", "1 AS ids", "2 AS position", "3 AS row")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
