import pytest
from pyspark.sql import types as T

LONG = "the quick token of a very long text and more of it " * 20_000
AWKWARD = [
    (1, "The first text has some words in it, and it is not short at all.", "en", "src0", 1),
    (1, "The first text has some words in it, and it is not short at all.", "en", "src0", 1),
    (2, "The first text has some words in it, and it is not short at all.", "en", "src0", 1),
    (3, None, "en", "src1", None),
    (4, "", "de", "src1", 0),
    (5, " \t\n ", None, None, 3),
    (6, LONG, "en", "src0", len(LONG)),
    (None, "no id here, but some words of text", "fr", "src2", 10),
    (None, None, None, None, None),
    (7, "word", "xx", "src3", 4),
    (8, "é ß 漢字 \U0001f600 password = hunter2hunter2", "de", "src0", 9),
    (9, "1 2 3 ... !!!", "en", "src0", 9),
]
NAMES = ["key", "n", "root", "score", "kept", "held_out", "whole", "rest", "part", "spans", "token", "labels", "copies", "_words", "_text", "id", "offset"]


@pytest.fixture(scope="session")
def schema():
    return T.StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def awkward(spark, schema):
    """Nulls everywhere, blank and very long texts, ties, repeated rows, and further columns with names the operators use."""
    df = spark.createDataFrame(AWKWARD, schema)
    for i, name in enumerate(NAMES):
        df = df.selectExpr("*", f"cast({i} as string) as {name}")
    return df


@pytest.fixture(scope="session")
def nothing(spark, schema):
    return spark.createDataFrame([], schema)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
