import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINE = "This line stands in many documents and is a long one"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, odd characters."""
    long = "word " * 30_000 + LINE.replace(" ", "") * 400
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (None, "some text without an id and more of it", "en", "a", 3),
        (3, long, "en", None, None), (4, "repeated row " * 4, None, "a", 1), (4, "repeated row " * 4, None, "a", 1),
        (5, "İK \U0001f600 \x00 � <|endoftext|> <|im_end|>", "de", "b", 2), (6, " \n\t \r\n", "fr", "b", 2),
        *[(10 + k, f"{LINE.upper() if k % 2 else LINE}  \nown words of number {k} here", "en", "a", 9) for k in range(6)],
        (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Extra columns with names that operators use inside."""
    for name in ("id", "doc", "rep", "root", "words", "_words", "h", "key", "lines", "n_lines", "label", "score", "ids", "batch", "_drops", "_doc"):
        df = df.withColumn(name, F.lit("extra"))
    return df
