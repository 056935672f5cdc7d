import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"

LOREM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen " \
        "eighteen nineteen twenty alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns named like internal ones."""
    rows = [
        (1, LOREM, "en", "a", 1), (1, LOREM, "en", "a", 1), (2, LOREM + " nu", "en", "a", 1), (3, None, None, None, None),
        (4, "", "en", None, 0), (5, " \n\t ", None, "b", 3), (None, LOREM, "en", "b", 1), (None, None, None, None, None),
        (6, "short text", "de", "b", 10), (7, "SHORT text", "de", "c", 10), (8, "x" * 50_000, "de", "c", 50_000),
        (9, (LOREM + "\n") * 400, "en", "c", 1), (10, "é́ ñ 日本語 \U0001F600 <|endoftext|> don't", "fr", "é", 1),
    ]
    frame = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    for name in ("size", "key", "root", "copies", "secrets", "n_words", "kept", "tokens", "sig", "start", "_text", "_m", "_mix"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def schema_of(text):
    return T._parse_datatype_string(text)
