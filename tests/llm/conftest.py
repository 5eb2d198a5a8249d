import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["TOKENIZERS_PARALLELISM"] = "false"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with names that the operators use themselves."""
    long = " ".join(f"word{i % 997} of a very long text" for i in range(20_000))
    rows = [
        (1, None, None, 1), (2, "", "en", 2), (3, " \n\t ", "en", 3), (4, "a", "en", 4), (5, long, "en", 5), (6, long, None, 6),
        (7, "the same row of words again and again", "en", 7), (7, "the same row of words again and again", "en", 7),
        (8, "the same row of words again and again", "fr", 8), (None, "no id but the same row of words again", "en", 9),
        (9, "Ünï cödé 日本語 😀 ½² " * 30, "xx", 10), (10, "12 34 !! ??", "en", 11),
    ]
    return spark.createDataFrame([(i, t, g, n, n, "k", 0) for i, t, g, n in rows], "doc_id long, text string, lang string, source long, key long, carry string, n int")


@pytest.fixture
def none(odd):
    return odd.where("false")
