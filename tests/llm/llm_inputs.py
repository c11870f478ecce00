"""Odd inputs that several test files share."""

import os
import random

import pytest
from pyspark.sql import functions as F

SMALL = os.environ.get("WEFT_TEST_DIR", "/root/testdata/sf0.001")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use inside
CLASHES = ["k", "t", "words", "n_words", "_key", "_row", "row", "rate", "_rate", "_k", "p0", "size", "id", "fingerprint", "component_id", "choice", "shared", "leader", "kept", "score", "ids", "part", "block", "domain", "h", "u", "host", "path"]


def prose(seed, n, alphabet="etaoinshr"):
    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, repeated rows, clashing columns."""
    long_text = prose(1, 120_000)
    rows = [
        (1, prose(2, 60), "en", "a", 5),
        (1, prose(2, 60), "en", "a", 5),
        (2, prose(2, 60), "en", None, None),
        (3, None, "en", "a", 0),
        (4, "", None, "a", 0),
        (5, " \n\t ", "en", "a", 3),
        (6, long_text, "en", "a", len(long_text)),
        (7, prose(3, 80, "zxwvkjqy"), "zz", "b", 1),
        (8, "123 456 !!", None, "b", 1),
        (None, prose(4, 40), "en", "b", 1),
        (None, None, None, None, None),
        (9, prose(5, 50) + "\n" + "Licensed under CC BY-NC 4.0.", "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
