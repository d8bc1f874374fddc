import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def edge_docs(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i % 7919}x{i}" for i in range(60_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "a"),
        (1, "one two three four five six seven eight nine ten eleven", "a"),
        (2, None, "a"),
        (3, "", None),
        (4, " \n\t ", None),
        (None, "a text without an id that is long enough to be kept by rules", "b"),
        (5, long, "b"),
        (6, "one two three four five six seven eight nine ten eleven", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    extra = "group root node key n_words kept rule host path verdict shingles n k h a b at doc gone hash first label part".split()
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in extra})
