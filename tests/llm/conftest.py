from __future__ import annotations

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and wordless texts, a very long one, ties, repeated rows, columns that clash."""
    long = " ".join(f"w{i * i % 7919}" for i in range(30000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "x"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here today", "x"),
        (2, "the quick brown fox jumps over the lazy dog and runs far away from here today", "x"),
        (3, None, "x"),
        (4, "", None),
        (5, " \t\n ", "x"),
        (6, "one two", "x"),
        (7, "ONE two", "x"),
        (None, "a null key with some words of its own", "x"),
        (8, long, "x"),
        (9, long + " more", "x"),
        (10, "don't stop <|endoftext|> 'tis\n\n  done ééé 日本語 🙂 it's!!", "x"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    extra = ("node", "row", "n_shingles", "bucket", "shard", "_part", "u", "v", "digest", "quality")
    return frame.select("*", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit(7).alias(c) for c in extra))
