"""Small inputs shared by the tests of the training-data operators."""

import os
import sys

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string"


def sf_documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def messy(spark):
    """Nulls, empty and very long texts, repeated rows, ties and odd characters."""
    text = "The quick brown fox jumps over the lazy dog. It runs on and on, far away! Password: hunter2345 is here."
    rows = [
        (1, text, "en", "a"),
        (1, text, "en", "a"),
        (2, text, "en", "a"),
        (None, text, None, None),
        (None, None, None, None),
        (3, "", "", ""),
        (4, "   \n\t \n", "en", "a"),
        (5, "one", "en", None),
        (6, " ".join(f"word{i % 977}" for i in range(60_000)), "en", "long"),
        (7, "é ß \U0001f600x ñ\x0b\x0cz\r\n" * 30, "fr", "a"),
        (8, "a b c " * 40, "en", "a"),
        (9, "line one here\nline one here\n\nline one here\nother", "en", "a"),
        (-5, "below zero " + text, "en", "a"),
    ]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def clashing(docs):
    """The same rows with columns named like the internal ones."""
    names = "key row t w whole doc spans base kept n_words set n u v component chunk rank size shard h n_chars token arc at".split()
    return docs.withColumns({n: F.lit(7) for n in names})


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
