import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[1])]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The small documents as a DataFrame and as a list of (doc_id, text)."""
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    return df, [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, _lines int, node int, bucket string, size int, component_id int, taken string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows and ids, and columns whose names clash."""
    tail = ("x", 1, 2, "b", 3, 4, "t")
    rows = [
        (None, None, None, None, None, *[None] * 7), (None, "no id at all here", "en", "a", 1, *tail), (1, "", "en", "a", 0, *tail), (2, None, "en", None, None, *tail),
        (3, "word " * 60000, "en", "a", 300000, *tail), (4, "same words in this row here", "en", "b", 1, *tail), (4, "same words in this row here", "en", "b", 1, *tail),
        (5, "Same words in this ROW here", "de", "b", 1, *tail), (5, "another text of the same id", None, "b", 1, *tail), (6, " \n\t\n ", "fr", "c", 5, *tail), (7, "12 34 !!", "en", "c", 5, *tail),
    ]
    return spark.createDataFrame(rows, ODD_SCHEMA)
