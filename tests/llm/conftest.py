import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}

#: Rows that every operator has to take: nulls in every column, empty and long texts, ties, repeated rows, repeated and null ids.
EDGE_ROWS = [
    (1, "a b c d e f g h", "en", "s"),
    (2, "A B c d e f g h", None, None),
    (3, None, None, None),
    (4, "", "en", "s"),
    (4, "", "en", "s"),
    (5, "x", "de", "s"),
    (5, "y", "de", "s"),
    (None, "a b c d e f g h", "en", "s"),
    (None, None, None, None),
    (7, "wort " * 30000, "de", "s"),
    (8, " \t\n\v\f\r ", "en", "s"),
    (9, "é日本 🎉 ▁   \x00 \\ <|end|>", "fr", "s"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """EDGE_ROWS with extra columns whose names clash with internal ones."""
    rows = [(*r, "keep", 1, 2.0) for r in EDGE_ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, doc_key int, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
