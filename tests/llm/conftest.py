import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, label string, n_words int"
LONG = "Shared footer line that is long enough to be counted as one"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank and very long texts, repeated rows, and columns whose names operators use themselves."""
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b"), (4, "word " * 30_000), (5, "x" * 60_000), (6, "the same text of some words here"),
        (7, "the same text of some words here"), (7, "the same text of some words here"), (None, "no id at all but the words of a text"),
        *[(10 + i, f"Own line number {i} of this document\n  {LONG.upper() if i % 2 else LONG}\t\nend {i}") for i in range(7)],
    ]
    rows = [(i, t, None, "s", None, 0, "l", 3) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
