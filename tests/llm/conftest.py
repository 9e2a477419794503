import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of small documents tables with clashing extra columns."""
    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", 1, "y") for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", h string, n int, words string")
    return make


#: Rows that every operator on documents must take.
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one"), (5, "one"), (None, "one two"),
       (None, None), (7, "é ß 漢字 \U0001f600 ا"), (8, "word " * 60_000), (9, "a" * 120_000),
       (10, "\x00\x01 \x1c\x85  x"), (11, "<|endoftext|> it's  <|startoftext|>")]
