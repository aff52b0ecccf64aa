import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: doc_id, text: nulls, empties, ties, repeated rows, a long text, odd characters.
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly pack my box with five dozen liquor jugs".split()
LONG = " ".join(WORDS[(i * i + i // 7) % len(WORDS)] + ("" if i % 11 else ".") for i in range(30_000))
ODD = [
    (0, None), (1, ""), (2, " \t\n\r"), (3, "a"), (4, "One two three four five six seven."), (4, "One two three four five six seven."),
    (5, "one  two\nthree FOUR five six seven."), (6, "日本語 text ▁ with 😀 and\x00nul"), (7, "x" * 5000), (8, LONG), (9, LONG + " end"),
    (None, "no id"), (None, None), (10, "Ünïcode ÉTÉ straße\x0bvt"), (11, "<|endoftext|> <s> </s> 'S don't"), (12, "tab\tsep \x85 nel   ls"),
]


@pytest.fixture
def odd(spark):
    """Rows with further columns whose names clash with those the operators use."""
    extra = "fp long, node string, id int, digest string, runs int, _id int, lang string, source string, n_chars long"
    rows = [(*r, 1, "n", 2, "d", 3, 4, "en", "s", len(r[1] or "")) for r in ODD]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


@pytest.fixture
def none(odd):
    return odd.filter("doc_id = -1")


@pytest.fixture
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
