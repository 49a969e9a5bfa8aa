"""Small awkward tables that every operator must take."""

import random

import pytest

LONG = " ".join(f"word{i % 977} of the long text," for i in range(6000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, row string, size string, key string, keep_id string, score string, k string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    texts = ["The cat sat on the mat and looked at the moon", "the cat SAT on the mat and looked at the moon", "Die Katze saß auf der Matte und sah den Mond",
             "Ärger über Öl", "ÄRGER über Öl", "", None, "   \n\t ", LONG, LONG.upper(), "123 456 !!", "one", "one two", "A\x0bB\x0cC D E"]
    langs = ["en", "en", "de", "de", None, "en", "de", None, "en", "en", None, "en", "en", "de"]
    rows = [(i, t, langs[i], None if i % 5 == 4 else f"s{i % 3}", None, *["x"] * 0, i * 7, "x", "x", "x", "x", None, "x", "x") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, None, None, None, None, None, None, None, None, None, None, None, None), (None, "one", "en", "s1", 3, 1, "", "", "", "", "", "", "")]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.limit(0)


@pytest.fixture
def rng():
    return random.Random(5)
