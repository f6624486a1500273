import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long, id string, h int, row string, kept int, ids int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use themselves."""

    def build(rows):
        langs, sources = ["en", "de", None], ["a", "a", "b", None]
        full = [
            (d, t, langs[i % 3], sources[i % 4], None if t is None else len(t), "x", i, "r", None, 7)
            for i, (d, t) in enumerate(rows)
        ]
        return spark.createDataFrame(full, KIND)

    return build


@pytest.fixture(scope="session")
def corpus():
    return brute.documents()


@pytest.fixture(scope="session")
def odd():
    """Null ids, repeated rows, and an id with two texts."""
    long = " ".join(f"word{i}" for i in range(80))
    return [(None, long), (None, long), (5, long), (5, long), (5, "other"), (2, None), (2, ""), (3, ""), (9, "a b"), (1, long + "\n" + long)]
