import pytest
from pyspark import cloudpickle

import paperlake

cloudpickle.register_pickle_by_value(paperlake)

PAPER = "paper_id long, text string, score string, language string, hits int, class string, signature long, row string"


@pytest.fixture(scope="session")
def odd_papers(spark):
    """Papers with nulls, empty and long texts, repeated rows, and columns named like those that operators add."""
    long_text = "one two three four five six seven eight nine ten " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog."), (1, "The quick brown fox jumps over the lazy dog."), (2, None),
        (3, ""), (4, " \n\t "), (5, long_text), (None, "No id here at all, but a text."), (None, None), (6, "x"), (7, "12 34 !!"),
        (8, "你好 世界 \U0001f600"),
    ]
    return spark.createDataFrame([(i, t, "s", "l", 1, "c", 2, "r") for i, t in rows], PAPER)


@pytest.fixture(scope="session")
def no_papers(spark):
    return spark.createDataFrame([], PAPER)
