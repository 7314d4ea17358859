import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from regframe.llm.common import ship
    ship(spark)


@pytest.fixture()
def odd_docs(spark):
    """Missing and empty values, a very long text, ties, repeated rows, names that clash with the operators'."""
    rows = [(1, "alpha beta gamma delta epsilon zeta", "s1"), (1, "alpha beta gamma delta epsilon zeta", "s1"),
            (2, None, "s1"), (3, "", None), (4, "   \n\t ", "s2"), (5, "Ωμέγα 😀 naïve café <|endoftext|> x", ""),
            (6, "long words here. " * 40_000, "s2"), (None, "no id but words enough to count here", None),
            (7, "x" * 70_000, "s3"), (8, "alpha beta gamma delta epsilon zeta", "s3")]
    return (spark.createDataFrame([(*r, "k", 1.0, 2) for r in rows],
                                  "doc_id long, text string, source string, key string, score double, size int"))


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, key string, score double, size int")
