"""Fixtures of the operator tests: small tables with nulls, ties, repeats and clashing columns."""
import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def word():
    rng = random.Random(3)

    def make(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))

    make.rng = rng
    return make


@pytest.fixture(scope="session")
def odd_docs(spark, word):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    shared, long = word(80, 100), word(30_000, 101)
    rows = [(i, word(60, i), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, shared + " x " + word(50, 200), "en", "s0", 1), (101, word(40, 201) + " y " + shared, "en", None, None),
             (102, word(60, 1), "en", "s1", 1), (102, word(60, 1), "en", "s1", 1), (103, None, None, None, None), (104, "", "en", "s2", 0),
             (105, " \n\t ", "en", "s2", 3), (None, word(60, 2), "en", "s1", 1), (None, None, None, None, None),
             (106, long, "en", "s0", 9), (107, "ä" * 500, "de", "s1", 500), (108, "a" * 1000, "en", "s1", 1000)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
