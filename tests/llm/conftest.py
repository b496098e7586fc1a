import random

import pytest

WORDS = "alpha beta gamma delta omega sigma kappa lambda theta zeta iota rho tau phi chi psi".split()


@pytest.fixture
def rows(spark):
    """Makes a table of (doc_id, text) with columns whose names operators use inside."""
    def make(texts, first=0):
        data = [(i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1],
                 "x", 7, 3) for i, t in enumerate(texts, first)]
        return spark.createDataFrame(
            data, "doc_id bigint, text string, id string, h int, n int").repartition(3)

    return make


def prose(seed, words, vocabulary=4000):
    draw = random.Random(seed)
    return " ".join(f"{draw.choice(WORDS)}{draw.randrange(vocabulary)}" for _ in range(words))


#: Nulls, empties, blanks, odd characters, a long text, ties and repeated rows.
ODD = [None, "", " ", "\t\n", "a", "é", "日本 ▁ x", "a\x00b", "x" * 5000, "one two", "one  two",
       "One Two", (100, "same row"), (100, "same row"), (None, "no id"), (None, None)]
