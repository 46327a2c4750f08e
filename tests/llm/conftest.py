import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Documents from (doc_id, text) pairs, with two extra columns whose names clash with internal ones."""
    data = [(d, t, "en", "s", None if t is None else len(t), 7, "x") for d, t in rows]
    return spark.createDataFrame(data, SCHEMA + ", TEXT_ int, `blob` string")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    words = [random.Random(1).choice("alpha beta gamma delta omega".split()) for _ in range(40_000)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, " ".join(words)), (5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (7, "One TWO three four"), (8, "a"), (9, "token = abcdef1234")]
    return documents(spark, rows)
