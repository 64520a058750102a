import random

import pytest

from tests.llm.helpers import frame, prose


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, a very long one, repeated rows, equal doc_ids, a null doc_id."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    twice = prose(rng, 120)
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, twice), (5, twice), (6, twice), (6, "other text"), (None, twice), (7, "z" * 3000), (8, "x y " * 200), (9, twice[:300] + " end")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
