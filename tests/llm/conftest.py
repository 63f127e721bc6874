"""Documents with every awkward case."""

from __future__ import annotations

import random

import pytest
from llmkit import SCHEMA, make, words


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empties, blanks, scripts, ties, repeated rows, a null id, and a long text."""
    rnd = random.Random(11)
    base = words(rnd, 120)
    return [
        (0, None), (1, ""), (2, " \t\n\x0b "), (3, "one"), (4, "two words"), (5, base), (6, base),
        (7, base.replace("a", "o", 1)), (8, "Écoute, ça va? été"), (9, "日本語 テスト　です。"),
        (10, "🙂 🙂🙂a\n\nb  c"), (11, "a\x1cb\x85c \xa0 d"), (12, "12 345 <|endoftext|> don't 'save x,'s"),
        (13, words(rnd, 30_000)), (14, "x" * 5_000), (14, "x" * 5_000), (15, "same id, one"), (15, "same id, two"),
        (None, "no id"), (2**40, words(rnd, 60) + "\n" + words(rnd, 10)),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return make(spark, odd_texts).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
