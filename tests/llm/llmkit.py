"""Makers of small documents tables."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, texts, source="s", lang="en"):
    """A documents table from (doc_id, text) pairs."""
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdeghilmnorstu") for _ in range(rnd.randint(2, 8))) for _ in range(n))
