"""Disguises and clean sentences, with and without an unrelated odd character beside them."""

from __future__ import annotations

import random

import pytest

from kpiforge.llm import pii

ODD = ["", " \u2013 later", " \u201cso\u201d", "\u00a0now", " \u65e5\u672c"]


@pytest.mark.parametrize("odd", ODD)
@pytest.mark.parametrize("part", [
    "john @ example.com", "john@ example.com", "john @example.com", "john at example dot com",
    "john dot doe at example.com", "john \u00e4t example punkt com", "john arroba example punto com",
    "john at example [.] com", "john @ mail.example.com", "john@example dot com", "john @ 10.0.0.1"])
def test_disguises_beside_odd_characters(part, odd):
    text = f"write: {part} ,{odd}"
    _, added = pii.find(text)
    assert [text[a:b] for a, b in added["email"]] == [part]


@pytest.mark.parametrize("odd", ODD)
@pytest.mark.parametrize("text", [
    "We met at example.com", "john at work", "two eggs @ 3.50", "see you at 10.30", "look at this. Then go"])
def test_clean_sentences_beside_odd_characters(text, odd):
    base, added = pii.find(text + odd)
    assert not any(base.values()) and not any(added.values())


def test_texts_that_the_gate_passes_over_are_not_rewritten():
    rnd = random.Random(3)
    parts = ["at", "\u00e4t", "arobase", "@", "dot", "punkt", ".", "[", ")", "(at)", "one", "drei", "fourteen", "7", "42", "plus",
             "+", "-", "dash", ",", "a", "example.com", "a.b", "x@y.z", "\n", "\t"]
    for _ in range(30_000):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " ", " ", "  "]) for _ in range(rnd.randint(2, 9)))
        if not pii.disguised(text):
            assert pii.normalised(text).text == text


@pytest.mark.parametrize(("kind", "part"), [
    ("card", "4111 1111 1111 111 one"), ("phone", "+44 20 7946 095 eight")])
def test_a_last_spelled_digit_is_read(kind, part):
    text = f"number {part}, thanks"
    _, added = pii.find(text)
    assert [text[a:b] for a, b in added[kind]] == [part]
