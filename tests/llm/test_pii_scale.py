"""Personal data in long monotonous texts, and card numbers by brute force."""

from __future__ import annotations

import random
import re
import time

import pytest

from kpiforge.llm import pii

MB = 1_000_000
LONG = {
    "numbers": "one two three four. " + "12 345 " * (MB // 7),
    "numbers with one odd character": "12 345 " * (MB // 7) + "–",
    "digits": "7" * MB,
    "dotted letters": "a." * (MB // 2) + "–",
    "blanks": " " * MB + "–",
    "at signs": "a@" * (MB // 2) + "–",
    "at words": "a at " * (MB // 5) + "–",
    "brackets": "( " * (MB // 2) + "–",
    "plus signs": "+1 " * (MB // 3) + "–",
    "spread words": ("one" + " " * 1000) * (MB // 1000),
    "dotted numbers": "1." * (MB // 2) + "–",
}


@pytest.mark.parametrize("name", list(LONG))
def test_a_megabyte_takes_seconds(name):
    began = time.perf_counter()
    pii.find(LONG[name])
    assert time.perf_counter() - began < 15


@pytest.mark.parametrize("name", list(LONG))
def test_data_at_the_end_of_a_long_text_is_found(name):
    tail = "\nMail jo@example.com, also jo.x (at) example (dot) com, call +44 20 7946 0958, host 10.1.2.3, card 4111 1111 1111 1111"
    text = LONG[name] + tail
    base, added = pii.find(text)
    at = len(LONG[name])
    assert [text[a:b] for a, b in base["email"] if a > at] == ["jo@example.com"]
    assert [text[a:b] for a, b in added["email"] if a > at] == ["jo.x (at) example (dot) com"]
    assert [text[a:b] for a, b in base["ip"] if a > at] == ["10.1.2.3"]
    assert [text[a:b] for a, b in base["card"] if a > at] == ["4111 1111 1111 1111"]
    assert [text[a:b] for a, b in base["phone"] if a > at] == ["+44 20 7946 0958"]


def brute_cards(text):
    """The contract's pattern tried at every place, leftmost and apart."""
    found, at = [], 0
    pattern = re.compile(r"[0-9]([\x20-]?[0-9])+")
    while (m := pattern.search(text, at)) is not None:
        digits = [int(c) for c in m.group() if c in "0123456789"]
        doubled = [d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            found.append(m.span())
        at = m.end()
    return found


def brute_ips(text):
    found, at = [], 0
    pattern = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    while (m := pattern.search(text, at)) is not None:
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append(m.span())
        at = m.end()
    return found


def test_cards_and_addresses_equal_the_patterns():
    rnd = random.Random(8)
    hits = 0
    for _ in range(6000):
        text = "".join(rnd.choice(["4111", "1111", "0", "4", "5500", "0000", " ", "-", "x", "  ", "\n", "0004", ".", "1", "255", "256"])
                       for _ in range(rnd.randint(0, 14)))
        if rnd.random() < .3:
            text += rnd.choice(["4111 1111 1111 1111", "5500-0000-0000-0004", "10.0.0.255", "1.2.3.4.5.6.7.8", "0000000000000000000"])
        got = pii.detect(text)
        assert got["card"] == brute_cards(text) and got["ip"] == brute_ips(text)
        hits += len(got["card"]) + len(got["ip"])
    assert hits > 800


def test_aligned_offsets_are_arrays():
    line = pii.normalised("jo – (at) ex[dot]com")
    assert line.start.dtype.kind == "i" and len(line.start) == len(line.end) == len(line.text) == len(line.changed)
