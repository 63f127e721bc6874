"""Personal data with offset-preserving deobfuscation.

Base spans are found in the text as it is, leftmost and non-overlapping per
kind; a match that fails its check is dropped without another try. Disguised
identifiers are found in a normalised text: a chain of transducers rewrites
homoglyphs, spelled digits and at/dot disguises, each output character keeping
the source span that it stands for. "user @ host.tld" is a disguise; "user at
host.tld" is prose unless one of its dots is spoken or disguised. The same detectors run on the normalised
text, and spans that involve rewritten characters are mapped back to the source and added,
unless they are, or partly overlap, a base span of their kind.

Every pattern starts at an anchor (a digit run, an at sign, a bracket, a number word)
and is extended from there once, so the time follows the length of the text whatever
it holds; offsets are arrays of integers.

Defined results: a null or empty text has no spans; texts of any length are
searched whole; repeated rows give repeated results; a null doc_id stays null;
an empty table gives no rows; extra columns are passed over (``masked``
returns them).
"""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import map_text, ship_package

KINDS = ("email", "ip", "card", "phone")

_MAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# From the start of a digit run: a match that starts inside one would also start there.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MAIL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    if "@" not in text:
        return []
    found, end = [], 0
    for m in _MAIL_TAIL.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _MAIL_CHARS:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            end = m.end()
    return found


def detect(text: str) -> dict[str, list[Span]]:
    """Spans of each kind, in code points, end exclusive."""
    ips = [m.span() for m in _IP.finditer(text)
           if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    cards = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if "+" in text
              and 8 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return {"email": _emails(text), "ip": ips, "card": cards, "phone": phones}


# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТУХаеіјорсухѕ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ" "ԁԛԝһɡıⅼ" "․。｡‐‑‒–—−⁃",
    "ABESIJKMHOPCTYXaeijopcyxs" "ABEZHIKMNOPTYXovp" "dqwhgil" "...-------"))
_HIDDEN = frozenset("­​‌‍⁠﻿")
# The words for the digits 0 to 9 in English, French, German and Spanish.
_DIGIT_WORDS = {
    word: str(i) for words in (
        "zero one two three four five six seven eight nine",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    ) for i, word in enumerate(words.split())} | {"oh": "0"}
_AT_WORDS = "at|arobase|arroba|ät"
_DOT_WORDS = "dot|point|punkt|punto|período|periodo"

_ODD = re.compile(r"[^\x00-ɏ]|[­ ²³¹]")
_NUMBER = "(?:" + "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True)) + ")"
_GAP = r"(?:[ \t,]*-[ \t]*|[ \t,]+)"
# Three or more spelled digits, or digits mixed with spelled ones, with spelled signs between.
_SIGN = rf"(?:{_DOT_WORDS}|dash|hyphen|minus)"
_ITEM = re.compile(rf"(?<!\w)(?:(?P<word>{_NUMBER})|[0-9]++)(?!\w)")
_BETWEEN = re.compile(rf"{_GAP}{_SIGN}{_GAP}|{_GAP}|\.")
_ONLY_GAP = re.compile(_GAP)
_HAS_SPELLED = re.compile(rf"(?<!\w){_NUMBER}(?:[\s,.-]+(?:{_SIGN}[\s,-]+)?(?:{_NUMBER}|[0-9]+)(?!\w)){{2}}"
                          rf"|[0-9](?:[\s,.-]+(?:{_SIGN}[\s,-]+)?){_NUMBER}(?!\w)")
_PIECE = re.compile(rf"{_NUMBER}(?!\w)|{_SIGN}|plus|\+|\.|[0-9]+|{_GAP}")
_OPEN, _SHUT = r"(?:(?<![ \t])[ \t]++)?[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
_BRACKETED = re.compile(rf"{_OPEN}(?:(?P<at>{_AT_WORDS}|@)|(?P<dot>{_DOT_WORDS}|\.))(?:{_SHUT})")
_AT = re.compile(rf"(?<![^ \t])(?:{_AT_WORDS})(?![^ \t])|@")
_HOST = re.compile(rf"[a-z0-9-]++(?:(?:[ \t]++(?:{_DOT_WORDS})[ \t]++|\.)[a-z0-9-]++)+(?![a-z0-9])")
_USER_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_%+-")
_SPOKEN_DOT = re.compile(rf"(?<![ \t])[ \t]++(?:{_DOT_WORDS})[ \t]+")
_LAST_DOT = re.compile(rf"(?<![^ \t])(?:{_DOT_WORDS})$")
_LONGEST_DOT = max(map(len, _DOT_WORDS.split("|")))
# An at word or a spaced @ before a host: all that _SPOKEN can rewrite but spoken dots around a plain @.
_SPOKEN_AT = re.compile(rf"(?:[ \t](?:(?:{_AT_WORDS})[ \t]+|@[ \t]*)|@[ \t]+)"
                        rf"[a-z0-9-]+(?:[ \t]+(?:{_DOT_WORDS})[ \t]+|\.)[a-z0-9-]")
_DECIMAL = re.compile(r"[0-9]+\.[0-9]+")


@lru_cache(maxsize=1 << 16)
def _plain(char: str) -> str:
    """The ASCII character that ``char`` stands for, or itself; hidden characters vanish."""
    if char in _HIDDEN:
        return ""
    if char in _LOOKALIKES:
        return _LOOKALIKES[char]
    if char.isdecimal():
        return str(unicodedata.decimal(char))
    folded = unicodedata.normalize("NFKC", char)
    return folded if len(folded) == 1 and ord(folded) < 128 else char


class Aligned:
    """A text whose every character knows its source span and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [a, b) by each text, edits in order and apart; the first character takes the whole source."""
        if not edits:
            return
        text, start, end, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += [self.start[at:a], np.full(len(new), self.start[a])]
            end += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            changed += [self.changed[at:a], np.ones(len(new), bool)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start = np.concatenate([*start, self.start[at:]])
        self.end = np.concatenate([*end, self.end[at:]])
        self.changed = np.concatenate([*changed, self.changed[at:]])

    def source(self, span: Span) -> Span:
        return int(self.start[span[0]]), int(self.end[span[1] - 1])

    def rewritten(self, span: Span) -> bool:
        """Whether a character in or beside the span was rewritten, or hidden ones were taken out."""
        a, b = span
        return bool(self.changed[a:b].any() or (self.end[a:b - 1] != self.start[a + 1:b]).any())


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def disguised(text: str) -> bool:
    """Whether any transducer could have work in the text."""
    if not text.isascii() and _ODD.search(text):
        return True
    low = _lower(text)
    if _BRACKETED.search(low) or _SPOKEN_AT.search(low) or ("@" in low and _SPOKEN_DOT.search(low)):
        return True
    return _HAS_SPELLED.search(low) is not None


def _homoglyphs(line: Aligned) -> None:
    line.rewrite([(m.start(), m.end(), _plain(m.group())) for m in _ODD.finditer(line.text)
                  if _plain(m.group()) != m.group()])


def _brackets(line: Aligned) -> None:
    line.rewrite([(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(_lower(line.text))])


def _prefix(text: str, start: int, least: int) -> int:
    """Where a plus sign or word before ``start`` begins, or ``start``; nothing before ``least`` counts."""
    at = start
    while at > least and text[at - 1] in " \t,-":
        at -= 1
    low = at - 4
    if low >= least and text[low:at] == "plus" and _ONLY_GAP.fullmatch(text, at, start) and not _is_word(text, low - 1):
        return low
    at = start
    while at > least and text[at - 1] in " \t":
        at -= 1
    if at > least and text[at - 1] == "+" and not _is_word(text, at - 2):
        return at - 1
    return start


def _is_word(text: str, at: int) -> bool:
    return at >= 0 and (text[at].isalnum() or text[at] == "_")


def _runs(text: str) -> Iterator[Span]:
    """Longest chains of numbers with a spelled one among them, with a plus before."""
    first = last = done = 0
    spelled = False
    for m in _ITEM.finditer(text):
        if last and _BETWEEN.fullmatch(text, last, m.start()):
            spelled = spelled or m["word"] is not None
        else:
            if spelled:
                yield _prefix(text, first, done), last
            done, first, spelled = last, m.start(), m["word"] is not None
        last = m.end()
    if spelled:
        yield _prefix(text, first, done), last


def _spelled_digits(line: Aligned) -> None:
    """Runs of spelled digits become digits without the gaps between them."""
    edits = []
    low = _lower(line.text)
    for begin, end in _runs(low):
        pieces = [(m.start(), m.end(), m.group()) for m in _PIECE.finditer(low, begin, end)]
        if sum(w in _DIGIT_WORDS or w[0].isdigit() for _, _, w in pieces) < 3:
            continue
        for a, b, word in pieces:
            if word in _DIGIT_WORDS:
                edits.append((a, b, _DIGIT_WORDS[word]))
            elif word == "plus":
                edits.append((a, b, "+"))
            elif re.fullmatch(_DOT_WORDS, word):
                edits.append((a, b, "."))
            elif re.fullmatch(_SIGN, word):
                edits.append((a, b, "-"))
            elif word not in "+." and not word[0].isdigit():
                edits.append((a, b, ""))
    line.rewrite(edits)


def _user_start(text: str, end: int, least: int) -> int:
    """Where the longest user part that ends at ``end`` begins: words joined by dots, spoken or not."""
    at = end
    while True:
        word = at
        while word > least and text[word - 1] in _USER_CHARS:
            word -= 1
        if word == at:
            return end if at == end else joint
        # a word; what joins it to another one before it?
        if word > least and text[word - 1] == ".":
            joint, at = word, word - 1
            continue
        gap = word
        while gap > least and text[gap - 1] in " \t":
            gap -= 1
        low = max(least, gap - _LONGEST_DOT - 1)
        dot = _LAST_DOT.search(text, low, gap) if gap < word else None
        if dot is None or dot.start() == low and low > least and text[low - 1] not in " \t":
            return word
        before = dot.start()
        while before > least and text[before - 1] in " \t":
            before -= 1
        if before == dot.start():
            return word
        joint, at = word, before


def _spoken_mails(text: str) -> Iterator[tuple[Span, Span, Span]]:
    """(user, at, host) of each address with a spaced or spoken at, from the at outwards."""
    done = 0
    for m in _AT.finditer(text):
        a, b = m.span()
        while a > done and text[a - 1] in " \t":
            a -= 1
        while b < len(text) and text[b] in " \t":
            b += 1
        if m.start() < done or m.group() != "@" and (a == m.start() or b == m.end()):
            continue
        host = _HOST.match(text, b)
        if host is None:
            continue
        user = _user_start(text, a, done)
        if user < a:
            yield (user, a), (a, b), host.span()
            done = host.end()


def _spoken(line: Aligned) -> None:
    edits = []
    text = _lower(line.text)
    for user, at, host in _spoken_mails(text):
        sign = text[slice(*at)]
        told = any(_SPOKEN_DOT.search(text, *part) for part in (user, host))
        if sign == "@" and not told:
            continue
        # Without a spoken or rewritten dot, "at" between words is ordinary prose.
        if sign.strip() != "@" and not told and not any(
                line.changed[i] for part in (user, host) for i in range(*part) if line.text[i] == "."):
            continue
        if not told and _DECIMAL.fullmatch(text, *host):  # "2 @ 3.50" is a price
            continue
        for part in (user, host):
            edits += [(*d.span(), ".") for d in _SPOKEN_DOT.finditer(text, *part)]
        edits.append((*at, "@"))
    line.rewrite(sorted(edits))


def normalised(text: str) -> Aligned:
    """The text after all transducers, aligned with its source."""
    line = Aligned(text)
    for step in (_homoglyphs, _brackets, _spelled_digits, _spoken):
        step(line)
    return line


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """(base spans, added spans) of each kind."""
    base = detect(text)
    added = {kind: [] for kind in KINDS}
    if not disguised(text):
        return base, added
    line = normalised(text)
    for kind, spans in detect(line.text).items():
        taken = sorted(base[kind])
        ends = [y for _, y in taken]
        for span in spans:
            if line.rewritten(span):
                a, b = line.source(span)
                # Where a base span is only a part of it, the whole is added beside it.
                first, after = bisect.bisect_right(ends, a), bisect.bisect_left(taken, (b, b))
                if all(a <= x and y <= b and (a, b) != (x, y) for x, y in taken[first:after]):
                    added[kind].append((a, b))
    return base, added


def spans_text(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, SHA-256 of the base spans, all spans, n_added."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, texts, extra = [[] for _ in KINDS], [], [], []
        for value in batch.column(1):
            base, added = find(value.as_py() or "")
            for column, kind in zip(counts, KINDS):
                column.append(len(base[kind]))
            digests.append(hashlib.sha256(spans_text(base).encode()).hexdigest())
            texts.append(spans_text({k: base[k] + added[k] for k in KINDS}))
            extra.append(sum(map(len, added.values())))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in counts],
             pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(extra, pa.int64())],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    return map_text(docs, ["doc_id", "text"], "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                    "base_sha256 string, spans string, n_added long", run)


def mask(text: str) -> str:
    """The text with every span replaced by its kind's label; overlapping spans take the first kind's."""
    base, added = find(text)
    found = sorted((a, b, kind) for kind in KINDS for a, b in base[kind] + added[kind])
    out, at = [], 0
    for k, (a, b, kind) in enumerate(found):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with personal data masked (n_chars follows the text)."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            new = [None if v is None else mask(v) for v in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    ship_package(docs.sparkSession)
    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else out
