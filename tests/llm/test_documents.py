"""Language ID, PII, quality rules, line dedup, fingerprints and SimHash against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kpiforge.llm import langid, linededup, minhash, pii, quality, simhash
from kpiforge.llm.common import connected_components

from llmkit import make, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001/documents.parquet"


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def roots(nodes, pairs):
    """Smallest reachable node of every node."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    expected = roots({n for p in pairs for n in p}, pairs)
    assert found == {n: expected[n] for n in linked}


# --- SimHash ---------------------------------------------------------------

def brute_print(text):
    w = WORD.findall(fold(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_simhash_equals_brute_force(odd, odd_texts, empty):
    rows = simhash.near_duplicates(odd.withColumn("fp", F.lit(1))).collect()
    prints = collections.Counter((i, brute_print(t)) for i, t in odd_texts if len(t or "") < 10_000)
    assert collections.Counter((r.doc_id, r.fp % 2**64) for r in rows if r.doc_id != 13) == prints
    nodes = {(r.doc_id, r.fp % 2**64) for r in rows}
    pairs = [(a, b) for a in nodes for b in nodes if (a[1] ^ b[1]).bit_count() <= 2]
    member = collections.defaultdict(set)
    group = roots({str(n) for n in nodes}, [(str(a), str(b)) for a, b in pairs])
    for n in nodes:
        member[group[str(n)]].add(n[0])
    for r in rows:
        ids = [i for i in member[group[str((r.doc_id, r.fp % 2**64))]] if i is not None]
        assert r.component_id == (min(ids) if ids else None)
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_connect_what_brute_force_connects(spark, bits):
    rnd = random.Random(bits)
    prints = set()
    for _ in range(12):
        centre = rnd.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 3))))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.links_within(spark.createDataFrame([(p,) for p in signed], "fp long"), bits).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= bits for r in links)
    brute = [(a, b) for a in signed for b in signed if ((a ^ b) % 2**64).bit_count() <= bits]
    assert roots(signed, [(r.a, r.b) for r in links]) == roots(signed, brute)


def test_one_document_of_each_group_stays(odd, odd_texts):
    kept = simhash.keep_one(odd).collect()
    ids = [r.doc_id for r in kept]
    assert 5 in ids and 6 not in ids and 0 in ids and 1 not in ids
    # one row of each group: equal texts once, and both texts of the repeated id 15
    assert len({r.text for r in kept}) == len(kept) and ids.count(15) == 2 and ids.count(14) == 1
    assert kept[0].__fields__ == odd.columns


# --- fingerprints ----------------------------------------------------------

def test_fingerprints(spark, empty):
    rnd = random.Random(8)
    texts = [(k, words(rnd, rnd.choice([0, 1, 4, 5, 6, 80, 400]))) for k in range(60)]
    texts += [(100, texts[7][1]), (101, None), (102, "日本語 é " * 30), (None, "first")]
    got = {r.doc_id: r for r in minhash.with_edits(make(spark, texts)).collect()}
    assert len(got) == len(texts)
    ordered = sorted(((i, t or "") for i, t in texts), key=lambda r: -1 if r[0] is None else r[0])

    def shingles(t):
        w = WORD.findall(fold(t))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[i].near_edited - jaccard(shingles(t), shingles(edited))) < 0.13
        assert abs(got[i].near_next - jaccard(shingles(t), shingles(after))) < 0.13
    assert got[7].fingerprint == got[100].fingerprint
    assert minhash.with_edits(empty).count() == 0
    assert minhash.with_edits(make(spark, [(1, "only one here now ok")])).first().near_next == 1.0


# --- quality rules ---------------------------------------------------------

def test_base_measures_equal_brute_force(odd, odd_texts, empty):
    rows = quality.verdicts(odd.withColumn("q_n", F.lit(1)).withColumn("count", F.lit(2))).collect()
    got = collections.Counter(tuple(r)[:7] for r in rows)
    expected = collections.Counter()
    for i, t in odd_texts:
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        cover = {p for k in range(len(w) - 2) if seen[tuple(w[k:k + 3])] > 1 for p in (k, k + 1, k + 2)}
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        expected[i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"),
                 len(lines) - len(set(lines)), len(cover), failed] += 1
    assert got == expected
    assert quality.verdicts(empty).count() == 0


def test_repeated_windows(spark):
    text = " ".join(["a b c d"] * 20 + ["u v w x y z"])
    row = quality.verdicts(make(spark, [(1, text)])).first()
    assert (row.n_words, row.n_repeat_words, row.base_failed, row.kept) == (86, 80, True, False)


def test_boilerplate_goes_copies_and_clean_documents_stay(spark):
    rnd = random.Random(6)
    header = words(rnd, 10)
    nav = [words(rnd, 14) for _ in range(6)]
    texts = [(k, header + "\n" + words(rnd, 40) + "\n" + words(rnd, 40)) for k in range(60)]
    for k in range(60, 120):  # pages with two of the menu lines
        texts.append((k, "\n".join([*rnd.sample(nav, 4), words(rnd, 120)])))
    texts.append((200, "\n".join(nav)))  # nothing but menu lines
    original = [words(rnd, 30) for _ in range(6)]
    for k in range(300, 360):  # near copies, one line of their own each
        lines = list(original)
        lines[k % 6] = words(rnd, 30)
        texts.append((k, "\n".join(lines)))
    docs = make(spark, texts)
    kept = {r.doc_id: r for r in quality.verdicts(docs, min_docs=10).collect()}
    assert not kept[200].kept and not kept[200].base_failed
    assert all(kept[i].kept for i, _ in texts if i < 200)
    assert all(kept[k].n_removed_words == 10 for k in range(60))
    # near copies are distinct documents: the five lines that 50 of them share go
    assert all(kept[k].n_removed_words == 150 and not kept[k].kept for k in range(300, 360))
    cleaned = {r.doc_id: r for r in quality.clean(docs, min_docs=10).collect()}
    assert 200 not in cleaned and cleaned[0].text == "\n".join(dict(texts)[0].split("\n")[1:])
    assert cleaned[0].n_chars == len(cleaned[0].text) and 300 not in cleaned


@pytest.mark.parametrize(("menu_words", "own_words"), [(14, 30), (40, 10), (80, 3)])
def test_template_pages_count_one_each(spark, menu_words, own_words):
    rnd = random.Random(menu_words)
    menu = [words(rnd, menu_words) for _ in range(6)]
    texts = [(k, "\n".join([*menu, words(rnd, own_words)])) for k in range(60)]
    texts += [(100 + k, texts[k][1]) for k in range(5)]  # a copy counts with its page
    texts += [(200 + k, words(rnd, 90)) for k in range(5)]
    rows = quality.verdicts(make(spark, texts)).collect()
    assert {r.doc_id: r.n_removed_words for r in rows} == {k: 6 * menu_words if k < 200 else 0 for k, _ in texts}
    assert all(r.kept == (r.doc_id >= 200) for r in rows)


def test_pages_with_some_lines_of_a_template_count_one_each(spark):
    rnd = random.Random(16)
    menu = [words(rnd, 14) for _ in range(20)]
    texts = [(k, "\n".join([*rnd.sample(menu, 12), words(rnd, 12)])) for k in range(80)]
    rows = quality.verdicts(make(spark, texts)).collect()
    assert all(r.n_removed_words == 12 * 14 and not r.kept for r in rows)


# --- line dedup ------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def edited(rnd, line, n):
    chars = list(line)
    for _ in range(n):
        p, what = rnd.randrange(len(chars)), rnd.randrange(3)
        if what == 0:
            chars[p] = rnd.choice("xyz")
        elif what == 1:
            chars.insert(p, rnd.choice("xyz é"))
        else:
            del chars[p]
    return "".join(chars)


def allowed(a, b):
    n = min(len(a), len(b))
    return 0 if n < linededup.SHORT else 1 if n < linededup.MIN_CHARS else 2


@pytest.mark.parametrize("hot_key", [linededup.HOT_KEY, 3])
def test_line_dedup_equals_brute_force(spark, empty, monkeypatch, hot_key):
    monkeypatch.setattr(linededup, "HOT_KEY", hot_key)
    rnd = random.Random(9)
    lines = [words(rnd, rnd.randint(4, 14)) for _ in range(30)] + [words(rnd, rnd.randint(1, 4)) for _ in range(15)]
    lines += ["published by " + words(rnd, rnd.randint(1, 6)) for _ in range(15)]
    texts = []
    for k in range(60):
        own = [edited(rnd, rnd.choice(lines), rnd.choice([0, 0, 1, 1, 2, 2, 3])) for _ in range(6)]
        texts.append((k, "\n".join([*own, "short", words(rnd, 8)])))
    texts += [(70, None), (71, ""), (72, texts[3][1]), (None, texts[4][1] + "\n" + words(rnd, 9))]
    got = {r.doc_id: r.removed for r in linededup.summary(make(spark, texts).withColumn("pos", F.lit(1))).collect()}
    occ = []
    for i, t in texts:
        for p, raw in enumerate((t or "").split("\n")):
            line = raw.strip(linededup.BLANKS).lower()
            if line:
                occ.append((2**63 if i is None else i, p, line))
    kinds = sorted({o[2] for o in occ})
    near = [(a, b) for k, a in enumerate(kinds) for b in kinds[k + 1:]
            if abs(len(a) - len(b)) <= 2 and distance(a, b) <= allowed(a, b)]
    root = roots(kinds, near)
    first, expected = {}, collections.defaultdict(list)
    for i, p, line in sorted(occ):
        if first.setdefault(root[line], (i, p)) != (i, p):
            expected[i].append(p)
    assert len(near) > 20
    assert got == {i: ",".join(map(str, expected[2**63 if i is None else i])) for i, _ in texts}
    assert linededup.summary(empty).count() == 0


def test_deduplicated_texts(spark):
    line = "the quick brown fox jumps over the lazy dog"
    docs = make(spark, [(1, f"a\n{line}\n{line}x"), (2, f"b\n  {line.upper()} \nc"), (3, line), (4, None)])
    got = {r.doc_id: (r.text, r.n_chars) for r in linededup.deduplicated(docs).collect()}
    assert got == {1: (f"a\n{line}", 45), 2: ("b\nc", 3), 3: ("", 0), 4: (None, None)}


def test_banded_distance(spark):
    rnd = random.Random(5)
    rows = [(x, edited(rnd, x, rnd.randint(0, 4))) for x in (
        "".join(rnd.choice("abcd é🙂") for _ in range(rnd.randint(24, 60))) for _ in range(600))]
    split = spark.createDataFrame(rows, "x string, y string").select(
        "x", "y", F.split("x", "").alias("xs"), F.split("y", "").alias("ys"), F.length("x").alias("m"),
        F.length("y").alias("n"))
    for t in (1, 2, 3):
        got = split.select("x", "y", linededup.within_edits(
            F.col("xs"), F.col("ys"), F.col("m"), F.col("n"), t).alias("near")).collect()
        assert all(r.near == (distance(r.x, r.y) <= t) for r in got)


# --- PII -------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_base_spans_equal_the_patterns():
    rnd = random.Random(2)
    for _ in range(4000):
        text = "".join(rnd.choice("ab1.@+-% ()56é") for _ in range(rnd.randint(0, 40)))
        found = pii.detect(text)
        assert found["email"] == [m.span() for m in EMAIL.finditer(text)]
        assert found["phone"] == [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                                  if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
        assert found["ip"] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
                               if all(int(p) <= 255 for p in m.group().split("."))]


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("john at example dot com please", "email", "john at example dot com"),
    ("see jоhn@example.com", "email", "jоhn@example.com"),
    ("jo​hn@exam​ple.com", "email", "jo​hn@exam​ple.com"),
    ("ip 10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
    ("ip １９２.１６８.１.１", "ip", "１９２.１６８.１.１"),
    ("four-one-one-one-one-one-one-one-one-one-one-one-one-one-one-one", "card",
     "four-one-one-one-one-one-one-one-one-one-one-one-one-one-one-one"),
    ("call +1 five five five one two three four five six seven", "phone",
     "+1 five five five one two three four five six seven"),
])
def test_disguises_map_back(text, kind, part):
    _, added = pii.find(text)
    assert [text[a:b] for a, b in added[kind]] == [part]


@pytest.mark.parametrize("text", ["We met at example.com", "four five six of us at home dot", "un deux trois quatre",
                                  "été à Paris – 3 jours…", "john at work", ""])
def test_clean_texts_have_no_spans(text):
    base, added = pii.find(text)
    assert not any(base.values()) and not any(added.values())


def test_pii_over_odd_rows(odd, odd_texts, empty, spark):
    assert pii.spans(odd).count() == len(odd_texts) and pii.spans(empty).count() == 0
    row = pii.spans(make(spark, [(1, "é a@b.c 1.2.3.4 +1 (743) 555-3824 x 4111 1111 1111 1111")])).first()
    assert row.spans == "email:2:7,ip:8:15,card:36:55,phone:16:33"
    masked = pii.masked(make(spark, [(1, "é a@b.c, x"), (2, None)])).collect()
    assert [(r.text, r.n_chars) for r in masked] == [("é <EMAIL>, x", 12), (None, None)]


# --- language identification -----------------------------------------------

def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(odd, odd_texts, empty):
    rows = langid.identified(odd).collect()
    assert len(rows) == len(odd_texts)
    by_id = {r.doc_id: r.lang_pred for r in rows}
    assert by_id[0] == by_id[1] == by_id[2] == "und" and by_id[5] == "en"
    assert langid.identified(empty).count() == 0


def test_kernel_matches_its_definition():
    rnd = random.Random(1)
    texts = [words(rnd, 40).encode() for _ in range(12)]
    sets = [langid.grams(np.frombuffer(t, np.uint8)) for t in texts]
    model = langid.fit([("ab"[k % 2], s) for k, s in enumerate(sets)], landmarks=3)
    mark = [sets[k] for k in (0, 1, 2, 3, 4, 5)]
    space = set(np.concatenate(mark).tolist())
    x = model.presence([np.frombuffer(texts[9], np.uint8)])
    got = (x @ model.landmarks) / np.sqrt(x.sum())
    own = space & set(sets[9].tolist())
    expected = [len(own & set(m.tolist())) / np.sqrt(len(own) * len(m)) for m in mark]
    assert np.allclose(got[0], expected, atol=1e-5)
