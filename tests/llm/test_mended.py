"""Inputs on which operators once lost data: colliding hashes, template pages, one id with many texts, clashing names."""

from __future__ import annotations

import hashlib
import random

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kpiforge.llm import bpe, langid, linededup, packing, quality, simhash, tokencount, tokenfile, vocab, wordblocks
from llmkit import SCHEMA, make, words


# ------------------------------------------------ chunks with equal hashes

def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


@pytest.fixture(scope="module")
def twins():
    """Two different words whose polynomial hashes modulo 2^64 are equal, in one text, two texts and again."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    return [(1, f"x {one} y"), (2, f"x {other} y"), (3, f"{other} {one} {one}"), (4, one), (5, other)]


def test_the_pair_does_collide(twins):
    import numpy as np
    a, b = (t.encode() for t in (twins[3][1], twins[4][1]))
    data = np.frombuffer(a + b, np.uint8)
    h = wordblocks.hash_spans(data, np.array([0, len(a)]), np.array([len(a), len(a) + len(b)]))
    assert a != b and h[0] == h[1]


def ids_of(name, text):
    return Tokenizer.from_file(vocab.resolve(name)).encode(text, add_special_tokens=False).ids


def crc(ids):
    import zlib
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def test_byte_bpe_of_colliding_words(spark, twins):
    rows = {r.doc_id: r for r in bpe.round_trip(make(spark, twins).repartition(1)).collect()}
    ranks = vocab.ranks("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=vocab.pattern(), mergeable_ranks=ranks, special_tokens={})
    for i, text in twins:
        ids = library.encode_ordinary(text)
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_token_files_of_colliding_words(spark, twins):
    files = tokenfile.token_files(make(spark, twins).repartition(1))
    for r in tokenfile.read_digests(spark, files).collect():
        assert r.ids_crc32 == crc([*ids_of("word_bpe_49k.json", dict(twins)[r.doc_id]), 2])


def test_packing_of_colliding_words(spark, twins):
    pieces = {}
    for r in packing.packed(make(spark, twins).repartition(1)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i, text in twins:
        ids = [*ids_of("byte_bpe_50k.json", text), 0]
        assert sorted(pieces[i]) == sorted((a, n, crc(ids[a:a + n])) for a, n, _ in pieces[i])


def test_token_counts_of_colliding_words(spark, twins):
    rows = tokencount.edited_counts(make(spark, twins).repartition(1), tokencount.redactions).collect()
    first = next(c for c in rows[0].asDict() if c in ("n_tokens", "tokens", "count"))
    for r in rows:
        assert r[first] == len(ids_of("byte_bpe_50k.json", dict(twins)[r.doc_id]))


def test_colliding_words_across_batches(twins):
    import pyarrow as pa
    encoder = bpe.encoder()
    encoder.table.clear()
    for texts in ([twins[3][1]], [twins[4][1]], [twins[4][1], twins[3][1]]):
        got = list(encoder.batch(pa.array(texts)))
        for _, _, counts, rows, ids in got:
            assert bpe.decode(ids.astype("int64"))[0].decode() == "".join(texts)


def test_equal_spans_compares_whole_bytes():
    import numpy as np
    rnd = random.Random(3)
    texts = [bytes(rnd.choice(b"ab") for _ in range(n)) for n in (0, 1, 7, 8, 9, 16, 511, 512, 513, 2000) for _ in range(3)]
    texts += [t[:-1] + b"c" for t in texts if t] + [t + b"\0" for t in texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    length = np.array([len(t) for t in texts])
    at = np.cumsum(length) - length
    wide = wordblocks.padded(data)
    for i, t in enumerate(texts):
        k = np.full(len(texts), i)
        same = wordblocks.equal_spans(wide, at, length, wide, at[k], length[k])
        assert same.tolist() == [u == t for u in texts]


# ------------------------------------------------------------ template pages

def _menu(rnd):
    return [words(rnd, 40) for _ in range(6)]


def corpora():
    rnd = random.Random(77)
    menu = _menu(rnd)
    pages = [(i, "\n".join([*menu, words(rnd, 10)])) for i in range(300)]
    variants = [(1000 + 20 * v + k, "\n".join([*menu, f"variant {v} {'x' * v} line", words(rnd, 150)]))
                for v in range(20) for k in range(20)]
    return {"pages": pages, "pages and the bare menu": [*pages, (999, "\n".join(menu))], "variants": variants,
            "copies count once": [(i, "\n".join(menu)) for i in range(100)] + [
                (200 + i, " \t" + "\n".join(menu).upper() + " ") for i in range(50)]}


@pytest.mark.parametrize("name", list(corpora()))
def test_template_pages_count_one_each_in_code_and_sql(spark, name):
    rnd = random.Random(78)
    rows = corpora()[name] + [(5000 + i, words(rnd, 70)) for i in range(40)]
    docs = make(spark, rows)
    got = sorted((tuple(r) for r in quality.verdicts(docs).collect()), key=str)
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [tuple(r) for r in docs.collect()])
        assert got == sorted(con.execute(quality.VERDICTS_SQL).fetchall(), key=str)
    touched = {r[0] for r in got if r[-1] > 0}
    kept = {r[0] for r in got if r[-2]}
    assert not touched & set(range(5000, 5040)) and set(range(5000, 5040)) <= kept
    if name.startswith("copies"):
        assert not touched
    else:
        assert touched == {i for i, _ in corpora()[name]}
        assert (name == "variants") == bool(kept & touched)


def test_a_repeated_row_is_measured_once(spark):
    rnd = random.Random(5)
    menu = words(rnd, 20)
    rows = [(i, f"{menu}\n{words(rnd, 60)}") for i in range(30)]
    got = quality.verdicts(make(spark, rows + rows[:1])).where("doc_id = 0").collect()
    assert [r.n_removed_words for r in got] == [20, 20] and all(r.kept for r in got)


# ------------------------------------------------- one row of each component

def test_many_texts_under_one_id_all_stay(spark):
    rnd = random.Random(9)
    rows = [(1, words(rnd, 30)) for _ in range(200)]
    kept = simhash.keep_one(make(spark, rows)).collect()
    assert sorted(r.text for r in kept) == sorted(t for _, t in rows)


# ----------------------------------------------------------- clashing columns

CLASH = ["row", "hash", "q_hash", "q_key", "q_bad", "q_host", "ld_doc", "ld_hash", "ld_drop", "sh_doc", "sh_hash", "doc",
         "root", "fp", "key", "lid", "n", "pos", "e", "who", "h"]


@pytest.mark.parametrize("stage", [quality.clean, linededup.deduplicated, simhash.keep_one])
def test_stages_return_clashing_columns_unchanged(spark, stage):
    rnd = random.Random(4)
    rows = [(i, f"{words(rnd, 60)}\n{words(rnd, 8)}") for i in range(6)] + [(9, words(rnd, 70))] * 2 + [(None, words(rnd, 55))]
    docs = make(spark, rows)
    plain = sorted((r.doc_id, r.text) for r in stage(docs).where("doc_id is not null").collect())
    mine = docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASH})
    got = stage(mine)
    assert got.columns == mine.columns
    found = got.where("doc_id is not null").collect()
    assert sorted((r.doc_id, r.text) for r in found) == plain
    assert all(r[c] == f"{c}-{r.doc_id}" for r in found for c in CLASH)


def test_operators_pass_over_clashing_columns(spark):
    rnd = random.Random(4)
    docs = make(spark, [(i, words(rnd, 60)) for i in range(5)])
    mine = docs.withColumns({c: F.lit(1) for c in [*CLASH, "ids", "start", "n_tokens", "rank", "salt", "sequence_id"]})
    for run in (quality.verdicts, linededup.summary, simhash.near_duplicates, bpe.round_trip, packing.packed,
                langid.identified):
        assert sorted(map(tuple, run(docs).collect())) == sorted(map(tuple, run(mine).collect()))


# -------------------------------------------------------------------- letters

@pytest.mark.parametrize("text", ["½", "²", "① 12", "_ 3 !", "٣"])
def test_signs_that_are_no_letters_have_no_language(spark, text):
    rows = [(i, f"the words of english number {i}") for i in range(30)] + [(1000, text), (1001, "é")]
    got = {r.doc_id: r for r in langid.identified(make(spark, rows)).collect()}
    assert got[1000].lang_pred == "und" and got[1000].score == 0 and got[1001].lang_pred == "en"


def test_repeated_ids_give_one_model(spark):
    rnd = random.Random(2)
    rows = [(i % 7, words(rnd, 20)) for i in range(60)]
    docs = make(spark, rows)
    first = langid.learn(docs)
    again = langid.learn(docs.orderBy(F.rand(3)).repartition(5))
    assert (first.weights == again.weights).all() and (first.landmarks == again.landmarks).all()
    assert first.languages == ["en"]


def test_sql_has_all_queries_that_it_can_express():
    from kpiforge.llm import queries
    assert set(queries.oracle_sql()) <= set(queries.queries()) and SCHEMA


# ---------------------------------------------------------------- short lines

def test_short_lines_that_repeat_go(spark):
    rnd = random.Random(6)
    rows = [(i, f"Share this article\n{words(rnd, 30)}\n\nAll rights reserved.") for i in range(50)]
    got = linededup.summary(make(spark, rows)).collect()
    assert sum(r.n_removed for r in got) == 98 and {r.doc_id: r.removed for r in got}[0] == ""
    kept = {r.doc_id: r.text for r in linededup.deduplicated(make(spark, rows)).collect()}
    assert kept[7] == rows[7][1].split("\n")[1] + "\n"  # the empty line is no repeat


def test_rows_without_an_id_are_documents_of_their_own(spark):
    rnd = random.Random(6)
    line = words(rnd, 12)
    rows = [(None, f"{line}\n{words(rnd, 20)}") for _ in range(10)]
    got = linededup.summary(make(spark, rows)).collect()
    assert sum(r.n_removed for r in got) == 9
    same = linededup.summary(make(spark, [(None, line)] * 4)).collect()
    assert sum(r.n_removed for r in same) == 0


def test_a_common_opening_does_not_pair_all_lines(spark):
    """Candidate pairs of lines that begin alike grow with the lines, not with their square."""
    rnd = random.Random(12)
    found = {}
    for n in (1000, 2000):
        lines = [f"Published by {words(rnd, 4)}" for _ in range(n - 20)]
        lines += [x[:-1] + "zz" for x in lines[:20]]
        docs = make(spark, list(enumerate(lines)))
        table = linededup.distinct_lines(linededup.line_table(docs)).cache()
        members = linededup.shared_keys(table).cache()
        texts = docs.select(F.explode(F.split("text", "\n")).alias("raw")).select(
            linededup.normal(F.col("raw")).alias("line")).distinct().select(F.xxhash64("line").alias("lid"), "line")
        found[n] = linededup.candidates(members, texts).count()
        assert sum(r.n_removed for r in linededup.summary(docs).collect()) >= 20
    assert found[2000] < 20 * 2000 and found[2000] < 4 * found[1000] + 200
