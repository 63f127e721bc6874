"""Byte-level BPE over the corpus: blocks, slices of words, and words that many blocks share."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from kpiforge.llm import bpe
from kpiforge.llm.vocab import rank_encoding
from llmkit import SCHEMA, make, words


def expected(texts):
    out = []
    for i, t in texts:
        ids = np.array(rank_encoding(bpe.RANKS).encode_ordinary(t or ""), "<u4")
        out.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=key)


def words_of(data, lengths):
    out, at = [], 0
    for n in bpe._unpacked(lengths).tolist():
        out.append(bytes(data[at:at + n]))
        at += n
    return out


def key(r):
    return r[0] is None, r[0] or 0, r[2]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(21)
    common = words(rnd, 40)
    return ([(i, f"{common} {words(rnd, 30)}\n\n{i} {i * 7919}") for i in range(150)]
            + [(None, common)] * 40 + [(500, ""), (501, None), (502, "é" * 3000 + " x" * 500), (503, "\n" * 900)])


@pytest.mark.parametrize("limit", [1, 5_000, bpe.BLOCK_TEXT])
def test_any_size_of_block_gives_the_ids_of_the_library(spark, texts, limit):
    docs = make(spark, texts).repartition(3)
    assert sorted(map(tuple, bpe.round_trip(docs, limit=limit).collect()), key=key) == expected(texts)


def test_blocks_hold_each_document_once(spark, texts):
    docs = make(spark, texts).repartition(3)
    blocks = bpe.word_blocks(docs, limit=5_000).collect()
    assert len({b.block for b in blocks}) == len(blocks) > 3
    assert sorted((i is None, i or 0) for b in blocks for i in b.doc_ids) == sorted((i is None, i or 0) for i, _ in texts)
    found = []
    for b in blocks:
        listed = words_of(b.words, b.lengths)
        assert len(set(listed)) == len(listed) == b.n_words
        at, of = 0, bpe._unpacked(b.numbers).tolist()
        for i, n in zip(b.doc_ids, bpe._unpacked(b.sizes).tolist()):
            found.append((i is None, i or 0, b"".join(listed[k] for k in of[at:at + n]).decode()))
            at += n
    assert sorted(found) == sorted((i is None, i or 0, t or "") for i, t in texts)


@pytest.mark.parametrize("together", [1, 7, bpe.SLICE_WORDS])
def test_slices_of_the_corpus_give_the_same_ids(spark, together):
    rnd = random.Random(5)
    corpus = sorted({*words(rnd, 200).split(), " the", "aaaa" * 50, "\n\n", " 123", "日本", "é"})
    rows = []
    for block in range(4):  # every block has half of the words
        raw = [w.encode() for w in rnd.sample(corpus, len(corpus) // 2)]
        rows.append((0, block, bytearray(zstandard.compress(b"".join(raw))), bytearray(bpe._packed(np.array(list(map(len, raw)))))))
    table = spark.createDataFrame(rows, "bucket long, block long, words binary, lengths binary").coalesce(1)
    coder = rank_encoding(bpe.RANKS)
    got = bpe.replayed(table, together=together).collect()
    assert len(got) == len(rows)
    for r, (_, block, data, lengths) in zip(sorted(got, key=lambda r: r.block), rows):
        ids = [coder.encode_ordinary(w.decode()) for w in words_of(zstandard.decompress(bytes(data)), bytes(lengths))]
        assert r.block == block
        assert bpe._unpacked(r.counts).tolist() == list(map(len, ids))
        assert bpe._unpacked(r.ids).tolist() == [x for own in ids for x in own]


@pytest.mark.parametrize("buckets", [1, 3, 1000])
def test_buckets_keep_the_order_of_a_block_and_agree_between_blocks(spark, texts, buckets):
    blocks = bpe.word_blocks(make(spark, texts).repartition(3), limit=5_000)
    rows = bpe.in_buckets(blocks, buckets).collect()
    bucket_of, listed = {}, {}
    for r in sorted(rows, key=lambda r: r.bucket):
        for word in words_of(zstandard.decompress(bytes(r.words)), r.lengths):
            assert bucket_of.setdefault(word, r.bucket) == r.bucket
            listed.setdefault(r.block, []).append(word)
    assert listed == {b.block: words_of(b.words, b.lengths) for b in blocks.collect() if b.n_words}
    assert buckets == 1 or len(set(bucket_of.values())) > 1


def test_a_full_table_starts_a_new_block():
    rnd = random.Random(8)
    parts = [words(rnd, 50) for _ in range(6)]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t])], ["doc_id", "text"]) for i, t in enumerate(parts)]
    lister = bpe.WordLister(limit=60)
    blocks = [b for out in lister.cut(iter(batches), 10) for b in out.to_pylist()]
    assert [b["block"] for b in blocks] == list(range(10, 10 + len(blocks))) and len(blocks) > 1
    assert [i for b in blocks for i in b["doc_ids"]] == list(range(6))
    for b in blocks:
        listed = words_of(b["words"], b["lengths"])
        whole = b"".join(listed[k] for k in bpe._unpacked(b["numbers"]).tolist()).decode()
        assert whole == "".join(parts[i] for i in b["doc_ids"])


def test_many_distinct_words(spark):
    text = " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(70_000))
    rows = bpe.encode_documents(make(spark, [(1, text), (2, "ab")])).collect()
    coder = rank_encoding(bpe.RANKS)
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {
        1: coder.encode_ordinary(text), 2: coder.encode_ordinary("ab")}


def test_empty_table_and_clashing_columns(spark, texts):
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = make(spark, texts[:20])
    mine = docs.withColumns({c: F.lit(1) for c in ("block", "word", "words", "place", "ids", "numbers", "sizes", "doc_ids")})
    assert sorted(map(tuple, bpe.round_trip(mine).collect()), key=key) == expected(texts[:20])


def test_blocks_are_not_shuffled(spark, texts, capsys):
    bpe.round_trip(make(spark, texts).repartition(3), limit=5_000).explain("simple")
    plan = capsys.readouterr().out
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
    assert plan.count("Exchange hashpartitioning(to") == 1 and "hashpartitioning(home" not in plan
