"""One doc_id, or no id, on a third of all rows and more: dealt over tasks, results whole (op1, op8)."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.llm import minhash, tokenfile
from kpiforge.llm.vocab import tokenizer
from llmkit import make, words


@pytest.fixture(scope="module")
def texts():
    """400 texts without an id, 300 equal rows of one id, 200 texts of another, 100 ids of their own."""
    rnd = random.Random(3)
    same = words(rnd, 30)
    found = [(None, words(rnd, rnd.randint(0, 20))) for _ in range(400)]
    found += [(7, same)] * 300 + [(9, words(rnd, 12)) for _ in range(200)]
    found += [(1000 + k, words(rnd, rnd.choice([0, 3, 40]))) for k in range(100)] + [(7, words(rnd, 9)), (7, "")]
    rnd.shuffle(found)
    return found


@pytest.fixture(scope="module")
def table(spark, texts):
    return make(spark, texts).repartition(3).cache()


def test_rows_of_an_id_span_ranges(spark, table):
    rows, repeated = minhash._in_ranges(table, 16)
    held = [r.n for r in rows.where("not guest").groupBy(F.spark_partition_id().alias("p")).agg(
        F.count("*").alias("n")).collect()]
    assert repeated and max(held) < 200 and len(held) > 5
    assert rows.where("not guest").agg(F.sum("times")).first()[0] == 1002
    assert rows.where("doc_id = 7 and not guest").count() == 3


def test_fingerprints_of_repeated_ids(spark, table, texts):
    ranked = spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string").select(
        "doc_id", "text", F.xxhash64("text").alias("rank")).collect()
    ordered = sorted(ranked, key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.rank))
    expected = collections.Counter()
    for k, row in enumerate(ordered):
        t, after = row.text, ordered[(k + 1) % len(ordered)].text
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        expected[row.doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
    got = minhash.with_edits(table).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == expected
    copies = [r for r in got if r.doc_id == 7 and r.n_chars == len(dict(texts[::-1]).get(7, "")) and r.near_next == 1]
    assert len({r.fingerprint for r in copies}) <= 1
    assert sum(r.doc_id == 7 and r.near_next == 1 for r in got) == 299


def test_equal_rows_alone(spark):
    got = minhash.with_edits(make(spark, [(None, "a b c d e f g")] * 500)).collect()
    assert len(got) == 500 and {(r.doc_id, r.near_next) for r in got} == {(None, 1.0)}
    assert len({r.fingerprint for r in got}) == 1


def test_token_files_of_repeated_ids(spark, table, texts):
    path = tokenfile.token_files(table)
    rows = tokenfile.read_digests(spark, path).orderBy("start").collect()
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert [r.doc_id for r in rows] == sorted((i for i, _ in texts), key=lambda i: -(2**63) if i is None else i)
    expected = collections.Counter()
    for i, t in texts:
        ids = [*tokenizer(tokenfile.TOKENIZER).encode(t, add_special_tokens=False).ids, tokenfile.END_ID]
        expected[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected
    found = collections.Counter(tuple(r.ids) for r in tokenfile.read_documents(spark, path, [7]).collect())
    assert max(found.values()) == 300 and sum(found.values()) == 302
