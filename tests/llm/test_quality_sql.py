"""The quality rules against their SQL, on lines above the limit, copies and odd rows."""

from __future__ import annotations

import random

import duckdb
import pytest

from kpiforge.llm import quality

from llmkit import SCHEMA, words


def _rows():
    rnd = random.Random(5)
    header, footer = words(rnd, 9), words(rnd, 40)
    rows = [(k, f"{header.upper() if k % 3 else header}\n{words(rnd, 60)}\n  {footer}\t", "a") for k in range(30)]
    rows += [(100 + k, f"{words(rnd, 60)}\n{header}", "b") for k in range(15)]  # few documents at this host
    rows += [(150 + k, f"{words(rnd, 55)}\n{header}", None) for k in range(25)]  # a null host
    copy = "\n".join(words(rnd, 30) for _ in range(3))
    rows += [(200 + k, copy, "a") for k in range(60)]  # exact copies count as one
    rows += [(300 + k, f"{copy}\n{words(rnd, 3)}", "a") for k in range(30)]  # near copies
    rows += [(400, f"{header}\n{footer}\n{footer}", "a"), (401, " ".join([words(rnd, 3)] * 40), "a")]
    rows += [(402, f"{header}\n{words(rnd, 50)}", "a")] * 2
    rows += [(403, None, "a"), (404, "", "b"), (405, " \t\n ", None), (None, f"{header}\n{words(rnd, 50)}", "a")]
    return rows


def test_verdicts_equal_the_sql(spark):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in _rows()]
    got = quality.verdicts(spark.createDataFrame(rows, SCHEMA))
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
        result = con.execute(quality.VERDICTS_SQL)
        assert [c[0] for c in result.description] == got.columns
        expected = result.fetchall()
    found = [tuple(r) for r in got.collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
    removed = {r[0] for r in found if r[-1] > 0}
    assert set(range(30)) | {400, 402, None} <= removed
    assert not removed & set(range(100, 115))
    assert set(range(200, 260)) | set(range(300, 330)) <= removed  # the copies are one, their near copies 30 documents
    assert {150, 174} <= removed


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_odd_documents_equal_the_sql(spark, request, name):
    docs = request.getfixturevalue(name)
    rows = [tuple(r) for r in docs.collect()]
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
        if rows:
            con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
        expected = con.execute(quality.VERDICTS_SQL).fetchall()
    assert sorted((tuple(r) for r in quality.verdicts(docs).collect()), key=str) == sorted(expected, key=str)
