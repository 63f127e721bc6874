"""The pipeline: order, columns, and rows against a brute-force run of the same stages."""

from __future__ import annotations

import random

import corpus_pipeline
from kpiforge.llm import packing, pii
from kpiforge.llm.vocab import tokenizer

from llmkit import SCHEMA, words


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "pii", "packing"]


def test_run_on_a_small_corpus(spark, tmp_path):
    rnd = random.Random(12)
    line = words(rnd, 12)
    texts = {k: words(rnd, 60) + "\n" + words(rnd, 30) for k in range(20)}
    texts[20] = texts[3]  # exact copy
    texts[21] = words(rnd, 70) + "\n" + line
    texts[22] = words(rnd, 70) + "\n" + line.replace(line[5], "", 1)  # one edit away
    texts[23] = words(rnd, 60) + " write to john [at] example [dot] com"
    texts[24] = "too short"
    texts[25] = None
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))

    kept = {k: t for k, t in texts.items() if k not in (24, 25)}
    kept[20] = ""  # every line of the copy is a repeated one
    kept[22] = kept[22].split("\n")[0]
    kept[23] = kept[23][:kept[23].index("john")] + "<EMAIL>"
    expected = {k: len(tokenizer(packing.TOKENIZER).encode(t, add_special_tokens=False).ids) + 1
                for k, t in kept.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == expected
    assert sum(r.length for r in got) == sum(expected.values())


def test_stages_return_the_columns_of_documents(spark, odd, empty):
    for docs in (odd, empty):
        for _, function in corpus_pipeline.STAGES[:-1]:
            assert function(spark, docs, "").columns == docs.columns
    assert pii.mask("") == ""
