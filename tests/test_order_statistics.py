"""Percentiles by rank over written value counts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiforge.operators.quantiles import in_buckets, percentiles, value_counts
from kpiforge.plans import star as S
from rawkit import make_raw

WANTED = [("a10", "a", 0.1), ("a50", "a", 0.5), ("a100", "a", 1.0), ("b0", "b", 0.0), ("b90", "b", 0.9),
          ("none", "c", 0.5)]


def selected(df, path, buckets):
    measures = {c: F.col(c) for c in ("a", "b", "c")}
    in_buckets(value_counts(df, measures), buckets).write.mode("overwrite").parquet(path)
    return percentiles(df.sparkSession.read.parquet(path), WANTED)


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 10, 997])
@pytest.mark.parametrize("buckets", [1, 7])
def test_equal_to_the_aggregate(spark, tmp_path, rows, buckets):
    rng = np.random.default_rng(rows)
    data = [(float(rng.integers(0, 50)) if rng.random() < .9 else None,
             float(rng.normal()) if rng.random() < .95 else None, None) for _ in range(rows)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    got = selected(df, str(tmp_path / "t"), buckets).first()
    want = df.agg(*[F.percentile(c, F.lit(p)).alias(n) for n, c, p in WANTED]).first()
    for g, w in zip(got, want):
        assert (g is None and w is None) or g == pytest.approx(w, abs=1e-12)


def test_hot_value_and_a_million_distinct_ones(spark, tmp_path):
    """A third of the rows share one value, the others are a million distinct means."""
    df = spark.range(1_500_000).select(
        F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") / 1_500_000.0).alias("a"),
        (F.col("id") % 10).cast("double").alias("b"), F.lit(None).cast("double").alias("c"))
    path = str(tmp_path / "t")
    got = selected(df, path, 16).first()
    values = np.arange(1_500_000) / 1_500_000.0
    values[::3] = 0.25
    for name, p in (("a10", .1), ("a50", .5), ("a100", 1.0)):
        assert got[name] == pytest.approx(np.quantile(values, p), abs=1e-12)
    assert (got["b0"], got["none"]) == (0.0, None)
    assert got["b90"] == pytest.approx(np.quantile(np.arange(1_500_000) % 10, .9), abs=1e-9)
    # the ranges are even: no bucket holds a large part of the values
    held = [r["count"] for r in spark.read.parquet(path).groupBy("bucket").count().collect()]
    assert len(held) == 16 and max(held) < 4 * sum(held) / 16


def test_plan_searches_only_the_buckets_of_the_ranks(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"),
                                  F.lit(None).cast("double").alias("c"))
    text = selected(df, str(tmp_path / "t"), 4)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in text and "BroadcastHashJoin" in text and "CartesianProduct" not in text


def test_thresholds_have_the_values_of_the_aggregate(spark, tmp_path):
    raw = make_raw(spark, accounts=[dict(account_id=f"A{i}") for i in range(40)],
                   support_tickets=[dict(ticket_id=f"T{i}", account_id=f"A{i % 31}", satisfaction_score=1 + i % 5,
                                         escalation_flag=i % 3 == 0) for i in range(120)])
    base = S.account_summary_base(raw)
    base.write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    in_buckets(S.threshold_counts(base)).write.parquet(str(tmp_path / "counts"))
    got = S.thresholds_of(spark.read.parquet(str(tmp_path / "counts")))
    assert got.columns == S.risk_thresholds(base).columns
    assert got.first() == S.risk_thresholds(base).first()
