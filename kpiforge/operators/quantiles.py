"""Exact, interpolated percentiles.

Two forms with equal results. ``percentile_cont`` is an aggregate expression: it
merges a value -> count map, so its memory follows the number of distinct values;
it serves plans that are composed without writing anything. ``value_counts``,
``in_buckets`` and ``percentiles`` select by rank over a *written* table of value
counts, so that no task ever holds all values: per-bucket counts give the bucket
of each rank, and only that bucket is searched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentile_cont(col: str | Column, p: float) -> Column:
    """PERCENTILE_CONT(p) WITHIN GROUP (ORDER BY col), NULLs ignored.

    ``percentile_approx`` is not used: it returns an observed value instead of
    interpolating.
    """
    return F.percentile(col, F.lit(p))


def value_counts(df: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """(measure, value, n): how often each non-null value of each measure occurs.

    One pass over ``df`` and one aggregate with map-side combine; a value that
    a third of all rows share is one row per map task.
    """
    cells = F.array(*[F.struct(F.lit(name).alias("measure"), col.cast("double").alias("value"))
                      for name, col in measures.items()])
    return (df.select(F.explode(cells).alias("c")).select("c.measure", "c.value")
            .where(F.col("value").isNotNull())
            .groupBy("measure", "value").agg(F.count(F.lit(1)).alias("n")))


def in_buckets(counts: DataFrame, buckets: int | None = None) -> DataFrame:
    """Value counts dealt out by range: adds ``bucket``, ascending with (measure, value).

    To be written before it is read again. Values are distinct within a
    measure, so the ranges are about even whatever the data. Without a number
    the session's shuffle partitions decide (AQE joins small neighbours).
    """
    by = [F.col("measure"), F.col("value")]
    dealt = counts.repartitionByRange(buckets, *by) if buckets else counts.repartitionByRange(*by)
    return dealt.withColumn("bucket", F.spark_partition_id())


def percentiles(bucketed: DataFrame, wanted: Sequence[tuple[str, str, float]]) -> DataFrame:
    """One row with a column per (column name, measure, p) of ``wanted``.

    ``bucketed`` is a written result of ``in_buckets``. Rank h = p * (N - 1) lies
    between two whole ranks; each is found by the counts of the buckets before
    it, and its value by a running count inside its bucket alone. A measure
    without values gives NULL.
    """
    per_bucket = bucketed.groupBy("measure", "bucket").agg(F.sum("n").alias("held"))
    of_measure = Window.partitionBy("measure")
    before = F.sum("held").over(of_measure.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    placed = per_bucket.select(
        "measure", "bucket", "held", F.coalesce(before, F.lit(0)).alias("before"),
        F.sum("held").over(of_measure).alias("total"))
    asked = F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(m).alias("of"), F.lit(float(p)).alias("p"))
                                for a, m, p in wanted]))
    h = F.col("a.p") * (F.col("total") - 1)
    part = h - F.floor(h)
    ends = F.explode(F.array(F.struct(F.floor(h).alias("rank"), (1 - part).alias("weight")),
                             F.struct(F.ceil(h).alias("rank"), part.alias("weight"))))
    chosen = (placed.withColumn("a", asked).where("a.of = measure").withColumn("e", ends)
              .where("before <= e.rank AND e.rank < before + held")
              .select("measure", "bucket", "before", F.col("a.name").alias("name"), "e.rank", "e.weight"))
    # two rows per wanted percentile at most, so the join sends them to the buckets
    inside = bucketed.join(F.broadcast(chosen), ["measure", "bucket"])
    running = F.sum("n").over(Window.partitionBy("name", "rank", "weight").orderBy("value")
                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = (inside.withColumn("upto", F.col("before") + running).where("upto > rank")
             .groupBy("name", "rank", "weight").agg(F.min("value").alias("value")))
    # the lower and the upper end coincide on a whole rank: weights 1 and 0
    return found.agg(*[F.sum(F.when(F.col("name") == name, F.col("value") * F.col("weight"))).alias(name)
                       for name, _, _ in wanted])


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
