"""Active-at-month-end snapshots without a range join.

Semantics: a subscription is active in month m when
``start_date <= month_end(m) AND (end_date IS NULL OR end_date >= month_end(m))``,
where month_end(m) is the last calendar day of m (the calendar's last day
for its final month). Months with no active subscription do not appear.

Instead of joining every subscription with every month (a nested-loop
join whose output is the sum of active months per subscription), each
subscription is reduced to the contiguous range of month indexes it covers
[first, last]. Sums then follow from +value at ``first`` and -value at
``last + 1`` plus a running total over the months; distinct accounts follow
from the union of each account's ranges (gaps and islands). Work is linear
in the subscriptions and every shuffle is pre-aggregated: an account that
owns a third of all subscriptions still shrinks to at most one row per
calendar month before its window runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.columns import month_index, month_label


def _months_of(bounds: DataFrame) -> tuple[Column, Column, Column]:
    """(cal_end, first month index, last month index) from one scalar subquery."""
    b = bounds.select(F.struct(
        F.col("cal_end").alias("cal_end"),
        month_index("cal_start").alias("lo_m"),
        month_index("cal_end").alias("hi_m"))).scalar()
    return b["cal_end"], b["lo_m"], b["hi_m"]


def month_coverage(subs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Adds ``m_first``/``m_last``: the month indexes whose month end the row is active at.

    Rows active at no month end are dropped.
    """
    cal_end, lo_m, hi_m = _months_of(bounds)
    s, e = F.col("start_date"), F.col("end_date")
    end_of_start_month = F.least(F.last_day(s), cal_end)
    first = F.when(end_of_start_month >= s, month_index(s)).otherwise(month_index(s) + 1)
    end_of_end_month = F.least(F.last_day(e), cal_end)
    last = (F.when(e.isNull(), hi_m)
             .when(end_of_end_month <= e, month_index(e))
             .otherwise(month_index(e) - 1))
    return (subs.where(s.isNotNull())
                .withColumn("m_first", F.greatest(first, lo_m))
                .withColumn("m_last", F.least(last, hi_m))
                .where(F.col("m_first") <= F.col("m_last")))


def calendar_months(bounds: DataFrame) -> DataFrame:
    """One row per calendar month index ``m`` (12 per calendar year)."""
    return bounds.select(F.explode(F.sequence(month_index("cal_start"),
                                              month_index("cal_end"))).alias("m"))


def _running(months: DataFrame, deltas: DataFrame, cols: list[str]) -> DataFrame:
    """Left join month deltas onto all months and turn them into running totals.

    The window is unpartitioned but runs over one row per calendar month.
    """
    w = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = months.join(deltas, "m", "left")
    return joined.select("m", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(c) for c in cols])


def monthly_active(subs: DataFrame, bounds: DataFrame, value_col: str | None = None,
                   distinct_col: str | None = None) -> DataFrame:
    """Per month with at least one active row: ``year_month``, ``active_rows``,
    optionally ``active_value`` (SUM of value_col over active rows, NULL when all
    are NULL) and ``active_distinct`` (COUNT DISTINCT of distinct_col)."""
    cov = month_coverage(subs, bounds)
    value = F.col(value_col) if value_col else F.lit(None).cast("bigint")
    nn = F.when(value.isNotNull(), F.lit(1)).otherwise(F.lit(0))
    events = cov.select(F.inline(F.array(
        F.struct(F.col("m_first").alias("m"), value.alias("d_value"), F.lit(1).alias("d_rows"),
                 nn.alias("d_nn")),
        F.struct((F.col("m_last") + 1).alias("m"), (-value).alias("d_value"), F.lit(-1).alias("d_rows"),
                 (-nn).alias("d_nn")),
    )))
    deltas = events.groupBy("m").agg(F.sum("d_value").alias("d_value"),
                                     F.sum("d_rows").alias("d_rows"), F.sum("d_nn").alias("d_nn"))
    months = calendar_months(bounds)
    out = _running(months, deltas, ["d_value", "d_rows", "d_nn"])
    if distinct_col:
        out = out.join(_distinct_running(cov, months, distinct_col), "m", "left")
    out = out.where(F.col("d_rows") > 0)
    cols = [month_label("m").alias("year_month"), F.col("d_rows").cast("bigint").alias("active_rows")]
    if value_col:
        cols.append(F.when(F.col("d_nn") > 0, F.col("d_value")).alias("active_value"))
    if distinct_col:
        cols.append(F.col("d_distinct").cast("bigint").alias("active_distinct"))
    return out.select(*cols)


def _distinct_running(cov: DataFrame, months: DataFrame, key: str) -> DataFrame:
    """Running count of keys with at least one active row, per month.

    Each key's ranges are first collapsed per (key, m_first) — at most one
    row per calendar month per key — then merged into islands in a window
    per key; every island adds +1 at its start and -1 after its end.
    """
    starts = (cov.where(F.col(key).isNotNull())
                 .groupBy(key, "m_first").agg(F.max("m_last").alias("m_last")))
    w = Window.partitionBy(key).orderBy("m_first")
    prev_end = F.max("m_last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = starts.withColumn(
        "__new", F.when(prev_end.isNull() | (F.col("m_first") > prev_end + 1), 1).otherwise(0))
    islands = (flagged
               .withColumn("__island", F.sum("__new").over(
                   w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
               .groupBy(key, "__island")
               .agg(F.min("m_first").alias("a"), F.max("m_last").alias("b")))
    deltas = (islands.select(F.inline(F.array(
        F.struct(F.col("a").alias("m"), F.lit(1).alias("d")),
        F.struct((F.col("b") + 1).alias("m"), F.lit(-1).alias("d")),
    ))).groupBy("m").agg(F.sum("d").alias("d_distinct")))
    return _running(months, deltas, ["d_distinct"])
