"""The interval-arithmetic snapshot equals the literal month-end range join."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kpiforge.operators.intervals import monthly_active

D = dt.date


def brute(subs, bounds):
    """Literal form: months x subscriptions with the active predicate."""
    days = bounds.select(F.explode(F.sequence("cal_start", "cal_end")).alias("d"))
    months = days.groupBy(F.date_format("d", "yyyy-MM").alias("year_month")) \
                 .agg(F.max("d").alias("month_end"))
    j = months.join(subs, (subs.start_date <= months.month_end) &
                    (subs.end_date.isNull() | (subs.end_date >= months.month_end)))
    return j.groupBy("year_month").agg(F.count(F.lit(1)).alias("active_rows"),
                                       F.sum("v").alias("active_value"),
                                       F.count_distinct("k").alias("active_distinct"))


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_snapshot_matches_range_join(spark, seed):
    rnd = random.Random(seed)
    base = D(2022, 12, 20)
    rows = []
    for i in range(300):
        s = base + dt.timedelta(days=rnd.randrange(0, 500))
        e = None if rnd.random() < 0.3 else s + dt.timedelta(days=rnd.randrange(-5, 200))
        v = None if rnd.random() < 0.05 else rnd.randrange(0, 50)
        k = None if rnd.random() < 0.02 else f"a{rnd.randrange(0, 25)}"
        if rnd.random() < 0.02:
            s = None
        rows.append((k, s, e, v))
    subs = spark.createDataFrame(rows, "k string, start_date date, end_date date, v int")
    cal_end = base + dt.timedelta(days=rnd.randrange(480, 720))
    bounds = spark.createDataFrame([(base, cal_end)], "cal_start date, cal_end date")
    got = sorted(tuple(r) for r in monthly_active(subs, bounds, "v", "k").collect())
    want = sorted(tuple(r) for r in brute(subs, bounds)
                  .select("year_month", "active_rows", "active_value", "active_distinct").collect())
    assert got == want


def test_snapshot_month_edges(spark):
    """Ends on, before and after month ends; leap day; calendar ending mid-month."""
    rows = [
        ("a", D(2024, 1, 31), D(2024, 1, 31), 1),   # ends exactly on a month end
        ("a", D(2024, 1, 31), D(2024, 2, 28), 2),   # one day short of Feb's end (leap year)
        ("b", D(2024, 2, 29), D(2024, 2, 29), 4),   # leap day, one-day subscription
        ("b", D(2024, 2, 1), D(2024, 1, 15), 8),    # ends before it starts
        ("c", D(2024, 3, 31), None, 16),            # open, starts on a month end
        ("c", D(2024, 4, 10), D(2024, 4, 20), 32),  # inside the partial last month, ends on its end
        ("d", D(2023, 12, 1), D(2024, 4, 21), 64),  # ends after the calendar's last day
    ]
    subs = spark.createDataFrame(rows, "k string, start_date date, end_date date, v int")
    bounds = spark.createDataFrame([(D(2024, 1, 5), D(2024, 4, 20))], "cal_start date, cal_end date")
    got = sorted(tuple(r) for r in monthly_active(subs, bounds, "v", "k").collect())
    want = sorted(tuple(r) for r in brute(subs, bounds)
                  .select("year_month", "active_rows", "active_value", "active_distinct").collect())
    assert got == want
    assert [r[0] for r in got] == ["2024-01", "2024-02", "2024-03", "2024-04"]
