"""Calendar dimension: one row per day between data-derived bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds_from(spans: list[DataFrame]) -> DataFrame:
    """One row (cal_start, cal_end) from per-table (lo, hi) one-row aggregates."""
    u = spans[0]
    for s in spans[1:]:
        u = u.unionByName(s)
    return u.agg(F.min("lo").alias("cal_start"), F.max("hi").alias("cal_end"))


def date_dimension(bounds: DataFrame) -> DataFrame:
    """Days from cal_start to cal_end inclusive, with calendar attributes.

    The day series is generated from the one-row bounds with
    ``sequence``; it has one row per calendar day, so its size follows the
    date span, not the data volume.
    """
    days = bounds.select(
        F.explode(F.sequence("cal_start", "cal_end", F.expr("INTERVAL 1 DAY"))).alias("date_key"))
    d = F.col("date_key")
    return days.select(
        d.cast("date").alias("date_key"),
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.dayofweek(d).alias("weekday_num"),
    )
