"""Reusable column expressions.

All are compositions of ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def year_month(c: Column | str) -> Column:
    """'yyyy-MM' label of a date."""
    return F.date_format(_c(c), "yyyy-MM")


def month_index(c: Column | str) -> Column:
    """Months since year 0: year*12 + month - 1 (consecutive months differ by 1)."""
    d = _c(c)
    return F.year(d) * 12 + F.month(d) - 1


def month_label(idx: Column | str) -> Column:
    """'yyyy-MM' label of a month index."""
    i = _c(idx)
    return F.date_format(F.make_date(F.floor(i / 12).cast("int"),
                                     (i % 12 + 1).cast("int"), F.lit(1)), "yyyy-MM")


def safe_div(num: Column | str, den: Column | str) -> Column:
    """num / den as DOUBLE; NULL when den is 0 or NULL (never a divide-by-zero error)."""
    return _c(num).cast("double") / F.nullif(_c(den), F.lit(0)).cast("double")


def pct(num: Column | str, den: Column | str) -> Column:
    return safe_div(num, den) * 100


def flag_count(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END): 0 for no match, NULL over no rows."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def round_doubles(df: DataFrame, places: int = 4) -> DataFrame:
    """Round every DOUBLE column (used only for cross-engine comparison).

    The value first goes through DECIMAL(38,10): two engines that sum the
    same doubles in a different order differ in the last bits, which would
    otherwise decide a tie at the rounding digit differently.
    """
    def rounded(c: Column) -> Column:
        # NaN, infinities and magnitudes beyond DECIMAL(38,10) pass through unrounded
        exact = F.round(c.cast("decimal(38,10)"), places).cast("double")
        return F.when(F.isnan(c) | (F.abs(c) >= F.lit(1e27)), c).otherwise(exact)

    return df.select([
        rounded(df[f.name]).alias(f.name)
        if isinstance(f.dataType, T.DoubleType)
        else df[f.name]
        for f in df.schema.fields
    ])
