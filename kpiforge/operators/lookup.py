"""Lookup (code) tables with dense surrogate ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_names(names: DataFrame, name_col: str) -> DataFrame:
    """Distinct non-null names; ``names`` has one string column. Map-side combine."""
    src = names.columns[0]
    return names.where(F.col(src).isNotNull()).select(F.col(src).alias(name_col)).distinct()


def build_lookup(names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Distinct non-null names with ids 1..n in name order, as one plan that writes nothing.

    One ordered window numbers the distinct names, so they pass one task. The
    warehouse uses ``ordered_names`` and ``numbered`` instead, which do not.
    """
    return distinct_names(names, name_col).select(
        F.row_number().over(Window.orderBy(F.col(name_col).asc())).cast("int").alias(id_col),
        F.col(name_col),
    )


_IN_PART = (1 << 33) - 1  # monotonically_increasing_id: part number above 33 bits of place


def ordered_names(names: DataFrame, name_col: str) -> DataFrame:
    """Distinct names dealt out by range, with their part and their place in it.

    To be written before ``numbered`` reads it: the parts are then fixed.
    """
    ordered = distinct_names(names, name_col).repartitionByRange(F.col(name_col)).sortWithinPartitions(name_col)
    at = F.monotonically_increasing_id()
    return ordered.select(name_col, F.shiftright(at, 33).cast("int").alias("part"),
                          at.bitwiseAND(_IN_PART).alias("place"))


def numbered(ordered: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Ids 1..n in name order: place in the part plus the number of names in the parts before.

    The counts of the parts (one row per shuffle partition) are all that
    meets in one place; no window spans the names.
    """
    counts = {r.part: r.n for r in ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(counts):
        starts.append((part, total))
        total += counts[part]
    before = ordered.sparkSession.createDataFrame(starts, "part int, before long")
    return ordered.join(F.broadcast(before), "part").select(
        (F.col("before") + F.col("place") + 1).cast("int").alias(id_col), name_col)


def attach_id(df: DataFrame, lookup: DataFrame, name_col_df: str, id_col: str,
              name_col_lookup: str) -> DataFrame:
    """Left join a lookup on its name; unmatched and NULL names keep a NULL id.

    No broadcast hint: the lookup comes out of an aggregate, so AQE sees its
    real size and broadcasts it when it is under the threshold, else falls
    back to a sort-merge join (with skew splitting).
    """
    lk = lookup.select(F.col(name_col_lookup).alias("__lk_name"), F.col(id_col))
    return (df.join(lk, df[name_col_df] == lk["__lk_name"], "left").drop("__lk_name"))
