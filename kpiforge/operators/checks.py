"""Data-quality checks: key integrity and table row counts.

Row and non-null counts can be measured while a table is written (``measure``);
the checks then need no pass for them, and only the distinct counts read the
tables. Without such figures the checks count everything themselves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kpiforge.operators.quantiles import union_all


@dataclass(frozen=True)
class Measured:
    """Rows of a written table, and non-null values of its key columns."""

    rows: int
    non_null: Mapping[str, int]


def measure(df: DataFrame, columns: Sequence[str], write) -> Measured:
    """Run ``write(df)`` and count its rows and the non-null values of ``columns`` on the way.

    The counts come from the tasks that write (Spark's ``Observation``), not
    from another pass.
    """
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"),
                     *[F.count(F.col(c)).alias(f"non_null_{i}") for i, c in enumerate(columns)]))
    got = seen.get
    return Measured(got["rows"], {c: got[f"non_null_{i}"] for i, c in enumerate(columns)})


def key_checks(tables: Mapping[str, DataFrame], keys: Sequence[tuple[str, str]],
               measured: Mapping[str, Measured] | None = None) -> DataFrame:
    """One row per (table, key column): rows, non-null keys, distinct keys, and pass flags.

    The distinct count is a partial/final aggregate on the key, so no key set
    is ever gathered in one task.
    """
    parts = []
    for name, key in keys:
        df, known = tables[name], (measured or {}).get(name)
        distinct = F.count_distinct(F.col(key)).alias("distinct_keys")
        if known is None or key not in known.non_null:
            part = df.agg(F.count(F.lit(1)).alias("row_count"), F.count(F.col(key)).alias("non_null_keys"), distinct)
        else:
            part = df.agg(distinct).select(F.lit(known.rows).cast("bigint").alias("row_count"),
                                           F.lit(known.non_null[key]).cast("bigint").alias("non_null_keys"),
                                           "distinct_keys")
        parts.append(part.select(F.lit(name).alias("table_name"), F.lit(key).alias("key_column"), "*"))
    return union_all(parts).select(
        "table_name", "key_column", "row_count", "non_null_keys", "distinct_keys",
        (F.col("non_null_keys") == F.col("row_count")).alias("key_not_null"),
        (F.col("distinct_keys") == F.col("non_null_keys")).alias("key_unique"),
    )


def row_counts(tables: Mapping[str, DataFrame], order: Sequence[str],
               measured: Mapping[str, Measured] | None = None) -> DataFrame:
    """One (table_name, row_count) per table, in the given order."""
    known = measured or {}
    if all(n in known for n in order):
        spark = tables[order[0]].sparkSession
        return spark.createDataFrame([(n, known[n].rows) for n in order], "table_name string, row_count long")
    return union_all([tables[n].agg(F.count(F.lit(1)).alias("row_count"))
                      .select(F.lit(n).alias("table_name"), "row_count") for n in order])
