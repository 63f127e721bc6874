"""Joins whose left side may hold a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 1 / 1000  # of the rows: at most 1000 keys can hold more than this
HEAVY_ROWS = 20_000  # rows of the right side that are sent to every task at most


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of all rows: fewer than 1 / share of them.

    Reads the key column alone; counts are combined map-side.
    """
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > total * F.lit(share)).select(key)


def heavy_rows(left: DataFrame, right: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """The rows of ``right`` whose key is hot in ``left``; to be written, then given to ``inner_join_split``."""
    return right.join(F.broadcast(heavy_keys(left, key, share)), key, "left_semi")


def inner_join_split(left: DataFrame, right: DataFrame, key: str, heavy: DataFrame,
                     spread: Sequence[str]) -> DataFrame:
    """``left`` inner join ``right`` on ``key`` in one pass over ``left``, hot keys split over all tasks.

    ``heavy`` holds the rows of ``right`` whose key is hot in ``left`` (written before).
    They are sent to the tasks, so that rows of ``left`` with a hot key find their match
    where they are. Such rows take part in the shuffle of the other keys under a key of
    their own, drawn from the columns ``spread``, and so are dealt evenly. If ``right``
    repeats hot keys beyond ``HEAVY_ROWS`` rows, nothing is sent and the plain join is
    left to AQE's splitting. All columns of both sides, the key once. Keys are compared
    as text, and a shuffled row holds its key once: as that text, or with its hot match.
    """
    more = [c for c in right.columns if c != key]
    if heavy.limit(HEAVY_ROWS + 1).count() > HEAVY_ROWS:
        return left.join(right, key)
    sent = F.broadcast(heavy.select(F.col(key).alias("__hot_key"), F.struct(key, *more).alias("__hot")))
    marked = left.where(F.col(key).isNotNull()).join(sent, F.col(key) == F.col("__hot_key"), "left")
    is_hot = F.col("__hot").isNotNull()
    marked = marked.select(
        *[c for c in left.columns if c != key], "__hot",
        F.when(is_hot, F.concat(F.lit("hot "), F.xxhash64(*spread).cast("string")))
         .otherwise(F.col(key).cast("string")).alias("__key"),
        F.when(is_hot, 1).otherwise(0).alias("__side"))
    cold = right.select(F.col(key).cast("string").alias("__key"), F.lit(0).alias("__side"),
                        F.struct(*more).alias("__cold"))
    both = marked.join(cold, ["__key", "__side"], "left").where("__hot IS NOT NULL OR __cold IS NOT NULL")
    same = F.coalesce(F.col("__hot")[key].cast("string"), "__key").cast(left.schema[key].dataType)
    return both.select(*[same.alias(c) if c == key else c for c in left.columns],
                       *[F.coalesce(F.col("__hot")[c], F.col("__cold")[c]).alias(c) for c in more])
