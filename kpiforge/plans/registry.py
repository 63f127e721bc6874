"""Registered result sets: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kpiforge.functions.columns import round_doubles
from kpiforge.plans.kpis import CHECKS, KPIS
from kpiforge.plans.star import STAR_TABLES
from kpiforge.plans.warehouse import star_for

# Star tables whose content is compared directly (the staged summary is internal).
BUILD_OUTPUTS = STAR_TABLES


def result(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A star table or a KPI/check over the materialized star schema of ``sf_dir``."""
    star = star_for(spark, sf_dir)
    if name in BUILD_OUTPUTS:
        return star[name]
    if name in KPIS:
        return KPIS[name](star)
    return CHECKS[name](star)


def names() -> list[str]:
    return list(BUILD_OUTPUTS) + list(CHECKS) + list(KPIS)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every result set, DOUBLE columns rounded to 4 places for cross-engine comparison."""
    def make(n: str):
        return lambda spark, sf_dir: round_doubles(result(spark, sf_dir, n))
    return {n: make(n) for n in names()}
