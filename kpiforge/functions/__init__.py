"""Column expressions shared by the plans (all built-in, JVM-side)."""

from kpiforge.functions.columns import (
    flag_count, month_index, month_label, pct, round_doubles, safe_div, year_month,
)

__all__ = ["flag_count", "month_index", "month_label", "pct", "round_doubles", "safe_div",
           "year_month"]
