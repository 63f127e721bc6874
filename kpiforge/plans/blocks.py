"""Building blocks shared by several KPIs (each built once, reused)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge.functions.columns import year_month
from kpiforge.operators.intervals import monthly_active


def calendar_span(dim_date: DataFrame) -> DataFrame:
    """One row (cal_start, cal_end) of the date dimension."""
    return dim_date.agg(F.min("date_key").alias("cal_start"), F.max("date_key").alias("cal_end"))


def monthly_snapshot(subs: DataFrame, dim_date: DataFrame) -> DataFrame:
    """Per calendar month with an active subscription at its month end:
    year_month, active_mrr (SUM mrr_amount), active_accounts (distinct accounts)."""
    snap = monthly_active(subs.select("account_id", "start_date", "end_date", "mrr_amount"),
                          calendar_span(dim_date), value_col="mrr_amount",
                          distinct_col="account_id")
    return snap.select("year_month", F.col("active_value").alias("active_mrr"),
                       F.col("active_distinct").alias("active_accounts"))


def churned_subscriptions(subs: DataFrame) -> DataFrame:
    return subs.where(F.col("churn_flag") & F.col("end_date").isNotNull())


def churned_by_month(subs: DataFrame) -> DataFrame:
    """ym, churned_mrr, churned_accounts: churned subscriptions by end month
    (MRR sum, and distinct accounts)."""
    return (churned_subscriptions(subs).groupBy(year_month("end_date").alias("ym"))
            .agg(F.sum("mrr_amount").alias("churned_mrr"),
                 F.count_distinct("account_id").alias("churned_accounts")))


def mrr_movement(subs: DataFrame) -> DataFrame:
    """ym, new_mrr, expansion_mrr, contraction_mrr by start month.

    A subscription starting on its account's first start date is new; a
    later one counts as expansion if flagged upgrade and as contraction if
    flagged downgrade (both, or neither). Rows are first combined per
    (account, start date): the per-account window that finds the first
    start then sees at most one row per calendar day, however many
    subscriptions an account holds.
    """
    mrr = F.col("mrr_amount")
    per_day = subs.where(F.col("account_id").isNotNull()).groupBy("account_id", "start_date").agg(
        F.sum(mrr).alias("m_all"),
        F.sum(F.when(F.col("upgrade_flag"), mrr).otherwise(F.lit(0))).alias("m_up"),
        F.sum(F.when(F.col("downgrade_flag"), mrr).otherwise(F.lit(0))).alias("m_down"),
    )
    first = F.min("start_date").over(Window.partitionBy("account_id"))
    tagged = per_day.withColumn("first_start", first)
    is_first = F.col("start_date") == F.col("first_start")
    later = F.col("start_date") != F.col("first_start")
    return tagged.groupBy(year_month("start_date").alias("ym")).agg(
        F.sum(F.when(is_first, F.col("m_all")).otherwise(F.lit(0))).alias("new_mrr"),
        F.sum(F.when(later, F.col("m_up")).otherwise(F.lit(0))).alias("expansion_mrr"),
        F.sum(F.when(later, F.col("m_down")).otherwise(F.lit(0))).alias("contraction_mrr"),
    )


def latest_subscription(subs: DataFrame) -> DataFrame:
    """account_id, plan_tier_id of each account's latest subscription
    (start_date DESC, then subscription_id DESC for ties)."""
    from kpiforge.operators.dedupe import first_per_key

    latest = first_per_key(subs.select("account_id", "plan_tier_id", "start_date", "subscription_id"),
                           ["account_id"],
                           [F.col("start_date").desc_nulls_last(),
                            F.col("subscription_id").desc_nulls_last()])
    return latest.select("account_id", "plan_tier_id")


def usage_by_account_feature(usage: DataFrame) -> DataFrame:
    """Usage fact combined per (account, feature, beta flag): row count and sums.

    Three KPIs (top features, beta adoption, usage of churned vs retained
    accounts) read this instead of the row-level fact; their distinct
    account counts stay exact because the account is part of the key.
    """
    return usage.groupBy("account_id", "feature_name", "is_beta_feature").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("usage_count").alias("usage_count_sum"),
        F.sum("usage_duration_secs").alias("duration_sum"),
        F.sum("error_count").alias("error_sum"),
    )


# Blocks shared by several KPIs. The warehouse writes them once next to the
# star tables; a lazily built star schema computes them on demand.
BLOCKS = {
    "blk_monthly_snapshot": lambda star: monthly_snapshot(star["fact_subscriptions"],
                                                          star["dim_date"]),
    "blk_mrr_movement": lambda star: mrr_movement(star["fact_subscriptions"]),
    "blk_churned_by_month": lambda star: churned_by_month(star["fact_subscriptions"]),
    "blk_usage_by_account_feature": lambda star: usage_by_account_feature(
        star["fact_feature_usage"]),
}


def block(star, name: str) -> DataFrame:
    return star[name] if name in star else BLOCKS[name](star)
