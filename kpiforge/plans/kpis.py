"""The KPI result sets, each a function of the star schema.

Grains and quirks of the source workload are kept on purpose (documented
per function): totals over all subscriptions ever, month-end snapshots,
fan-out of MRR per churn event, and so on. Where the plan differs from the
literal SQL shape (pre-aggregation before joins, interval arithmetic
instead of a range join), the result is the same by construction and the
DuckDB oracle runs the literal shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiforge import constants as K
from kpiforge.functions.columns import flag_count, pct, safe_div, year_month
from kpiforge.operators.checks import key_checks, row_counts
from kpiforge.plans import blocks as B
from kpiforge.plans.star import STAR_TABLES, StarSchema, risk_thresholds as _thresholds
from kpiforge.schemas import checked_columns


def _churned_col():
    return F.col("churn_flag")


def _by_name(agg: DataFrame, lookup: DataFrame, id_col: str, name_col: str,
             sums: list[str]) -> DataFrame:
    """Map per-id partial results to lookup names and re-add per name.

    The fact is aggregated per id first (map-side combine), so only one row
    per id meets the lookup; unknown and NULL ids land in the NULL-name group.
    """
    named = agg.join(lookup.select(id_col, name_col), id_col, "left")
    return named.groupBy(name_col).agg(*[F.sum(c).alias(c) for c in sums])


# ------------------------------------------------------------ build outputs

def risk_thresholds(star: StarSchema) -> DataFrame:
    """The thresholds the tiers were set by (written with the star), or from a summary that is not written."""
    return star["risk_thresholds"] if "risk_thresholds" in star else _thresholds(star["fact_account_summary"])


def table_row_counts(star: StarSchema) -> DataFrame:
    tables = {n: star[n] for n in STAR_TABLES}
    return row_counts(tables, list(STAR_TABLES), star.measured)


def star_key_checks(star: StarSchema) -> DataFrame:
    """Keys of every star table, and the names of the lookups: non-null and unique."""
    tables = {n: star[n] for n in STAR_TABLES}
    return key_checks(tables, [(n, c) for n in STAR_TABLES for c in checked_columns(n)], star.measured)


# -------------------------------------------------------- summary-level KPIs

def kpi_executive_overview(star: StarSchema) -> DataFrame:
    """Accounts, churn, MRR over all subscriptions ever, ARR estimate (MRR x 12), ARPA."""
    s = star["fact_account_summary"]
    total = F.count(F.lit(1))
    churned = flag_count(_churned_col())
    mrr = F.sum("total_mrr")
    return s.agg(
        total.alias("total_accounts"),
        churned.alias("churned_accounts"),
        pct(churned, total).alias("customer_churn_rate_pct"),
        mrr.alias("total_mrr_all"),
        (mrr * K.MONTHS_PER_YEAR).alias("total_arr_estimate"),
        F.sum(F.when(_churned_col(), F.col("total_mrr")).otherwise(F.lit(0))).alias("mrr_lost_to_churn"),
        safe_div(mrr, total).alias("arpa"),
    )


def _segment(star: StarSchema, lookup: str, key: str, name: str, with_avg: bool) -> DataFrame:
    """Summary by the segment that the account dimension gives, named by the lookup.

    Rows are combined by segment id first, so the lookup joins a small result.
    """
    s = star["fact_account_summary"].join(star["dim_account"].select("account_id", key), "account_id")
    total = F.count(F.lit(1))
    churned = flag_count(_churned_col())
    aggs = [total.alias("account_count"), F.sum("total_mrr").alias("total_mrr")]
    if with_avg:
        aggs.append(safe_div(F.sum("total_mrr"), F.count("total_mrr")).alias("avg_mrr_per_account"))
    aggs += [churned.alias("churned_count"), pct(churned, total).alias("churn_rate_pct")]
    segments = s.groupBy(key).agg(*aggs).join(star[lookup], key)
    return segments.select(name, *[c for c in segments.columns if c not in (key, name)])


def kpi_by_industry(star: StarSchema) -> DataFrame:
    return _segment(star, "dim_industry", "industry_id", "industry_name", True).orderBy(F.col("total_mrr").desc())


def kpi_by_referral_source(star: StarSchema) -> DataFrame:
    return (_segment(star, "dim_referral_source", "referral_source_id", "referral_source_name", False)
            .orderBy(F.col("churn_rate_pct").asc()))


def kpi_risk_tier_distribution(star: StarSchema) -> DataFrame:
    s = star["fact_account_summary"]
    return (s.groupBy("business_risk_tier").agg(
        F.count(F.lit(1)).alias("account_count"),
        F.sum("total_mrr").alias("mrr_in_tier"),
        F.avg("avg_satisfaction").alias("avg_satisfaction_in_tier"),
        flag_count(_churned_col()).alias("actually_churned"),
    ).orderBy(F.col("mrr_in_tier").desc()))


def kpi_signup_cohort_retention(star: StarSchema) -> DataFrame:
    s = star["fact_account_summary"]
    total = F.count("account_id")
    kept = flag_count(~_churned_col())
    return (s.groupBy(year_month("signup_date").alias("signup_cohort")).agg(
        total.alias("total_cohort_accounts"),
        kept.alias("active_retained_accounts"),
        pct(kept, total).alias("retention_rate_pct"),
    ).orderBy("signup_cohort"))


def kpi_mrr_at_risk(star: StarSchema) -> DataFrame:
    """Active (not churned) accounts by risk tier."""
    s = star["fact_account_summary"].where(~_churned_col())
    return (s.groupBy("business_risk_tier").agg(
        F.count("account_id").alias("accounts_count"),
        F.sum("total_mrr").alias("total_mrr_at_risk"),
        F.avg("avg_satisfaction").alias("avg_satisfaction"),
    ).orderBy(F.col("total_mrr_at_risk").desc()))


# ----------------------------------------------------------- fact-level KPIs

def kpi_top_features(star: StarSchema) -> DataFrame:
    u = B.block(star, "blk_usage_by_account_feature")
    return (u.groupBy("feature_name").agg(
        F.sum("events").alias("usage_events"),
        F.sum("usage_count_sum").alias("total_usage_count"),
        F.sum("duration_sum").alias("total_duration_secs"),
        F.sum("error_sum").alias("total_errors"),
        F.count_distinct("account_id").alias("distinct_accounts_using"),
    ).orderBy(F.col("usage_events").desc(), F.col("feature_name").asc_nulls_first())
     .limit(K.TOP_FEATURES))


def kpi_beta_adoption(star: StarSchema) -> DataFrame:
    u = B.block(star, "blk_usage_by_account_feature")
    return u.groupBy("is_beta_feature").agg(
        F.sum("events").alias("usage_events"),
        F.count_distinct("account_id").alias("distinct_accounts"),
        F.sum("error_sum").alias("total_errors"),
    )


def kpi_support_by_priority(star: StarSchema) -> DataFrame:
    t = star["fact_support_tickets"]
    rank = None
    for i, p in enumerate(K.PRIORITY_ORDER, start=1):
        rank = F.when(F.col("priority") == p, i) if rank is None else rank.when(F.col("priority") == p, i)
    return (t.groupBy("priority").agg(
        F.count(F.lit(1)).alias("ticket_count"),
        F.avg("resolution_time_hours").alias("avg_resolution_hours"),
        F.avg(F.col("satisfaction_score").cast("double")).alias("avg_satisfaction"),
        flag_count(F.col("escalation_flag")).alias("escalations"),
        F.avg("first_response_time_minutes").alias("avg_first_response_min"),
    ).orderBy(rank.asc_nulls_first()))


def kpi_churn_reasons(star: StarSchema) -> DataFrame:
    """Per reason: churn events, and the churned account's total MRR once per event
    (an account with n events counts n times; reactivations included)."""
    ce = star["fact_churn_events"]
    s = star["fact_account_summary"].select("account_id", "total_mrr")
    per_account = ce.groupBy("account_id", "reason_code_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("refund_amount_usd").alias("refunds"))
    joined = per_account.join(s, "account_id", "inner")
    per_id = joined.groupBy("reason_code_id").agg(
        F.sum("n").alias("churn_count"),
        F.sum(F.col("n") * F.col("total_mrr")).alias("mrr_lost"),
        F.sum("refunds").alias("total_refunds"),
    )
    named = _by_name(per_id, star["dim_reason_code"], "reason_code_id", "reason_code_name",
                     ["churn_count", "mrr_lost", "total_refunds"])
    return named.select(
        "reason_code_name", "churn_count", "mrr_lost",
        safe_div("mrr_lost", "churn_count").alias("avg_mrr_per_churned_account"),
        "total_refunds",
    ).orderBy(F.col("mrr_lost").desc())


def kpi_pre_churn_plan_moves(star: StarSchema) -> DataFrame:
    ce = star["fact_churn_events"]
    return (ce.groupBy("preceding_upgrade_flag", "preceding_downgrade_flag")
            .agg(F.count(F.lit(1)).alias("churn_count"))
            .orderBy(F.col("churn_count").desc()))


def kpi_plan_tier_funnel(star: StarSchema) -> DataFrame:
    fs = star["fact_subscriptions"]
    per_id = fs.groupBy("plan_tier_id").agg(
        F.count(F.lit(1)).alias("subscription_count"),
        flag_count(F.col("upgrade_flag")).alias("upgrades"),
        flag_count(F.col("downgrade_flag")).alias("downgrades"),
        flag_count(F.col("churn_flag")).alias("churned"),
        F.sum("mrr_amount").alias("mrr_sum"),
        F.count("mrr_amount").alias("mrr_n"),
    )
    named = _by_name(per_id, star["dim_plan_tier"], "plan_tier_id", "plan_tier_name",
                     ["subscription_count", "upgrades", "downgrades", "churned", "mrr_sum", "mrr_n"])
    return named.select(
        "plan_tier_name", "subscription_count", "upgrades", "downgrades", "churned",
        safe_div("mrr_sum", "mrr_n").alias("avg_mrr"),
    ).orderBy(F.col("avg_mrr").desc())


def kpi_usage_churned_vs_retained(star: StarSchema) -> DataFrame:
    """Per churn flag: accounts, mean usage rows and errors among accounts with usage,
    and errors per usage row (+1 in the denominator). The means are true means
    (DOUBLE), where the source's integer average truncates."""
    u = B.block(star, "blk_usage_by_account_feature").groupBy("account_id").agg(
        F.sum("events").alias("total_usage_events"), F.sum("error_sum").alias("total_errors"))
    f = star["fact_account_summary"].select("account_id", "churn_flag")
    j = f.join(u, "account_id", "left")
    return j.groupBy("churn_flag").agg(
        F.count("account_id").alias("total_accounts"),  # the summary's key, checked unique
        F.avg("total_usage_events").alias("avg_usage_events"),
        F.avg("total_errors").alias("avg_errors"),
        (F.sum("total_errors").cast("double") /
         (F.sum("total_usage_events") + 1).cast("double")).alias("error_rate_per_event"),
    )


def kpi_support_vs_churn(star: StarSchema) -> DataFrame:
    """Ticket-weighted support means per churn flag (tickets combined per account first)."""
    t = star["fact_support_tickets"].groupBy("account_id").agg(
        F.sum("resolution_time_hours").alias("res_sum"),
        F.count("resolution_time_hours").alias("res_n"),
        F.sum(F.col("satisfaction_score").cast("double")).alias("sat_sum"),
        F.count("satisfaction_score").alias("sat_n"),
        flag_count(F.col("escalation_flag")).alias("esc"),
    )
    f = star["fact_account_summary"].select("account_id", "churn_flag")
    j = f.join(t, "account_id", "inner")
    return j.groupBy("churn_flag").agg(
        safe_div(F.sum("res_sum"), F.sum("res_n")).alias("avg_resolution_hours"),
        safe_div(F.sum("sat_sum"), F.sum("sat_n")).alias("avg_satisfaction"),
        F.sum("esc").alias("total_escalations"),
    )


# --------------------------------------------------------- time and revenue

def kpi_monthly_mrr_growth(star: StarSchema) -> DataFrame:
    """Month-end active MRR and accounts, ARR snapshot and month-over-month growth.
    Months without an active subscription are absent, so LAG skips them."""
    snap = B.block(star, "blk_monthly_snapshot")
    w = Window.orderBy("year_month")  # one row per month: a single small partition
    prev = F.lag("active_mrr").over(w)
    return snap.select(
        "year_month", "active_accounts", "active_mrr",
        (F.col("active_mrr") * K.MONTHS_PER_YEAR).alias("arr_snapshot"),
        prev.alias("prev_month_mrr"),
        (F.col("active_mrr") - prev).alias("net_new_mrr"),
        pct(F.col("active_mrr") - prev, prev).alias("mrr_growth_rate_pct"),
    ).orderBy("year_month")


def kpi_mrr_movement(star: StarSchema) -> DataFrame:
    m = B.block(star, "blk_mrr_movement")
    return m.select(F.col("ym").alias("movement_month"), "new_mrr", "expansion_mrr",
                    "contraction_mrr").orderBy("movement_month")


def kpi_gross_revenue_retention(star: StarSchema) -> DataFrame:
    """Month-end active MRR (named starting_mrr, as in the source) against MRR of
    churned subscriptions ending that month."""
    snap = B.block(star, "blk_monthly_snapshot")
    churn = B.block(star, "blk_churned_by_month").select("ym", "churned_mrr")
    j = snap.join(churn, snap["year_month"] == churn["ym"], "left")
    churned = F.coalesce(F.col("churned_mrr"), F.lit(0).cast("bigint"))
    return j.select(
        "year_month", F.col("active_mrr").alias("starting_mrr"), churned.alias("churned_mrr"),
        ((1 - safe_div(churned, F.col("active_mrr"))) * 100).alias("gross_revenue_retention_pct"),
    ).orderBy("year_month")


def kpi_ltv_formula(star: StarSchema) -> DataFrame:
    """ARPA of active accounts / mean monthly account churn rate."""
    s = star["fact_account_summary"].where(~_churned_col())
    arpa = s.agg(safe_div(F.sum("total_mrr"), F.count(F.lit(1))).alias("arpa"))
    snap = B.block(star, "blk_monthly_snapshot")
    churned = B.block(star, "blk_churned_by_month").select("ym", "churned_accounts")
    j = snap.join(churned, snap["year_month"] == churned["ym"], "left")
    rate = j.agg(F.avg(safe_div(F.coalesce("churned_accounts", F.lit(0)), "active_accounts"))
                 .alias("correct_monthly_churn_rate"))
    r = rate.select("correct_monthly_churn_rate").scalar()  # one-row scalar subquery
    return arpa.select("arpa", r.alias("correct_monthly_churn_rate"),
                       (F.col("arpa") / F.nullif(r, F.lit(0.0))).alias("ltv_formula_based"))


def kpi_ltv_empirical(star: StarSchema) -> DataFrame:
    """Mean realized revenue of churned subscriptions per account
    (mrr x days / 30; a churned subscription without end date counts 0 days)."""
    fs = star["fact_subscriptions"].where(F.col("churn_flag"))
    days = F.coalesce(F.col("subscription_duration_days"), F.lit(0)).cast("double")
    per_account = fs.groupBy("account_id").agg(
        F.sum(F.col("mrr_amount") * (days / K.DAYS_PER_MONTH)).alias("realized_revenue"))
    return per_account.agg(F.avg("realized_revenue").alias("ltv_empirical_churned_accounts"))


def kpi_trial_conversion(star: StarSchema) -> DataFrame:
    """Accounts with any trial subscription, and how many of them also have a
    paid one (in any order)."""
    fs = star["fact_subscriptions"]
    per_account = fs.groupBy("account_id").agg(
        F.bool_or(F.col("is_trial")).alias("trialed"),
        F.bool_or(~F.col("is_trial")).alias("paid"))
    trialed = F.count_if(F.col("trialed"))
    converted = F.count_if(F.col("trialed") & F.col("paid") & F.col("account_id").isNotNull())
    return per_account.agg(
        trialed.alias("total_ever_trialed"),
        converted.alias("converted_to_paid"),
        pct(converted, trialed).alias("trial_to_paid_conversion_pct"),
    )


def kpi_quick_ratio(star: StarSchema) -> DataFrame:
    """(new + expansion) / (churned + contraction) for months with a subscription start."""
    m = B.block(star, "blk_mrr_movement")
    c = B.block(star, "blk_churned_by_month").select(F.col("ym").alias("c_ym"), "churned_mrr")
    j = m.join(c, m["ym"] == c["c_ym"], "left")
    churned = F.coalesce(F.col("churned_mrr"), F.lit(0).cast("bigint"))
    return j.select(
        "ym", "new_mrr", "expansion_mrr", "contraction_mrr", churned.alias("churned_mrr"),
        safe_div(F.col("new_mrr") + F.col("expansion_mrr"),
                 churned + F.col("contraction_mrr")).alias("quick_ratio"),
    ).orderBy("ym")


def kpi_arpa_by_current_plan(star: StarSchema) -> DataFrame:
    """Accounts by the plan of their latest subscription, with total MRR and ARPA."""
    latest = B.latest_subscription(star["fact_subscriptions"])
    s = star["fact_account_summary"].select("account_id", "total_mrr")
    per_id = s.join(latest, "account_id", "inner").groupBy("plan_tier_id").agg(
        F.count_distinct("account_id").alias("accounts"), F.sum("total_mrr").alias("total_mrr"))
    named = _by_name(per_id, star["dim_plan_tier"], "plan_tier_id", "plan_tier_name",
                     ["accounts", "total_mrr"])
    return named.select("plan_tier_name", "accounts", "total_mrr",
                        safe_div("total_mrr", "accounts").alias("arpa")
                        ).orderBy(F.col("arpa").desc())


KPIS = {
    "kpi_executive_overview": kpi_executive_overview,
    "kpi_by_industry": kpi_by_industry,
    "kpi_by_referral_source": kpi_by_referral_source,
    "kpi_top_features": kpi_top_features,
    "kpi_beta_adoption": kpi_beta_adoption,
    "kpi_support_by_priority": kpi_support_by_priority,
    "kpi_churn_reasons": kpi_churn_reasons,
    "kpi_pre_churn_plan_moves": kpi_pre_churn_plan_moves,
    "kpi_risk_tier_distribution": kpi_risk_tier_distribution,
    "kpi_monthly_mrr_growth": kpi_monthly_mrr_growth,
    "kpi_plan_tier_funnel": kpi_plan_tier_funnel,
    "kpi_signup_cohort_retention": kpi_signup_cohort_retention,
    "kpi_usage_churned_vs_retained": kpi_usage_churned_vs_retained,
    "kpi_support_vs_churn": kpi_support_vs_churn,
    "kpi_mrr_at_risk": kpi_mrr_at_risk,
    "kpi_mrr_movement": kpi_mrr_movement,
    "kpi_gross_revenue_retention": kpi_gross_revenue_retention,
    "kpi_ltv_formula": kpi_ltv_formula,
    "kpi_ltv_empirical": kpi_ltv_empirical,
    "kpi_trial_conversion": kpi_trial_conversion,
    "kpi_quick_ratio": kpi_quick_ratio,
    "kpi_arpa_by_current_plan": kpi_arpa_by_current_plan,
}

CHECKS = {
    "risk_thresholds": risk_thresholds,
    "table_row_counts": table_row_counts,
    "key_checks": star_key_checks,
}
