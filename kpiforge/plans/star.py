"""Star-schema build: lookups, dimensions, facts and the account summary.

Every builder is a pure DataFrame function; ``build_star`` wires them
lazily and ``kpiforge.plans.warehouse`` materializes them in dependency
order (each written table cuts lineage for the next step).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge import constants as K
from kpiforge.functions.columns import flag_count
from kpiforge.operators.calendar import bounds_from, date_dimension
from kpiforge.operators.checks import Measured
from kpiforge.operators.dedupe import first_per_key
from kpiforge.operators.lookup import attach_id, build_lookup
from kpiforge.operators.quantiles import percentile_cont, percentiles, union_all, value_counts
from kpiforge.operators.skew import heavy_rows, inner_join_split

LOOKUPS = ("dim_industry", "dim_plan_tier", "dim_referral_source", "dim_reason_code")
# Table order of the build report (row counts).
STAR_TABLES = ("dim_account", "dim_date", "dim_industry", "dim_plan_tier", "dim_referral_source",
               "dim_reason_code", "fact_subscriptions", "fact_feature_usage",
               "fact_support_tickets", "fact_churn_events", "fact_account_summary")


@dataclass
class RawTables:
    accounts: DataFrame
    subscriptions: DataFrame
    feature_usage: DataFrame
    support_tickets: DataFrame
    churn_events: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


class StarSchema(Mapping):
    """Name -> DataFrame for the star tables (lazy plans or materialized reads).

    ``measured`` has what was counted while tables were written, if they were.
    """

    def __init__(self, tables: Mapping[str, DataFrame], measured: Mapping[str, Measured] | None = None):
        self._t = dict(tables)
        self.measured = dict(measured or {})

    def __getitem__(self, name: str) -> DataFrame:
        return self._t[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._t)

    def __len__(self) -> int:
        return len(self._t)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["_t"][name]
        except KeyError:
            raise AttributeError(name) from None


# ---------------------------------------------------------------- lookups

# Lookup -> (raw tables that hold its names, their column).
LOOKUP_SOURCES = {
    "dim_industry": (("accounts",), "industry"),
    "dim_plan_tier": (("accounts", "subscriptions"), "plan_tier"),
    "dim_referral_source": (("accounts",), "referral_source"),
    "dim_reason_code": (("churn_events",), "reason_code"),
}


def lookup_columns(name: str) -> tuple[str, str]:
    """Id and name column of a lookup."""
    stem = name.removeprefix("dim_")
    return f"{stem}_id", f"{stem}_name"


def lookup_names(raw: RawTables, name: str) -> DataFrame:
    """One column with every occurrence of a lookup's names (also unknown and NULL ones)."""
    tables, column = LOOKUP_SOURCES[name]
    return union_all([getattr(raw, t).select(column) for t in tables])


def dim_lookup(raw: RawTables, name: str) -> DataFrame:
    return build_lookup(lookup_names(raw, name), *lookup_columns(name))


# ------------------------------------------------------------- dimensions

def dim_account(raw: RawTables, industry: DataFrame, referral: DataFrame,
                plan: DataFrame) -> DataFrame:
    acc = attach_id(raw.accounts, industry, "industry", "industry_id", "industry_name")
    acc = attach_id(acc, referral, "referral_source", "referral_source_id", "referral_source_name")
    acc = attach_id(acc, plan, "plan_tier", "plan_tier_id", "plan_tier_name")
    return acc.select(
        "account_id", "account_name", "industry_id", "country", "referral_source_id",
        F.col("plan_tier_id").alias("initial_plan_tier_id"),
        F.col("seats").alias("initial_seats"),
        "signup_date", "is_trial", "churn_flag",
    )


def calendar_bounds(raw: RawTables) -> DataFrame:
    """cal_start/cal_end over signups, subscriptions, tickets and churn dates.

    Usage dates are not considered; an open subscription counts with its
    start date; a ticket's end is its close date (open tickets add none).
    """
    return bounds_from([
        raw.accounts.agg(F.min("signup_date").alias("lo"), F.max("signup_date").alias("hi")),
        raw.subscriptions.agg(F.min("start_date").alias("lo"),
                              F.max(F.coalesce("end_date", "start_date")).alias("hi")),
        raw.support_tickets.agg(F.min(F.to_date("submitted_at")).alias("lo"),
                                F.max(F.to_date("closed_at")).alias("hi")),
        raw.churn_events.agg(F.min("churn_date").alias("lo"), F.max("churn_date").alias("hi")),
    ])


def dim_date(raw: RawTables) -> DataFrame:
    return date_dimension(calendar_bounds(raw))


# ------------------------------------------------------------------ facts

def fact_subscriptions(raw: RawTables, plan: DataFrame) -> DataFrame:
    subs = attach_id(raw.subscriptions, plan, "plan_tier", "plan_tier_id", "plan_tier_name")
    return subs.select(
        "subscription_id", "account_id", "plan_tier_id", "start_date", "end_date", "seats",
        "mrr_amount", "arr_amount", "is_trial", "upgrade_flag", "downgrade_flag", "churn_flag",
        "billing_frequency", "auto_renew_flag",
        F.when(F.col("end_date").isNotNull(), F.datediff("end_date", "start_date"))
         .alias("subscription_duration_days"),
    )


# Survivor order among rows sharing a usage_id (the source leaves it open).
USAGE_SURVIVOR_ORDER = ("usage_date", "feature_name", "usage_count", "usage_duration_secs",
                        "error_count", "subscription_id", "is_beta_feature")


def subscription_accounts(raw: RawTables) -> DataFrame:
    return raw.subscriptions.select("subscription_id", "account_id")


def hot_subscriptions(raw: RawTables) -> DataFrame:
    """(subscription_id, account_id) of subscriptions that hold over a thousandth of the usage rows."""
    return heavy_rows(raw.feature_usage, subscription_accounts(raw), "subscription_id")


def usage_with_account(raw: RawTables, hot: DataFrame | None = None) -> DataFrame:
    """Raw usage rows (duplicates included) with their account; rows without a subscription are dropped.

    The usage fact and the account summary both read it, so the warehouse writes
    it once. With ``hot`` (the written ``hot_subscriptions``) a subscription with a
    huge share of the rows is split over all tasks of the join.
    """
    accounts = subscription_accounts(raw)
    if hot is None:
        return raw.feature_usage.join(accounts, "subscription_id", "inner")
    return inner_join_split(raw.feature_usage, accounts, "subscription_id", hot,
                            ["usage_id", "usage_date", "feature_name", "usage_duration_secs"])


def fact_feature_usage(raw: RawTables, usage: DataFrame | None = None) -> DataFrame:
    """One row per usage_id of the usage rows that have a subscription."""
    joined = usage_with_account(raw) if usage is None else usage
    deduped = first_per_key(joined, ["usage_id"],
                            [F.col(c).asc_nulls_first() for c in USAGE_SURVIVOR_ORDER])
    return deduped.select("usage_id", "subscription_id", "account_id", "usage_date",
                          "feature_name", "usage_count", "usage_duration_secs", "error_count",
                          "is_beta_feature")


def fact_support_tickets(raw: RawTables) -> DataFrame:
    return raw.support_tickets.select(
        "ticket_id", "account_id", F.to_date("submitted_at").alias("ticket_date"),
        "submitted_at", "closed_at", "resolution_time_hours", "priority",
        "first_response_time_minutes", "satisfaction_score", "escalation_flag",
    )


def fact_churn_events(raw: RawTables, reason: DataFrame) -> DataFrame:
    ce = attach_id(raw.churn_events, reason, "reason_code", "reason_code_id", "reason_code_name")
    return ce.select(
        "churn_event_id", "account_id", "reason_code_id", "churn_date", "refund_amount_usd",
        "preceding_upgrade_flag", "preceding_downgrade_flag", "is_reactivation", "feedback_text",
    )


# ---------------------------------------------------------- account summary

def _subscription_agg(subs: DataFrame) -> DataFrame:
    return subs.groupBy("account_id").agg(
        F.sum("mrr_amount").alias("total_mrr"),
        F.sum("arr_amount").alias("total_arr"),
        F.max("seats").alias("max_seats"),
        F.max(F.when(F.col("upgrade_flag"), 1).otherwise(0)).alias("had_upgrade"),
        F.max(F.when(F.col("downgrade_flag"), 1).otherwise(0)).alias("had_downgrade"),
        F.count("subscription_id").alias("subscription_count"),
    )


def _ticket_agg(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("account_id").agg(
        F.count("ticket_id").alias("total_tickets"),
        F.avg("resolution_time_hours").alias("avg_resolution_hours"),
        F.avg(F.col("satisfaction_score").cast("double")).alias("avg_satisfaction"),
        flag_count(F.col("escalation_flag")).alias("total_escalations"),
    )


def _usage_agg(usage: DataFrame) -> DataFrame:
    """Per-account usage from the RAW usage rows (duplicates included).

    Combined per (account, feature) first, with map-side combine, so an account
    with a huge share of the rows is one row per feature and map task.
    """
    per_feature = usage.groupBy("account_id", "feature_name").agg(
        F.sum("usage_count").alias("n"),
        F.sum("usage_duration_secs").alias("secs"),
        F.sum("error_count").alias("errs"),
        flag_count(F.col("is_beta_feature")).alias("beta_rows"),
    )
    return per_feature.groupBy("account_id").agg(
        F.sum("n").alias("total_usage_events"),
        F.sum("secs").alias("total_duration_secs"),
        F.sum("errs").alias("total_errors"),
        F.count("feature_name").alias("distinct_features_used"),
        F.sum("beta_rows").alias("beta_features_used"),
    )


def _churn_agg(churn: DataFrame) -> DataFrame:
    """Per-account churn. Reasons are listed per day first, so that an account's list is
    put in order from one entry a day; the listed text itself grows with its events."""
    def listed(column: str, order: str) -> Column:
        return F.expr(f"listagg({column}, '{K.REASON_SEPARATOR}') WITHIN GROUP (ORDER BY {order} ASC NULLS FIRST)")

    daily = churn.groupBy("account_id", "churn_date").agg(
        listed("reason_code", "churn_event_id").alias("reasons"),
        F.sum("refund_amount_usd").alias("refunds"))
    return daily.groupBy("account_id").agg(
        F.min("churn_date").alias("first_churn_date"),
        listed("reasons", "churn_date").alias("churn_reasons"),
        F.sum("refunds").alias("total_refunds"),
    )


def _zero(c: str, like: str | None = None) -> Column:
    return F.coalesce(F.col(c), F.lit(0).cast(like) if like else F.lit(0))


def account_summary_base(raw: RawTables, usage: DataFrame | None = None) -> DataFrame:
    """One row per account, before risk tiers; ``usage`` is the written ``usage_with_account``.

    Four per-account aggregates (each a partial + final aggregate keyed by
    account_id) are left-joined to the accounts and share their partitioning
    by account_id; usage and churn are combined on finer keys before.
    """
    acc = raw.accounts
    s = _subscription_agg(raw.subscriptions)
    t = _ticket_agg(raw.support_tickets)
    u = _usage_agg(usage_with_account(raw) if usage is None else usage)
    c = _churn_agg(raw.churn_events)
    j = acc.join(s, "account_id", "left").join(t, "account_id", "left") \
           .join(u, "account_id", "left").join(c, "account_id", "left")
    return j.select(
        "account_id", "account_name", "industry", "country", "referral_source",
        F.col("plan_tier").alias("initial_plan_tier"),
        F.col("seats").alias("initial_seats"),
        "signup_date", "churn_flag",
        _zero("total_mrr", "bigint").alias("total_mrr"),
        _zero("total_arr", "bigint").alias("total_arr"),
        F.coalesce("max_seats", "seats").alias("max_seats"),
        _zero("had_upgrade").alias("had_upgrade"),
        _zero("had_downgrade").alias("had_downgrade"),
        _zero("subscription_count", "bigint").alias("subscription_count"),
        _zero("total_tickets", "bigint").alias("total_tickets"),
        F.coalesce("avg_resolution_hours", F.lit(0.0)).alias("avg_resolution_hours"),
        "avg_satisfaction",
        _zero("total_escalations", "bigint").alias("total_escalations"),
        _zero("total_usage_events", "bigint").alias("total_usage_events"),
        _zero("total_duration_secs", "bigint").alias("total_duration_secs"),
        _zero("total_errors", "bigint").alias("total_errors"),
        _zero("distinct_features_used", "bigint").alias("distinct_features_used"),
        _zero("beta_features_used", "bigint").alias("beta_features_used"),
        "first_churn_date", "churn_reasons",
        _zero("total_refunds", "bigint").alias("total_refunds"),
    )


# Result column -> (measure, percentile).
THRESHOLDS = {"satisfaction_p10": ("avg_satisfaction", K.SATISFACTION_LOW_PCT),
              "satisfaction_p50": ("avg_satisfaction", K.SATISFACTION_MID_PCT),
              "escalations_p90": ("total_escalations", K.ESCALATION_HIGH_PCT)}


def risk_thresholds(summary: DataFrame) -> DataFrame:
    """One row: satisfaction p10 and p50 (accounts with a score) and escalation p90 (all).

    As one aggregate over a summary that is not written; the warehouse selects by
    rank over written value counts instead (``threshold_counts``, ``thresholds_of``).
    """
    return summary.agg(*[percentile_cont(F.col(c).cast("double"), p).alias(a) for a, (c, p) in THRESHOLDS.items()])


def threshold_counts(summary: DataFrame) -> DataFrame:
    """Value counts of the measures behind the thresholds."""
    return value_counts(summary, {c: F.col(c) for c, _ in THRESHOLDS.values()})


def thresholds_of(bucketed: DataFrame) -> DataFrame:
    """The thresholds from the written, bucketed value counts."""
    return percentiles(bucketed, [(a, c, p) for a, (c, p) in THRESHOLDS.items()])


def with_risk_tier(summary: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds business_risk_tier from the one-row thresholds (a scalar subquery, no join).

    An account without a score counts as NO_SCORE_DEFAULT; an escalation
    p90 of 0 makes every account High Risk (the rule is kept as written).
    """
    th = thresholds.select(F.struct("satisfaction_p10", "satisfaction_p50",
                                    "escalations_p90").alias("t")).scalar()
    sat = F.coalesce(F.col("avg_satisfaction"), F.lit(K.NO_SCORE_DEFAULT))
    tier = (F.when((sat <= th["satisfaction_p10"]) |
                   (F.col("total_escalations") >= th["escalations_p90"]), F.lit(K.TIER_HIGH))
             .when(sat <= th["satisfaction_p50"], F.lit(K.TIER_MEDIUM))
             .otherwise(F.lit(K.TIER_LOW)))
    return summary.withColumn("business_risk_tier", tier)


# ------------------------------------------------------------------ wiring

def build_star(raw: RawTables) -> StarSchema:
    """All star tables as lazy plans over the raw tables."""
    lk = {name: dim_lookup(raw, name) for name in LOOKUPS}
    base = account_summary_base(raw)
    tables = dict(lk)
    tables.update({
        "dim_account": dim_account(raw, lk["dim_industry"], lk["dim_referral_source"],
                                   lk["dim_plan_tier"]),
        "dim_date": dim_date(raw),
        "fact_subscriptions": fact_subscriptions(raw, lk["dim_plan_tier"]),
        "fact_feature_usage": fact_feature_usage(raw),
        "fact_support_tickets": fact_support_tickets(raw),
        "fact_churn_events": fact_churn_events(raw, lk["dim_reason_code"]),
        "fact_account_summary": with_risk_tier(base, risk_thresholds(base)),
    })
    return StarSchema(tables)
