"""Derive the five raw SaaS tables from the driver's TPC-H-style test tables.

The upstream CSV files are not available, so tests and benchmarks map
customer -> accounts, orders -> subscriptions and churn events,
lineitem -> feature usage and events -> support tickets. The mapping is
plain column arithmetic (one narrow projection per table, no shuffle);
the DuckDB oracle uses the same expressions as a CTE prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture value lists (test-data definition, not business rules).
REFERRAL_BY_MOD5 = ["organic", "ads", "event", "partner", "other"]
REASON_BY_MOD30 = {0: "features", 5: "support", 10: "budget", 15: "competitor",
                   20: "pricing", 25: "unknown"}
PLAN_BY_PRIORITY = {"1-URGENT": "Enterprise", "2-HIGH": "Pro", "3-MEDIUM": "Basic",
                    "5-LOW": "Starter"}
PRIORITY_BY_EVENT = {"purchase": "urgent", "error": "high", "click": "medium"}
TICKET_DAY_SHIFT = 9131
CALENDAR_ORIGIN = "1995-01-01"


def _id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _days(ts: Column, n: Column) -> Column:
    return ts + F.make_dt_interval(n.cast("int"))


def _map(c: Column, mapping: dict, default=None) -> Column:
    out = None
    for key, value in mapping.items():
        out = F.when(c == F.lit(key), F.lit(value)) if out is None else out.when(c == F.lit(key), F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def accounts(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    referral = _map(k % 5, dict(enumerate(REFERRAL_BY_MOD5)))
    return customer.select(
        _id("A-", k).alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.when(k % 50 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("industry"),
        _id("N", F.col("c_nationkey")).alias("country"),
        F.date_add(F.lit(CALENDAR_ORIGIN).cast("date"), ((k * 37) % 1500).cast("int")).alias("signup_date"),
        F.when(k % 40 == 7, F.lit(None).cast("string")).otherwise(referral).alias("referral_source"),
        F.when(F.col("c_acctbal") < 2000, "Basic").when(F.col("c_acctbal") < 6000, "Pro")
         .otherwise("Enterprise").alias("plan_tier"),
        (1 + k % 100).cast("int").alias("seats"),
        (k % 5 == 0).alias("is_trial"),
        (k % 9 < 2).alias("churn_flag"),
    )


def subscriptions(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    start = F.to_date("o_orderdate")
    status_f = F.col("o_orderstatus") == "F"
    ends = (status_f & (k % 3 == 0) & (k % 30 != 3)) | (k % 4 == 1)
    is_trial = (k % 6 == 0) | (F.col("o_custkey") % 25 == 0)
    mrr = F.when(is_trial, F.lit(0)).otherwise(
        (F.floor("o_totalprice").cast("int") % 2000)).cast("int")
    return orders.select(
        _id("S-", k).alias("subscription_id"),
        _id("A-", F.col("o_custkey")).alias("account_id"),
        start.alias("start_date"),
        F.when(ends, F.date_add(start, (30 + k % 400).cast("int"))).alias("end_date"),
        _map(F.col("o_orderpriority"), PLAN_BY_PRIORITY).alias("plan_tier"),
        (1 + k % 50).cast("int").alias("seats"),
        mrr.alias("mrr_amount"),
        (mrr * 12).cast("int").alias("arr_amount"),
        is_trial.alias("is_trial"),
        (k % 10 == 1).alias("upgrade_flag"),
        (k % 23 == 2).alias("downgrade_flag"),
        (status_f & (k % 3 == 0)).alias("churn_flag"),
        F.when(k % 2 == 0, "annual").otherwise("monthly").alias("billing_frequency"),
        (k % 5 != 0).alias("auto_renew_flag"),
    )


def feature_usage(lineitem: DataFrame) -> DataFrame:
    part = F.col("l_partkey")
    return lineitem.select(
        _id("U-", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("usage_id"),
        F.when(part % 97 == 0, F.lit("S-none")).otherwise(_id("S-", F.col("l_orderkey"))).alias("subscription_id"),
        F.to_date("l_shipdate").alias("usage_date"),
        _id("feature_", part % 40).alias("feature_name"),
        F.col("l_quantity").cast("int").alias("usage_count"),
        F.floor("l_extendedprice").cast("int").alias("usage_duration_secs"),
        (F.col("l_suppkey") % 4).cast("int").alias("error_count"),
        (part % 40 < 4).alias("is_beta_feature"),
    )


def support_tickets(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    ts = F.col("ts")
    return events.select(
        _id("T-", e).alias("ticket_id"),
        _id("A-", F.col("user_id") * 10 + e % 8).alias("account_id"),
        _days(ts, e % 700 - TICKET_DAY_SHIFT).alias("submitted_at"),
        F.when(e % 13 == 0, F.lit(None).cast("timestamp_ntz"))
         .otherwise(_days(ts, e % 700 + 1 + e % 5 - TICKET_DAY_SHIFT)).alias("closed_at"),
        F.col("value").alias("resolution_time_hours"),
        _map(F.col("event_type"), PRIORITY_BY_EVENT, "low").alias("priority"),
        F.floor(F.col("value") * 3).cast("int").alias("first_response_time_minutes"),
        F.when(e % 4 == 0, F.lit(None).cast("int"))
         .otherwise((1 + (e * 7 + F.col("user_id")) % 5).cast("int")).alias("satisfaction_score"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("escalation_flag"),
    )


def churn_events(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return (orders.where((F.col("o_orderstatus") == "F") & (k % 5 == 0))
            .select(
                _id("C-", k).alias("churn_event_id"),
                _id("A-", F.col("o_custkey")).alias("account_id"),
                F.date_add(F.to_date("o_orderdate"), (30 + k % 400).cast("int")).alias("churn_date"),
                F.when(k % 35 == 0, F.lit(None).cast("string"))
                 .otherwise(_map(k % 30, REASON_BY_MOD30)).alias("reason_code"),
                (F.floor("o_totalprice").cast("int") % 300).cast("int").alias("refund_amount_usd"),
                (k % 3 == 0).alias("preceding_upgrade_flag"),
                (k % 7 == 0).alias("preceding_downgrade_flag"),
                (k % 11 == 0).alias("is_reactivation"),
                F.when(k % 4 == 0, F.lit(None).cast("string"))
                 .otherwise(_id("note ", k % 9)).alias("feedback_text"),
            ))


def raw_from_testdata(spark: SparkSession, sf_dir: str):
    """The five raw tables derived from ``<sf_dir>/{customer,orders,lineitem,events}.parquet``."""
    from kpiforge.plans.star import RawTables

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

    orders = read("orders")
    return RawTables(
        accounts=accounts(read("customer")),
        subscriptions=subscriptions(orders),
        feature_usage=feature_usage(read("lineitem")),
        support_tickets=support_tickets(read("events")),
        churn_events=churn_events(orders),
    )
