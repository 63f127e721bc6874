"""Declared schemas of the five raw input tables (no schema inference)."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B, _D = T.StringType(), T.IntegerType(), T.BooleanType(), T.DateType()
_TS, _F = T.TimestampNTZType(), T.DoubleType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


def money_type(exact_int: bool) -> T.DataType:
    """Money columns: DECIMAL(18,2) for real data, INT in the test fixtures."""
    return _I if exact_int else T.DecimalType(18, 2)


ACCOUNTS = _struct(
    ("account_id", _S), ("account_name", _S), ("industry", _S), ("country", _S),
    ("signup_date", _D), ("referral_source", _S), ("plan_tier", _S), ("seats", _I),
    ("is_trial", _B), ("churn_flag", _B),
)


def subscriptions(money: T.DataType = T.DecimalType(18, 2)) -> T.StructType:
    return _struct(
        ("subscription_id", _S), ("account_id", _S), ("start_date", _D), ("end_date", _D),
        ("plan_tier", _S), ("seats", _I), ("mrr_amount", money), ("arr_amount", money),
        ("is_trial", _B), ("upgrade_flag", _B), ("downgrade_flag", _B), ("churn_flag", _B),
        ("billing_frequency", _S), ("auto_renew_flag", _B),
    )


FEATURE_USAGE = _struct(
    ("usage_id", _S), ("subscription_id", _S), ("usage_date", _D), ("feature_name", _S),
    ("usage_count", _I), ("usage_duration_secs", _I), ("error_count", _I),
    ("is_beta_feature", _B),
)

SUPPORT_TICKETS = _struct(
    ("ticket_id", _S), ("account_id", _S), ("submitted_at", _TS), ("closed_at", _TS),
    ("resolution_time_hours", _F), ("priority", _S), ("first_response_time_minutes", _I),
    ("satisfaction_score", _I), ("escalation_flag", _B),
)


def churn_events(money: T.DataType = T.DecimalType(18, 2)) -> T.StructType:
    return _struct(
        ("churn_event_id", _S), ("account_id", _S), ("churn_date", _D), ("reason_code", _S),
        ("refund_amount_usd", money), ("preceding_upgrade_flag", _B),
        ("preceding_downgrade_flag", _B), ("is_reactivation", _B), ("feedback_text", _S),
    )


RAW_NAMES = ("accounts", "subscriptions", "feature_usage", "support_tickets", "churn_events")


def raw_schemas(exact_int_money: bool = False) -> dict[str, T.StructType]:
    money = money_type(exact_int_money)
    return {
        "accounts": ACCOUNTS,
        "subscriptions": subscriptions(money),
        "feature_usage": FEATURE_USAGE,
        "support_tickets": SUPPORT_TICKETS,
        "churn_events": churn_events(money),
    }


# Key column of every raw and star table (checked non-null and unique,
# except raw feature_usage whose usage_id repeats by design).
KEYS = {
    "accounts": "account_id",
    "subscriptions": "subscription_id",
    "support_tickets": "ticket_id",
    "churn_events": "churn_event_id",
    "dim_industry": "industry_id",
    "dim_plan_tier": "plan_tier_id",
    "dim_referral_source": "referral_source_id",
    "dim_reason_code": "reason_code_id",
    "dim_account": "account_id",
    "dim_date": "date_key",
    "fact_subscriptions": "subscription_id",
    "fact_feature_usage": "usage_id",
    "fact_support_tickets": "ticket_id",
    "fact_churn_events": "churn_event_id",
    "fact_account_summary": "account_id",
}

# Columns that must be unique besides the key: each lookup's names.
UNIQUE_NAMES = {
    "dim_industry": "industry_name",
    "dim_plan_tier": "plan_tier_name",
    "dim_referral_source": "referral_source_name",
    "dim_reason_code": "reason_code_name",
}


def checked_columns(table: str) -> list[str]:
    """Columns of a table that are checked to be non-null and unique."""
    return [c for c in (KEYS.get(table), UNIQUE_NAMES.get(table)) if c]
