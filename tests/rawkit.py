"""Test-data folders, and hand-written raw tables for micro fixtures (defaults fill unset columns)."""

from __future__ import annotations

import datetime as dt

from kpiforge.plans.star import RawTables
from kpiforge.schemas import raw_schemas

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"

D = dt.date


def _defaults(table: str, i: int) -> dict:
    return {
        "accounts": dict(account_id=f"A{i}", account_name=f"acct {i}", industry="Tech", country="N1",
                         signup_date=D(2023, 1, 1), referral_source="ads", plan_tier="Pro", seats=5,
                         is_trial=False, churn_flag=False),
        "subscriptions": dict(subscription_id=f"S{i}", account_id="A1", start_date=D(2023, 1, 1),
                              end_date=None, plan_tier="Pro", seats=5, mrr_amount=100,
                              arr_amount=1200, is_trial=False, upgrade_flag=False,
                              downgrade_flag=False, churn_flag=False, billing_frequency="monthly",
                              auto_renew_flag=True),
        "feature_usage": dict(usage_id=f"U{i}", subscription_id="S1", usage_date=D(2023, 2, 1),
                              feature_name="f1", usage_count=1, usage_duration_secs=10,
                              error_count=0, is_beta_feature=False),
        "support_tickets": dict(ticket_id=f"T{i}", account_id="A1",
                                submitted_at=dt.datetime(2023, 1, 5, 10), closed_at=None,
                                resolution_time_hours=1.0, priority="low",
                                first_response_time_minutes=5, satisfaction_score=None,
                                escalation_flag=False),
        "churn_events": dict(churn_event_id=f"C{i}", account_id="A1", churn_date=D(2023, 6, 1),
                             reason_code="budget", refund_amount_usd=0,
                             preceding_upgrade_flag=False, preceding_downgrade_flag=False,
                             is_reactivation=False, feedback_text=None),
    }[table]


def make_raw(spark, **tables) -> RawTables:
    schemas = raw_schemas(exact_int_money=True)
    frames = {}
    for name, schema in schemas.items():
        rows = []
        for i, r in enumerate(tables.get(name, []), start=1):
            row = _defaults(name, i)
            row.update(r)
            rows.append(tuple(row[f.name] for f in schema.fields))
        frames[name] = spark.createDataFrame(rows, schema)
    return RawTables(**frames)


def rows(df, *cols):
    df = df.select(*cols) if cols else df
    return [tuple(r) for r in df.collect()]
