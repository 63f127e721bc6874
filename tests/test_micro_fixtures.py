"""Hand-written fixtures, one per semantic trap of the source workload."""

import pytest

from kpiforge.plans import kpis as Q
from kpiforge.plans.star import build_star
from rawkit import D, make_raw, rows


def star_of(spark, **tables):
    return build_star(make_raw(spark, **tables))


def test_dup_usage_survivor_and_raw_summary(spark):
    usage = [
        dict(usage_id="U1", usage_count=5), dict(usage_id="U1", usage_count=3),
        dict(usage_id="U1", usage_count=7),
        dict(usage_id="U2", usage_count=2), dict(usage_id="U2", usage_count=2),
    ]
    st = star_of(spark, accounts=[dict(account_id="A1")], subscriptions=[dict(subscription_id="S1")],
                 feature_usage=usage)
    fact = sorted(rows(st["fact_feature_usage"], "usage_id", "usage_count", "account_id"))
    assert fact == [("U1", 3, "A1"), ("U2", 2, "A1")]
    # The summary reads the raw rows: duplicates included.
    assert rows(st["fact_account_summary"], "total_usage_events") == [(19,)]


def test_orphan_usage_dropped(spark):
    st = star_of(spark, accounts=[dict(account_id="A1")], subscriptions=[dict(subscription_id="S1")],
                 feature_usage=[dict(usage_id="U1"), dict(usage_id="U2", subscription_id="S-x")])
    assert rows(st["fact_feature_usage"], "usage_id") == [("U1",)]
    assert rows(st["fact_account_summary"], "total_usage_events") == [(1,)]


def test_no_scores_gives_null_thresholds(spark):
    accts = [dict(account_id=f"A{i}") for i in range(10)]
    esc = [dict(account_id="A8", escalation_flag=True)] + \
          [dict(account_id="A9", escalation_flag=True) for _ in range(5)]
    st = star_of(spark, accounts=accts, support_tickets=esc)
    th = rows(Q.risk_thresholds(st))[0]
    assert th[0] is None and th[1] is None and th[2] == pytest.approx(1.4)
    tiers = dict(rows(st["fact_account_summary"], "account_id", "business_risk_tier"))
    assert tiers["A9"] == "High Risk"
    assert sum(t == "Low Risk" for t in tiers.values()) == 9


def test_zero_escalation_makes_everyone_high_risk(spark):
    accts = [dict(account_id=f"A{i}") for i in range(4)]
    tickets = [dict(account_id=f"A{i}", satisfaction_score=5) for i in range(4)]
    st = star_of(spark, accounts=accts, support_tickets=tickets)
    assert set(rows(st["fact_account_summary"], "business_risk_tier")) == {("High Risk",)}


def _snapshot(st):
    return {r["year_month"]: r for r in Q.kpi_monthly_mrr_growth(st).collect()}


def test_partial_last_month_and_inclusive_ends(spark):
    subs = [dict(subscription_id="S1", start_date=D(2023, 1, 1), end_date=D(2023, 3, 10), mrr_amount=1),
            dict(subscription_id="S2", start_date=D(2023, 1, 1), end_date=D(2023, 3, 15), mrr_amount=10),
            dict(subscription_id="S3", start_date=D(2023, 1, 1), end_date=None, mrr_amount=100)]
    st = star_of(spark, accounts=[dict(account_id="A1")], subscriptions=subs,
                 churn_events=[dict(churn_date=D(2023, 3, 15))])
    snap = _snapshot(st)
    assert snap["2023-03"]["active_mrr"] == 110  # month end is 03-15, S2 ends on it
    assert snap["2023-02"]["active_mrr"] == 111


def test_gap_month_vanishes_and_lag_skips(spark):
    subs = [dict(subscription_id="S1", start_date=D(2023, 1, 1), end_date=D(2023, 1, 31), mrr_amount=5),
            dict(subscription_id="S2", start_date=D(2023, 3, 1), end_date=None, mrr_amount=7)]
    st = star_of(spark, accounts=[dict(account_id="A1")], subscriptions=subs)
    snap = _snapshot(st)
    assert sorted(snap) == ["2023-01", "2023-03"]
    assert snap["2023-03"]["prev_month_mrr"] == 5


def test_churn_only_month_dropped_from_quick_ratio(spark):
    subs = [dict(subscription_id="S1", start_date=D(2023, 1, 10), end_date=D(2023, 2, 20),
                 churn_flag=True, mrr_amount=50),
            dict(subscription_id="S2", start_date=D(2023, 1, 12), mrr_amount=30)]
    st = star_of(spark, accounts=[dict(account_id="A1")], subscriptions=subs)
    qr = rows(Q.kpi_quick_ratio(st), "ym", "churned_mrr")
    assert qr == [("2023-01", 0)]
    grr = dict(rows(Q.kpi_gross_revenue_retention(st), "year_month", "churned_mrr"))
    assert grr["2023-02"] == 50


def test_multi_churn_fans_out_and_orders_reasons(spark):
    ce = [dict(churn_event_id="C1", churn_date=D(2023, 5, 1), reason_code="pricing"),
          dict(churn_event_id="C2", churn_date=D(2023, 4, 1), reason_code="budget"),
          dict(churn_event_id="C3", churn_date=D(2023, 6, 1), reason_code=None)]
    st = star_of(spark, accounts=[dict(account_id="A1")],
                 subscriptions=[dict(mrr_amount=40)], churn_events=ce)
    s = st["fact_account_summary"].collect()[0]
    assert s["churn_reasons"] == "budget, pricing"
    assert s["first_churn_date"] == D(2023, 4, 1)
    reasons = {r["reason_code_name"]: r for r in Q.kpi_churn_reasons(st).collect()}
    assert set(reasons) == {"budget", "pricing", None}
    assert sum(r["mrr_lost"] for r in reasons.values()) == 120


def test_first_day_pair_and_flags(spark):
    subs = [dict(subscription_id="S1", start_date=D(2023, 1, 1), mrr_amount=10),
            dict(subscription_id="S2", start_date=D(2023, 1, 1), mrr_amount=20, upgrade_flag=True),
            dict(subscription_id="S3", start_date=D(2023, 2, 1), mrr_amount=40, upgrade_flag=True,
                 downgrade_flag=True),
            dict(subscription_id="S4", start_date=D(2023, 2, 2), mrr_amount=80)]
    st = star_of(spark, accounts=[dict(account_id="A1")], subscriptions=subs)
    mv = {r[0]: r[1:] for r in rows(Q.kpi_mrr_movement(st))}
    assert mv["2023-01"] == (30, 0, 0)
    assert mv["2023-02"] == (0, 40, 40)


def test_paid_then_trial_counts_as_converted(spark):
    subs = [dict(subscription_id="S1", account_id="A1", start_date=D(2023, 1, 1), is_trial=False),
            dict(subscription_id="S2", account_id="A1", start_date=D(2023, 2, 1), is_trial=True),
            dict(subscription_id="S3", account_id="A2", is_trial=True)]
    st = star_of(spark, accounts=[dict(account_id="A1"), dict(account_id="A2")], subscriptions=subs)
    assert rows(Q.kpi_trial_conversion(st)) == [(2, 1, 50.0)]


def test_latest_tie_broken_by_subscription_id(spark):
    subs = [dict(subscription_id="S1", start_date=D(2023, 5, 1), plan_tier="Basic"),
            dict(subscription_id="S2", start_date=D(2023, 5, 1), plan_tier="Enterprise"),
            dict(subscription_id="S0", start_date=D(2023, 1, 1), plan_tier="Pro")]
    st = star_of(spark, accounts=[dict(account_id="A1")], subscriptions=subs)
    assert rows(Q.kpi_arpa_by_current_plan(st), "plan_tier_name", "accounts") == [("Enterprise", 1)]


def test_null_names_grouping(spark):
    accts = [dict(account_id="A1", industry=None, referral_source=None),
             dict(account_id="A2", industry="Retail", referral_source="event")]
    subs = [dict(subscription_id="S1", account_id="A1", plan_tier=None),
            dict(subscription_id="S2", account_id="A2", plan_tier="Pro")]
    ce = [dict(account_id="A1", reason_code=None)]
    st = star_of(spark, accounts=accts, subscriptions=subs, churn_events=ce)
    assert rows(Q.kpi_by_industry(st), "industry_name") == [("Retail",)]
    assert rows(Q.kpi_by_referral_source(st), "referral_source_name") == [("event",)]
    assert set(rows(Q.kpi_plan_tier_funnel(st), "plan_tier_name")) == {(None,), ("Pro",)}
    assert rows(Q.kpi_churn_reasons(st), "reason_code_name") == [(None,)]
    assert rows(st["dim_reason_code"]) == []


def test_empty_tables(spark):
    st = star_of(spark)
    assert rows(Q.kpi_executive_overview(st)) == [(0, None, None, None, None, None, None)]
    assert rows(Q.kpi_trial_conversion(st)) == [(0, 0, None)]
    assert Q.kpi_monthly_mrr_growth(st).count() == 0
    assert rows(Q.kpi_ltv_formula(st)) == [(None, None, None)]
    assert rows(Q.kpi_ltv_empirical(st)) == [(None,)]
    assert Q.kpi_quick_ratio(st).count() == 0
    assert rows(st["dim_date"]) == []


def test_lookup_ids_dense_and_sorted(spark):
    accts = [dict(account_id=f"A{i}", industry=n) for i, n in enumerate(["b", "a", "c", "a", None])]
    st = star_of(spark, accounts=accts)
    assert rows(st["dim_industry"].orderBy("industry_id")) == [(1, "a"), (2, "b"), (3, "c")]
