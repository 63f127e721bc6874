"""Cross-result invariants and the expected values recorded for the sf0.01 fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rawkit import SF_MID
from kpiforge.plans import kpis as Q
from kpiforge.plans.warehouse import star_for
from kpiforge.sources.fixtures import raw_from_testdata


@pytest.fixture(scope="module")
def star(spark):
    return star_for(spark, SF_MID)


def one(df):
    return df.collect()[0]


def test_expected_fixture_values(spark, star):
    assert star["fact_feature_usage"].count() == 45469
    d = one(star["dim_date"].agg(F.count("*").alias("n"), F.max("date_key").alias("hi"),
                                 F.min("date_key").alias("lo")))
    assert (d.n, d.hi, d.lo) == (2814, dt.date(2002, 9, 14), dt.date(1995, 1, 1))
    th = one(Q.risk_thresholds(star))
    assert th.satisfaction_p10 == pytest.approx(2.333333, abs=1e-6)
    assert (th.satisfaction_p50, th.escalations_p90) == (3.0, 1.0)
    tiers = dict(star["fact_account_summary"].groupBy("business_risk_tier").count().collect())
    assert tiers == {"Low Risk": 860, "Medium Risk": 315, "High Risk": 325}
    s = star["fact_account_summary"]
    assert s.where(F.col("avg_satisfaction").isNull()).count() == 600
    assert s.where(F.col("first_churn_date").isNull()).count() == 795
    assert tuple(one(Q.kpi_trial_conversion(star)))[:2] == (1238, 1178)
    fs = star["fact_subscriptions"]
    assert fs.where(F.col("end_date").isNull()).count() == 10108
    assert fs.where(F.col("churn_flag") & F.col("end_date").isNull()).count() == 89
    assert star["fact_support_tickets"].where(F.col("closed_at").isNull()).count() == 770
    raw = raw_from_testdata(spark, SF_MID)
    assert raw.feature_usage.where(F.col("subscription_id") == "S-none").count() == 646
    assert raw.accounts.where(F.col("industry").isNull()).count() == 30
    assert raw.accounts.where(F.col("referral_source").isNull()).count() == 38
    assert raw.churn_events.where(F.col("reason_code").isNull()).count() == 127
    latest_ties = (fs.groupBy("account_id", "start_date").count()
                   .join(fs.groupBy("account_id").agg(F.max("start_date").alias("start_date")),
                         ["account_id", "start_date"])
                   .where("count > 1").count())
    assert latest_ties == 7


def test_executive_overview_and_ltv(star):
    e = one(Q.kpi_executive_overview(star))
    assert (e.total_accounts, e.churned_accounts) == (1500, 334)
    assert e.customer_churn_rate_pct == pytest.approx(22.2667, abs=1e-4)
    assert (e.total_mrr_all, e.mrr_lost_to_churn) == (11967798, 2672950)
    assert e.total_arr_estimate == 12 * 11967798
    assert e.arpa == pytest.approx(7978.532, abs=1e-3)
    f = one(Q.kpi_ltv_formula(star))
    assert f.arpa == pytest.approx(7971.5678, abs=1e-4)
    assert f.correct_monthly_churn_rate == pytest.approx(0.0119, abs=1e-4)
    assert f.ltv_formula_based == pytest.approx(672038.548, rel=1e-6)
    assert one(Q.kpi_ltv_empirical(star))[0] == pytest.approx(5778.0812, abs=1e-4)


def test_tiers_partition_accounts(star):
    total = star["fact_account_summary"].count()
    assert sum(r.account_count for r in Q.kpi_risk_tier_distribution(star).collect()) == total


def test_keys_are_clean(star):
    for r in Q.star_key_checks(star).collect():
        assert r.key_not_null and r.key_unique, r.table_name


def test_quick_ratio_reuses_movement(star):
    mv = {r.movement_month: tuple(r)[1:] for r in Q.kpi_mrr_movement(star).collect()}
    qr = {r.ym: (r.new_mrr, r.expansion_mrr, r.contraction_mrr) for r in Q.kpi_quick_ratio(star).collect()}
    assert mv == qr


def test_grr_starting_equals_snapshot(star):
    g = {r.year_month: r.starting_mrr for r in Q.kpi_gross_revenue_retention(star).collect()}
    m = {r.year_month: r.active_mrr for r in Q.kpi_monthly_mrr_growth(star).collect()}
    assert g == m


def test_summary_usage_reads_raw_rows(star):
    raw_total = one(star["fact_account_summary"].agg(F.sum("total_usage_events")))[0]
    fact_total = one(star["fact_feature_usage"].agg(F.sum("usage_count")))[0]
    assert raw_total >= fact_total
    assert (raw_total, fact_total) == (1507722, 1157171)


def test_lookup_ids_dense(star):
    for name, id_col in [("dim_industry", "industry_id"), ("dim_plan_tier", "plan_tier_id"),
                         ("dim_referral_source", "referral_source_id"),
                         ("dim_reason_code", "reason_code_id")]:
        ids = sorted(r[0] for r in star[name].select(id_col).collect())
        assert ids == list(range(1, len(ids) + 1)), name
