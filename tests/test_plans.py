"""Physical-plan properties that matter at scale."""

import pytest

from rawkit import SF_SMALL
from kpiforge.plans import kpis as Q
from kpiforge.plans import star as S
from kpiforge.plans.warehouse import star_for
from kpiforge.sources.fixtures import raw_from_testdata


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def star(spark):
    return star_for(spark, SF_SMALL)


@pytest.mark.parametrize("name", list(Q.KPIS) + list(Q.CHECKS))
def test_no_pairwise_join(star, name):
    df = (Q.KPIS.get(name) or Q.CHECKS[name])(star)
    text = plan_text(df)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_build_has_no_pairwise_join(spark):
    st = S.build_star(raw_from_testdata(spark, SF_SMALL))
    for name, df in st.items():
        text = plan_text(df)
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_top_features_is_take_ordered(star):
    assert "TakeOrderedAndProject" in plan_text(Q.kpi_top_features(star))


def test_dedupe_limits_before_shuffle(spark, star):
    raw = raw_from_testdata(spark, SF_SMALL)
    for df in (S.fact_feature_usage(raw), Q.kpi_arpa_by_current_plan(star)):
        text = plan_text(df)
        assert "WindowGroupLimit" in text and "Partial" in text


def test_scans_are_pruned_and_filtered(spark):
    raw = raw_from_testdata(spark, SF_SMALL)
    text = plan_text(raw.churn_events.select("account_id"))
    # only the columns the projection needs, and the status filter at the scan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in text
    assert "EqualTo(o_orderstatus,F)" in text


def test_thresholds_are_one_scalar_subquery(spark):
    st = S.build_star(raw_from_testdata(spark, SF_SMALL))
    df = st["fact_account_summary"]
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("\n")
    # the one-row thresholds reach the tier expression as a scalar subquery
    # (computed once, then reused), never as a join
    assert any("ReusedSubquery" in line for line in final)
    assert not any("NestedLoopJoin" in line or "CartesianProduct" in line for line in final)
