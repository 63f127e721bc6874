"""File sources: typed CSV reads, name resolution, input checks, idempotent rebuild."""

import datetime as dt
import os
import tempfile

import pytest

from kpiforge.plans.kpis import kpi_executive_overview
from kpiforge.plans.star import build_star
from kpiforge.plans.warehouse import materialize_star
from kpiforge.schemas import RAW_NAMES
from kpiforge.sources.files import (MissingInputError, load_raw, require_columns,
                                    resolve_source)
from rawkit import D, make_raw, rows


def _write_csvs(root, prefix=""):
    files = {
        "accounts": "account_id,account_name,industry,country,signup_date,referral_source,plan_tier,"
                    "seats,is_trial,churn_flag\nA1,One,Tech,US,2023-01-05,ads,Pro,3,false,true\n"
                    "A2,Two,,DE,2023-02-01,,Basic,1,true,false\n",
        "subscriptions": "subscription_id,account_id,start_date,end_date,plan_tier,seats,mrr_amount,"
                         "arr_amount,is_trial,upgrade_flag,downgrade_flag,churn_flag,"
                         "billing_frequency,auto_renew_flag\n"
                         "S1,A1,2023-01-05,2023-03-01,Pro,3,99.50,1194.00,false,false,false,true,"
                         "monthly,true\nS2,A2,2023-02-01,,Basic,1,0.00,0.00,true,false,false,false,"
                         "annual,false\n",
        "feature_usage": "usage_id,subscription_id,usage_date,feature_name,usage_count,"
                         "usage_duration_secs,error_count,is_beta_feature\n"
                         "U1,S1,2023-01-06,f1,4,40,1,false\nU1,S1,2023-01-06,f1,4,40,1,false\n",
        "support_tickets": "ticket_id,account_id,submitted_at,closed_at,resolution_time_hours,"
                           "priority,first_response_time_minutes,satisfaction_score,"
                           "escalation_flag\nT1,A1,2023-01-07 10:00:00,2023-01-08 09:00:00,23.0,"
                           "high,15,4,false\n",
        "churn_events": "churn_event_id,account_id,churn_date,reason_code,refund_amount_usd,"
                        "preceding_upgrade_flag,preceding_downgrade_flag,is_reactivation,"
                        "feedback_text\nC1,A1,2023-03-01,budget,10.00,false,false,false,too dear\n",
    }
    for name, text in files.items():
        with open(os.path.join(root, f"{prefix}{name}.csv"), "w", encoding="utf-8") as f:
            f.write(text)


def test_csv_load_typed_and_prefixed_names(spark):
    root = tempfile.mkdtemp(prefix="csvsrc-")
    _write_csvs(root, prefix="exp_")
    raw = load_raw(spark, root, "csv", prefixes=["exp_"])
    acc = raw.accounts.orderBy("account_id").collect()
    assert acc[0]["signup_date"] == D(2023, 1, 5) and acc[0]["churn_flag"] is True
    assert acc[1]["industry"] is None
    sub = raw.subscriptions.orderBy("subscription_id").collect()
    assert str(sub[0]["mrr_amount"]) == "99.50"
    t = raw.support_tickets.collect()[0]
    assert t["submitted_at"] == dt.datetime(2023, 1, 7, 10)
    star = build_star(raw)
    assert rows(star["fact_feature_usage"], "usage_id") == [("U1",)]
    assert rows(kpi_executive_overview(star), "total_accounts", "churned_accounts") == [(2, 1)]


def test_plain_name_preferred(spark):
    root = tempfile.mkdtemp(prefix="csvsrc-")
    _write_csvs(root)
    _write_csvs(root, prefix="exp_")
    assert resolve_source(spark, root, "accounts", "csv", ["exp_"]).endswith("/accounts.csv")


def test_missing_input_fails_early(spark):
    root = tempfile.mkdtemp(prefix="csvsrc-")
    with pytest.raises(MissingInputError):
        load_raw(spark, root, "csv")
    raw = make_raw(spark)
    with pytest.raises(MissingInputError):
        require_columns({"accounts": raw.accounts.drop("seats")}, {"accounts": ["seats"]})
    with pytest.raises(MissingInputError):
        require_columns({}, {"accounts": ["seats"]})


def test_parquet_source_and_idempotent_rebuild(spark):
    root = tempfile.mkdtemp(prefix="pqsrc-")
    _write_csvs(root)
    raw = load_raw(spark, root, "csv")
    pq = tempfile.mkdtemp(prefix="pq-")
    for name, df in raw.as_dict().items():
        df.write.mode("overwrite").parquet(f"{pq}/{name}.parquet")
    raw2 = load_raw(spark, pq, "parquet")
    out = tempfile.mkdtemp(prefix="star-")
    first = {n: sorted(rows(df)) for n, df in materialize_star(raw2, out).items()}
    second = {n: sorted(rows(df)) for n, df in materialize_star(raw2, out).items()}
    assert first == second
    assert set(first) >= {"dim_account", "fact_account_summary"}
    assert len(RAW_NAMES) == 5


def test_end_to_end_job_from_csv(spark):
    from kpiforge.plans.build import run

    root = tempfile.mkdtemp(prefix="csvsrc-")
    _write_csvs(root)
    out = tempfile.mkdtemp(prefix="job-")
    paths = run(spark, root, "csv", out)
    assert len(paths) == 25
    counts = dict(spark.read.parquet(paths["table_row_counts"]).collect())
    assert counts["fact_feature_usage"] == 1 and counts["dim_account"] == 2
    again = run(spark, root, "csv", out)  # idempotent re-run over the same folder
    assert sorted(spark.read.parquet(again["kpi_executive_overview"]).collect()) == \
        sorted(spark.read.parquet(paths["kpi_executive_overview"]).collect())


def test_job_fails_on_duplicate_account_keys(spark):
    from kpiforge.plans.build import KeyCheckError, run

    root = tempfile.mkdtemp(prefix="csvsrc-")
    _write_csvs(root)
    with open(os.path.join(root, "accounts.csv"), "a", encoding="utf-8") as f:
        f.write("A1,Again,Tech,US,2023-01-05,ads,Pro,3,false,true\n")
    with pytest.raises(KeyCheckError, match="dim_account"):
        run(spark, root, "csv", tempfile.mkdtemp(prefix="job-"))


def test_csv_bits_accept_numbers_and_words(spark):
    root = tempfile.mkdtemp(prefix="csvsrc-")
    _write_csvs(root)
    with open(os.path.join(root, "accounts.csv"), "w", encoding="utf-8") as f:
        f.write("account_id,account_name,industry,country,signup_date,referral_source,plan_tier,"
                "seats,is_trial,churn_flag\nA1,One,Tech,US,2023-01-05,ads,Pro,3,1,True\n"
                "A2,Two,,DE,2023-02-01,,Basic,1,0,\n")
    raw = load_raw(spark, root, "csv")
    assert rows(raw.accounts.orderBy("account_id"), "is_trial", "churn_flag") == \
        [(True, True), (False, None)]
    with open(os.path.join(root, "accounts.csv"), "a", encoding="utf-8") as f:
        f.write("A3,Three,,DE,2023-02-01,,Basic,1,maybe,0\n")
    with pytest.raises(Exception, match="not a boolean"):
        load_raw(spark, root, "csv").accounts.collect()


def test_reopen_star_and_query_with_sql(spark):
    from kpiforge.plans.warehouse import open_star, register_views

    root = tempfile.mkdtemp(prefix="csvsrc-")
    _write_csvs(root)
    out = tempfile.mkdtemp(prefix="star-")
    built = materialize_star(load_raw(spark, root, "csv"), out)
    again = open_star(spark, out)
    assert set(again) == set(built)
    register_views(again)
    n = spark.sql("SELECT COUNT(*) FROM fact_account_summary WHERE business_risk_tier IS NOT NULL")
    assert n.collect()[0][0] == 2
    assert rows(kpi_executive_overview(again)) == rows(kpi_executive_overview(built))


def test_cli_builds_and_shows(spark, capsys):
    from kpiforge.plans.build import main

    root = tempfile.mkdtemp(prefix="csvsrc-")
    _write_csvs(root, prefix="exp_")
    out = tempfile.mkdtemp(prefix="cli-")
    main(["--raw", root, "--format", "csv", "--out", out, "--prefix", "exp_",
          "--show", "kpi_executive_overview"])
    text = capsys.readouterr().out
    assert "kpi_quick_ratio\t" in text and "total_accounts" in text


def test_csv_columns_are_bound_by_header_name(spark, tmp_path):
    from kpiforge.schemas import ACCOUNTS
    from kpiforge.sources.files import read_raw_table

    plain = tmp_path / "a.csv"
    plain.write_text("account_id,account_name,industry,country,signup_date,referral_source,plan_tier,"
                     "seats,is_trial,churn_flag\nA1,One,Tech,US,2023-01-05,ads,Pro,3,false,true\n")
    other = tmp_path / "b.csv"
    other.write_text("churn_flag,extra,country,industry,account_id,account_name,signup_date,plan_tier,"
                     "referral_source,seats,is_trial\n1,x,US,Tech,A1,One,2023-01-05,Pro,ads,3,0\n")
    same = [read_raw_table(spark, str(p), ACCOUNTS).collect() for p in (plain, other)]
    assert same[0] == same[1]
    lacking = tmp_path / "c.csv"
    lacking.write_text("account_id,account_name\nA1,One\n")
    with pytest.raises(MissingInputError):
        read_raw_table(spark, str(lacking), ACCOUNTS)
