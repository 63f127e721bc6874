"""Hot keys: one account, one subscription and one usage_id own a third of their tables.

Results must stay whole and exact: the Spark build and KPIs are compared with
the DuckDB oracle run over the very same raw tables.
"""

import tempfile

import pytest
from pyspark.sql import functions as F

from compare import compare
from rawkit import SF_MID
from kpiforge import oracle
from kpiforge.plans.kpis import CHECKS, KPIS
from kpiforge.plans.star import STAR_TABLES, RawTables
from kpiforge.plans.warehouse import materialize_star
from kpiforge.sources.fixtures import raw_from_testdata

import duckdb


def skewed(raw: RawTables) -> RawTables:
    hot_acc, hot_sub = F.lit("A-1"), F.lit("S-3")
    k = F.abs(F.xxhash64("subscription_id")) % 3 == 0
    subs = raw.subscriptions.withColumn("account_id", F.when(k, hot_acc).otherwise(F.col("account_id")))
    u_hot = F.abs(F.xxhash64("usage_id", "usage_date")) % 3
    usage = (raw.feature_usage
             .withColumn("subscription_id", F.when(u_hot == 0, hot_sub).otherwise(F.col("subscription_id")))
             .withColumn("usage_id", F.when(u_hot == 1, F.lit("U-HOT")).otherwise(F.col("usage_id"))))
    t_hot = F.abs(F.xxhash64("ticket_id")) % 3 == 0
    tickets = raw.support_tickets.withColumn(
        "account_id", F.when(t_hot, hot_acc).otherwise(F.col("account_id")))
    c_hot = F.abs(F.xxhash64("churn_event_id")) % 3 == 0
    churn = raw.churn_events.withColumn("account_id", F.when(c_hot, hot_acc).otherwise(F.col("account_id")))
    return RawTables(raw.accounts, subs, usage, tickets, churn)


@pytest.fixture(scope="module")
def setup(spark):
    raw = skewed(raw_from_testdata(spark, SF_MID))
    root = tempfile.mkdtemp(prefix="skew-")
    con = duckdb.connect()
    staged = {}
    for name, df in raw.as_dict().items():
        df.write.mode("overwrite").parquet(f"{root}/raw/{name}")
        staged[name] = spark.read.parquet(f"{root}/raw/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/raw/{name}/*.parquet')")
    star = materialize_star(RawTables(**staged), f"{root}/star")
    return star, con


@pytest.mark.parametrize("name", list(STAR_TABLES) + list(CHECKS) + list(KPIS))
def test_skewed_results_are_exact(setup, name):
    from kpiforge.functions.columns import round_doubles

    star, con = setup
    df = star[name] if name in STAR_TABLES else (KPIS.get(name) or CHECKS[name])(star)
    ok, msg = compare(round_doubles(df), con, oracle.statement(name, from_raw_tables=True))
    assert ok, msg


def test_hot_keys_really_are_hot(setup):
    star, _ = setup
    subs = star["fact_subscriptions"]
    assert subs.where("account_id = 'A-1'").count() * 4 > subs.count()
