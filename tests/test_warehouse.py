"""Versions, builds on demand, the shared usage join, measured checks and dense ids."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

from kpiforge.operators.lookup import build_lookup, numbered, ordered_names
from kpiforge.operators.skew import heavy_rows, inner_join_split
from kpiforge.plans import kpis as Q
from kpiforge.plans import star as S
from kpiforge.plans import warehouse as W
from kpiforge.plans.build import KeyCheckError, validate_keys
from kpiforge.plans.registry import names as result_names
from kpiforge.plans.registry import result
from kpiforge.plans.versions import Manifest, VersionedFolder
from rawkit import SF_SMALL, make_raw, rows


def two_accounts(spark, **more):
    return make_raw(spark, accounts=[dict(account_id="A1"), dict(account_id="A2", industry="Retail")],
                    subscriptions=[dict(subscription_id="S1"), dict(subscription_id="S2", account_id="A2")],
                    feature_usage=[dict(), dict(usage_id="U1", feature_name="f0"), dict(subscription_id="S2")], **more)


# ------------------------------------------------------------------ versions

def test_failed_check_leaves_the_published_star(spark, tmp_path):
    path = str(tmp_path / "star")
    W.materialize_star(two_accounts(spark), path)
    bad = make_raw(spark, accounts=[dict(account_id="A1"), dict(account_id="A1")])
    with pytest.raises(KeyCheckError, match="dim_account.account_id"):
        W.materialize_star(bad, path, before_publish=lambda star, folder: validate_keys(star))
    again = W.open_star(spark, path)
    assert sorted(rows(again["dim_account"], "account_id")) == [("A1",), ("A2",)]
    assert len(os.listdir(tmp_path / "star" / "data")) == 1  # the failed build is gone


def test_a_build_that_breaks_off_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "star")
    broken = two_accounts(spark, support_tickets=[dict()])
    broken.support_tickets = broken.support_tickets.withColumn(
        "priority", F.raise_error(F.lit("lost input")).cast("string"))
    with pytest.raises(Exception, match="lost input"):
        W.materialize_star(broken, path)
    with pytest.raises(W.NoStarError):
        W.open_star(spark, path)


def test_new_versions_replace_old_ones_and_two_stay(spark, tmp_path):
    path = str(tmp_path / "star")
    seen = []
    for n in range(3):
        W.materialize_star(make_raw(spark, accounts=[dict(account_id=f"A{i}") for i in range(n + 1)]), path)
        star = W.open_star(spark, path)
        seen.append(star["dim_account"].count())
        assert star.measured["dim_account"].rows == n + 1
    assert seen == [1, 2, 3]
    folder = VersionedFolder(spark, path)
    assert folder.numbers() == [3, 2] and len(os.listdir(tmp_path / "star" / "data")) == 2
    held = os.listdir(tmp_path / "star" / "data" / folder.current().version)
    assert set(held) == set(W.PUBLISHED)  # scratch of the build is gone


def test_half_written_manifest_is_passed_over(spark, tmp_path):
    folder = VersionedFolder(spark, str(tmp_path))
    folder.publish(Manifest("v-a", {"t": "data/v-a/t"}))
    (tmp_path / "_versions" / "2.json").write_text('{"version": "v-b", "tab')
    assert folder.current().version == "v-a"
    assert folder.publish(Manifest("v-c", {})).number == 3 and folder.current().version == "v-c"


def test_two_builds_at_once_get_numbers_of_their_own(spark, tmp_path):
    one, other = (VersionedFolder(spark, str(tmp_path)) for _ in range(2))
    other.numbers = lambda: []  # it looked before the first one published
    assert one.publish(Manifest("v-a", {})).number == 1
    assert other.publish(Manifest("v-b", {})).number == 2


# ---------------------------------------------------------------- on demand

def test_a_result_builds_only_what_it_reads(spark, tmp_path):
    store = W.TableStore(str(tmp_path))
    star = W.StarOnDemand(on_files(spark, tmp_path / "raw"), store)
    assert star["dim_industry"].count() == 2
    assert store.built == ["_names_dim_industry", "dim_industry"]
    Q.kpi_monthly_mrr_growth(star).collect()
    assert set(store.built) == {"_names_dim_industry", "dim_industry", "_names_dim_plan_tier", "dim_plan_tier",
                                "dim_date", "fact_subscriptions", "blk_monthly_snapshot"}
    before = list(store.built)
    Q.kpi_monthly_mrr_growth(star).collect()
    assert store.built == before


def on_files(spark, path, **more):
    """Raw tables read from files, as fingerprints need them."""
    raw = two_accounts(spark, **more)
    for name, df in raw.as_dict().items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
    return S.RawTables(**{n: spark.read.parquet(f"{path}/{n}") for n in raw.as_dict()})


def test_changed_input_is_seen_and_the_rest_is_used_again(spark, tmp_path):
    store = W.TableStore(str(tmp_path / "store"))
    star = W.StarOnDemand(on_files(spark, tmp_path / "raw"), store)
    assert star["fact_support_tickets"].count() == 0 and star["dim_account"].count() == 2
    built = list(store.built)
    make_raw(spark, support_tickets=[dict()]).support_tickets.write.mode("overwrite").parquet(
        str(tmp_path / "raw" / "support_tickets"))
    raw = S.RawTables(**{n: spark.read.parquet(f"{tmp_path}/raw/{n}") for n in star._raw.as_dict()})
    again = W.StarOnDemand(raw, store)
    assert again["fact_support_tickets"].count() == 1 and again["dim_account"].count() == 2
    assert store.built[len(built):] == ["fact_support_tickets"]
    assert star["fact_support_tickets"].count() == 0  # the older star keeps its own table


def test_closure_lists_inputs_first():
    for name in W.PUBLISHED:
        steps = W.closure([name])
        assert steps[-1] == name and all(steps.index(r) < steps.index(s) for s in steps for r in W.STEPS[s].reads)


def test_every_result_runs_on_demand(spark):
    for name in ("dim_reason_code", "kpi_support_by_priority"):
        assert name in result_names() and result(spark, SF_SMALL, name).count() > 0


# ----------------------------------------------------------- one usage join

def scans(df, table):
    text = df._jdf.queryExecution().analyzed().toString()
    return len(re.findall(rf"Relation.*{table}", text))


def test_usage_meets_subscriptions_once(spark, tmp_path):
    raw = on_files(spark, tmp_path / "raw")
    reads = {n: [r for r in s.raw if r == "feature_usage"] for n, s in W.STEPS.items()}
    assert [n for n, r in reads.items() if r] == ["_hot_subscriptions", "_usage_with_account"]
    hot = S.hot_subscriptions(raw)
    hot.write.parquet(str(tmp_path / "hot"))
    joined = S.usage_with_account(raw, spark.read.parquet(str(tmp_path / "hot")))
    text = joined._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("usage_duration_secs#") and len(re.findall(r"Relation \[usage_id", text)) == 1
    joined.write.parquet(str(tmp_path / "joined"))
    staged = spark.read.parquet(str(tmp_path / "joined"))
    for df in (S.fact_feature_usage(raw, staged), S.account_summary_base(raw, staged)):
        assert "Relation [usage_id" in (t := df._jdf.queryExecution().optimizedPlan().toString())
        assert "feature_usage" not in " ".join(df.inputFiles())
        assert len(re.findall(r"Relation \[usage_id|Relation \[subscription_id#\d+,usage_id", t)) == 1


@pytest.mark.parametrize("share", [0.001, 0.2, 2.0])
def test_split_join_is_the_plain_join(spark, share):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None)
         .otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([("hot", 1, None), (None, 2, "n"), ("k5", 3, "a"), ("k5", 4, "b"), ("k9", None, "c")],
                                  "k string, y int, z string")
    heavy = heavy_rows(left, right, "k", share)
    assert heavy.count() == {0.001: 4, 0.2: 1, 2.0: 0}[share]
    got = inner_join_split(left, right, "k", heavy, ["x"])
    want = left.join(right, "k")
    assert got.columns == ["k", "x", "y", "z"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select("k", "x", "y", "z").collect()))


def test_a_hot_key_is_dealt_to_all_partitions(spark):
    left = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(50)], "k string, y int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = inner_join_split(left, right, "k", heavy_rows(left, right, "k"), ["x"])
        held = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(held) == 8 and max(held) < 2 * min(held) and sum(held) == 20_000


def _shuffled_columns(df):
    """Column names of every shuffle of a plan."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            found.append({node.output().apply(i).name() for i in range(node.output().size())})
    return found


def test_a_row_of_the_split_join_is_shuffled_with_its_key_once(spark):
    left = spark.range(3000).select((F.col("id") % 10).alias("k"), F.col("id").alias("x"))
    right = spark.createDataFrame([(3, "a"), (4, None), (99, "z")], "k bigint, y string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = inner_join_split(left, right, "k", right.where("k = 3"), ["x"])
        assert {"x", "__hot", "__key", "__side"} in _shuffled_columns(got)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.dtypes == [("k", "bigint"), ("x", "bigint"), ("y", "string")]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [
        (i % 10, i, "a" if i % 10 == 3 else None) for i in range(3000) if i % 10 in (3, 4)]


@pytest.mark.parametrize("name", ["_usage_with_account", "fact_feature_usage"])
def test_files_of_the_usage_tables_hold_few_rows(spark, tmp_path, name):
    usage = spark.range(150_000).coalesce(1).select(F.concat(F.lit("U"), F.col("id").cast("string")).alias("usage_id"))
    df, counted = W.write_measured(usage, str(tmp_path), name)
    held = [r["count"] for r in df.groupBy(F.input_file_name()).count().collect()]
    assert max(held) <= 60_000 and sum(held) == counted.rows == 150_000


# ------------------------------------------------------------ measured checks

def test_measured_checks_equal_counted_ones(spark, tmp_path):
    star = W.materialize_star(two_accounts(spark, churn_events=[dict(), dict(churn_event_id=None)]), str(tmp_path))
    plain = S.StarSchema(star)
    for check in (Q.star_key_checks, Q.table_row_counts):
        assert sorted(check(star).collect()) == sorted(check(plain).collect())
    assert check(star).schema["row_count"].dataType == check(plain).schema["row_count"].dataType
    bad = Q.star_key_checks(star).where("NOT key_not_null").collect()
    assert [(r.table_name, r.non_null_keys, r.row_count) for r in bad] == [("fact_churn_events", 1, 2)]


def test_row_counts_need_no_scan(spark, tmp_path):
    star = W.materialize_star(two_accounts(spark), str(tmp_path))
    assert "Scan parquet" not in Q.table_row_counts(star)._jdf.queryExecution().executedPlan().toString()


def test_equal_lookup_names_fail_the_check(spark):
    st = S.build_star(two_accounts(spark))
    twice = spark.createDataFrame([(1, "Tech"), (2, "Tech")], "industry_id int, industry_name string")
    star = S.StarSchema({**st, "dim_industry": twice})
    with pytest.raises(KeyCheckError, match="dim_industry.industry_name"):
        validate_keys(star)


# ----------------------------------------------------------------- dense ids

@pytest.mark.parametrize("n", [0, 1, 500])
def test_ids_equal_those_of_one_window(spark, tmp_path, n):
    names = spark.createDataFrame([(None if i % 17 == 3 else f"name {i * 7919 % 211} {'é' * (i % 2)}",)
                                   for i in range(n)], "n string")
    ordered_names(names, "x_name").write.parquet(str(tmp_path / "names"))
    got = numbered(spark.read.parquet(str(tmp_path / "names")), "x_id", "x_name")
    want = build_lookup(names, "x_id", "x_name")
    assert got.schema == want.schema or [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
    assert sorted(got.collect()) == sorted(want.collect())


def test_lookup_steps_have_no_window_over_all_names(spark, tmp_path):
    raw = on_files(spark, tmp_path / "raw")
    store = W.TableStore(str(tmp_path / "store"))
    marks = store.fingerprints(raw)
    for name in S.LOOKUPS:
        store.need(raw, marks, name)
        staged = store._held[marks[f"_names_{name}"]][0]
        for df in (W.STEPS[f"_names_{name}"].build(raw, {}), W.STEPS[name].build(raw, {f"_names_{name}": staged})):
            text = df._jdf.queryExecution().executedPlan().toString()
            assert "Window" not in text and "SinglePartition" not in text


# ---------------------------------------------------------- clustered by month

def test_facts_by_month_skip_files(spark, tmp_path):
    """One month of the usage fact reads a small part of the clustered files."""
    raw = S.RawTables(**{n: df for n, df in __import__("kpiforge").raw_from_testdata(spark, SF_SMALL).as_dict().items()})
    star = W.materialize_star(raw, str(tmp_path / "star"), by_month=True)
    plain = W.materialize_star(raw, str(tmp_path / "plain"))
    usage = star["fact_feature_usage"]
    assert sorted(usage.collect()) == sorted(plain["fact_feature_usage"].collect())

    def spans(df):
        parts = df.groupBy(F.input_file_name().alias("f")).agg(F.min("usage_date").alias("lo"), F.max("usage_date").alias("hi"))
        return parts.where("hi >= date'1996-03-01' AND lo <= date'1996-03-31'").count(), parts.count()

    hit, files = spans(usage)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        wide = W.clustered_by_month(plain["fact_feature_usage"], "usage_date")
        wide.write.parquet(str(tmp_path / "wide"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hit, files = spans(spark.read.parquet(str(tmp_path / "wide")))
    assert files == 8 and hit <= 2
