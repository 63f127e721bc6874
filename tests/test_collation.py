"""Text keys under a collation: variants of case and trailing blanks are one value."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kpiforge.functions.columns import round_doubles
from kpiforge.plans import kpis as Q
from kpiforge.plans.build import stage_raw
from kpiforge.plans.star import RawTables
from kpiforge.plans.warehouse import StarOnDemand, TableStore
from kpiforge.sources.collation import FAMILIES, respelled, spellings, with_collation
from kpiforge.sources.fixtures import raw_from_testdata
from rawkit import SF_SMALL, make_raw, rows


def test_spellings_map_to_the_smallest(spark):
    df = spark.createDataFrame([("Pro",), ("pro",), ("PRO ",), ("Basic",), ("basic  ",), (None,), ("Pró",), ("x",)], "p string")
    got = dict(spellings([df], "UTF8_LCASE_RTRIM").collect())
    assert got == {"Pro": "PRO ", "pro": "PRO ", "basic  ": "Basic"}
    back = respelled(df, "p", spellings([df], "UTF8_LCASE_RTRIM"))
    assert sorted(map(str, rows(back))) == sorted(map(str, [("PRO ",)] * 3 + [("Basic",)] * 2 + [(None,), ("Pró",), ("x",)]))


def varied(raw):
    """The same data, keys and names spelled otherwise in some rows (variants that are larger in bytes)."""
    tables = raw.as_dict()
    for family in FAMILIES:
        for table, column in family:
            c = F.col(column)
            pick = F.pmod(F.xxhash64(F.lit(column), *[F.col(x) for x in tables[table].columns]), F.lit(4))
            if table in ("accounts", "subscriptions") and column in ("account_id", "subscription_id"):
                continue  # the primary spelling of ids stays in its own table
            tables[table] = tables[table].withColumn(column, F.when(pick == 0, F.lower(c)).when(
                pick == 1, F.concat(c, F.lit("  "))).otherwise(c))
    return RawTables(**tables)


RESULTS = ["kpi_by_industry", "kpi_top_features", "kpi_support_by_priority", "kpi_churn_reasons",
           "kpi_arpa_by_current_plan", "kpi_support_vs_churn"]


def star_of(raw, path):
    """The star over written raw tables, as a build with a collation stages them."""
    return StarOnDemand(stage_raw(raw, f"{path}/raw"), TableStore(f"{path}/star"))


@pytest.fixture(scope="module")
def stars(spark, tmp_path_factory):
    raw = raw_from_testdata(spark, SF_SMALL)
    odd = stage_raw(varied(raw), str(tmp_path_factory.mktemp("varied")))
    return tuple(star_of(r, str(tmp_path_factory.mktemp("star"))) for r in (raw, with_collation(odd), odd))


@pytest.mark.parametrize("name", RESULTS)
def test_results_with_variants_equal_those_without(stars, name):
    plain, collated, _ = (sorted(map(str, round_doubles(Q.KPIS[name](s)).collect())) for s in stars)
    assert collated == plain


def test_without_a_collation_variants_are_other_values(stars):
    plain, _, binary = stars
    assert binary["dim_plan_tier"].count() > plain["dim_plan_tier"].count()


def test_keys_equal_under_the_collation_fail_the_check(spark, tmp_path):
    raw = stage_raw(make_raw(spark, support_tickets=[dict(ticket_id="T1"), dict(ticket_id="t1 ")]), str(tmp_path / "odd"))
    for source, unique in ((raw, True), (with_collation(raw), False)):
        star = star_of(source, str(tmp_path / str(unique)))
        tickets = star["fact_support_tickets"]
        assert (tickets.select("ticket_id").distinct().count() == tickets.count()) == unique


def test_load_option(spark, tmp_path):
    from kpiforge.sources.files import load_raw

    raw = make_raw(spark, accounts=[dict(account_id="A1", plan_tier="Pro"), dict(account_id="A2", plan_tier="pro ")],
                   subscriptions=[dict(account_id="a1 "), dict(subscription_id="S9", account_id="A2")])
    for name, df in raw.as_dict().items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = load_raw(spark, str(tmp_path), "parquet", exact_int_money=True, collation="UTF8_LCASE_RTRIM")
    assert sorted(rows(got.subscriptions, "account_id")) == [("A1",), ("A2",)]
    assert sorted(rows(got.accounts, "plan_tier")) == [("Pro",), ("Pro",)]
    plain = load_raw(spark, str(tmp_path), "parquet", exact_int_money=True)
    assert ("a1 ",) in rows(plain.subscriptions, "account_id")
