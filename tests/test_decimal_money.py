"""DECIMAL money: every result over cents equals the one over whole numbers of cents."""

from __future__ import annotations

import decimal
import tempfile

import pytest
from pyspark.sql import functions as F

from kpiforge.functions.columns import round_doubles
from kpiforge.plans.kpis import KPIS
from kpiforge.plans.star import STAR_TABLES, RawTables, build_star
from kpiforge.plans.warehouse import materialize_star
from kpiforge.schemas import raw_schemas
from kpiforge.sources.fixtures import raw_from_testdata
from rawkit import SF_SMALL

MONEY = {"subscriptions": ["mrr_amount", "arr_amount"], "churn_events": ["refund_amount_usd"]}
WORDS = ("mrr", "arr", "refund", "arpa", "ltv")


def in_cents(raw):
    """The same money as DECIMAL(18,2), a hundredth of the whole numbers, in the declared schema of real data."""
    tables = raw.as_dict()
    for name, columns in MONEY.items():
        tables[name] = tables[name].withColumns(
            {c: (F.col(c).cast("decimal(18,2)") / 100).cast("decimal(18,2)") for c in columns})
        assert tables[name].schema == raw_schemas(False)[name] or [
            f.dataType for f in tables[name].schema] == [f.dataType for f in raw_schemas(False)[name]]
    return RawTables(**tables)


@pytest.fixture(scope="module")
def stars(spark):
    raw = raw_from_testdata(spark, SF_SMALL)
    return materialize_star(raw, tempfile.mkdtemp(prefix="whole-")), materialize_star(
        in_cents(raw), tempfile.mkdtemp(prefix="cents-"))


def is_money(column):
    return any(w in column for w in WORDS) and not column.endswith(("_pct", "_rate", "ratio"))


@pytest.mark.parametrize("name", [t for t in STAR_TABLES if t.startswith("fact")] + list(KPIS))
def test_results_differ_by_the_unit_alone(stars, name):
    whole, cents = ((s[name] if name in STAR_TABLES else KPIS[name](s)) for s in stars)
    assert whole.columns == cents.columns

    def norm(row, factor):
        out = []
        for c, v in row.asDict().items():
            if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
                v = round(float(v) * (factor if is_money(c) else 1), 3)
            out.append(str(v))
        return out

    a = sorted(norm(r, 1) for r in whole.collect())
    b = sorted(norm(r, 100) for r in cents.collect())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or all(p == q or float(p) == pytest.approx(float(q), rel=1e-9, abs=2e-3) for p, q in zip(x, y))


def test_money_keeps_its_cents(stars):
    _, cents = stars
    for table, column in (("fact_subscriptions", "mrr_amount"), ("fact_account_summary", "total_mrr"),
                          ("fact_account_summary", "total_refunds")):
        assert cents[table].schema[column].dataType.typeName() == "decimal"
        assert cents[table].where(F.col(column) != F.floor(column)).count() > 0


def test_plans_that_write_nothing_agree(spark, stars):
    lazy = build_star(in_cents(raw_from_testdata(spark, SF_SMALL)))
    for name in ("kpi_mrr_movement", "kpi_arpa_by_current_plan", "kpi_monthly_mrr_growth"):
        assert sorted(map(str, round_doubles(KPIS[name](lazy)).collect())) == sorted(
            map(str, round_doubles(KPIS[name](stars[1])).collect()))
