"""Every registered result set equals its DuckDB oracle (the driver's gate, run locally)."""

import pytest

import __spark_entry__ as E
from compare import compare, duck
from rawkit import SF_SMALL
from kpiforge import oracle
from kpiforge.plans import registry

# The optional training-data queries have tests of their own.
NAMES = list(registry.registered())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_registry_and_oracle_keys_match():
    assert set(NAMES) == set(oracle.all_statements())
    assert set(NAMES) <= set(E.queries()) and set(NAMES) <= set(E.oracle_sql()) <= set(E.queries())
    assert len(NAMES) == 36


@pytest.mark.parametrize("name", NAMES)
def test_parity_sf0001(spark, con, name):
    ok, msg = compare(E.queries()[name](spark, SF_SMALL), con, E.oracle_sql()[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["year_month", "active_accounts", "active_mrr", "arr_snapshot",
                          "prev_month_mrr", "net_new_mrr", "mrr_growth_rate_pct"]
    assert df.count() > 0
