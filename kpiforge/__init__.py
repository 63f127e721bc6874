"""kpiforge: subscription-business analytics as Spark DataFrame plans.

Five raw tables (accounts, subscriptions, feature usage, support tickets,
churn events) are turned into a checked star schema, an account summary
with data-driven risk tiers, and a set of KPI result sets. Every step is a
declarative DataFrame plan; Catalyst and AQE choose the physical strategy.

Typical use::

    spark = get_session()
    raw = load_raw(spark, "<raw folder>", "csv")
    star = materialize_star(raw, "<shared folder>/star")
    kpis.kpi_monthly_mrr_growth(star).show()
"""

from kpiforge.plans import kpis
from kpiforge.plans.star import RawTables, StarSchema, build_star
from kpiforge.plans.warehouse import materialize_star, open_star, register_views, star_for
from kpiforge.session import get_session
from kpiforge.sources.files import load_raw
from kpiforge.sources.fixtures import raw_from_testdata

__all__ = ["RawTables", "StarSchema", "build_star", "get_session", "kpis", "load_raw",
           "materialize_star", "open_star", "raw_from_testdata", "register_views", "star_for"]
