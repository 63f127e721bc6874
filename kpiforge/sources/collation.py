"""Text keys compared without regard to case and trailing blanks (off by default).

The source's database compares text by a collation: 'Pro', 'PRO' and 'pro ' are one
plan, 'A1' and 'a1' one account. Spark compares bytes. With a collation, the spellings
that are equal under it are found with Spark's collated string type, and all are
replaced by one of them, the smallest in bytes, in every table that holds the key.
Everything behind works on plain strings as before; data without variants is unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.operators.quantiles import union_all
from kpiforge.plans.star import RawTables

DEFAULT = "UTF8_LCASE_RTRIM"  # case and trailing blanks do not matter, accents do

# Keys and names that are compared, with every place that holds them.
FAMILIES = (
    (("accounts", "account_id"), ("subscriptions", "account_id"), ("support_tickets", "account_id"),
     ("churn_events", "account_id")),
    (("subscriptions", "subscription_id"), ("feature_usage", "subscription_id")),
    (("accounts", "plan_tier"), ("subscriptions", "plan_tier")),
    (("accounts", "industry"),), (("accounts", "referral_source"),), (("churn_events", "reason_code"),),
    (("feature_usage", "usage_id"),), (("feature_usage", "feature_name"),), (("support_tickets", "ticket_id"),),
    (("support_tickets", "priority"),), (("churn_events", "churn_event_id"),),
)


def spellings(columns: list[DataFrame], collation: str) -> DataFrame:
    """(spelling, canonical) of the values that have a smaller spelling under the collation.

    Only distinct values are compared, and only those with another spelling are
    returned; ``columns`` have one string column each.
    """
    values = union_all([c.toDF("spelling") for c in columns]).where("spelling IS NOT NULL").distinct()
    key = F.collate("spelling", collation)
    groups = values.groupBy(key.alias("key")).agg(F.min("spelling").alias("canonical"), F.count(F.lit(1)).alias("n"))
    varied = groups.where("n > 1").select("key", "canonical")
    return (values.withColumn("key", key).join(varied, "key").where("spelling <> canonical")
            .select("spelling", "canonical"))


def respelled(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``df`` with canonical spellings; the mapping holds variants only, so it is usually small enough to be sent."""
    both = df.join(mapping.select(F.col("spelling").alias("__spelling"), F.col("canonical").alias("__canonical")),
                   F.col(column) == F.col("__spelling"), "left")
    return both.withColumn(column, F.coalesce("__canonical", column)).select(*df.columns)


def with_collation(raw: RawTables, collation: str = DEFAULT) -> RawTables:
    """The raw tables with one spelling for every key and name that is equal under ``collation``."""
    tables = raw.as_dict()
    for family in FAMILIES:
        mapping = spellings([tables[t].select(c) for t, c in family], collation)
        for table, column in family:
            tables[table] = respelled(tables[table], column, mapping)
    return RawTables(**tables)
