"""Single-node SQL yardstick: the oracle SQL on DuckDB, build then queries.

Materializes the raw and star tables with CREATE TABLE AS, then times each
result set on them. Prints one JSON line comparable to bench.py.
"""

from __future__ import annotations

import json
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from kpiforge import oracle  # noqa: E402

RAW_NAMES = ["accounts", "subscriptions", "feature_usage", "support_tickets", "churn_events"]
STAR_NAMES = ["dim_industry", "dim_plan_tier", "dim_referral_source", "dim_reason_code",
              "dim_account", "cal_bounds", "dim_date", "fact_subscriptions", "fact_feature_usage",
              "fact_support_tickets", "fact_churn_events", "sub_agg", "ticket_agg", "usage_agg",
              "churn_agg", "summary_base", "risk_thresholds", "fact_account_summary"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    con = duckdb.connect()
    con.execute(f"SET threads = {int(os.environ.get('BENCH_CPUS', '8'))}")
    for t in ["customer", "orders", "lineitem", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    star_defs, blocks = oracle.STAR.split("\nmonths AS (")
    times = {}
    t0 = time.perf_counter()
    for n in RAW_NAMES:
        con.execute(f"CREATE TABLE {n} AS WITH {oracle.RAW} SELECT * FROM {n}")
    for n in STAR_NAMES:
        con.execute(f"CREATE TABLE {n} AS WITH {star_defs.rstrip().rstrip(',')} SELECT * FROM {n}")
    times["build_star_schema"] = time.perf_counter() - t0
    prefix = "WITH months AS (" + blocks
    queries = {**oracle.CHECK_RESULTS, **oracle.KPI_RESULTS}
    for n, body in queries.items():
        if n == "risk_thresholds":
            body = "SELECT * FROM risk_thresholds"
        sql = f"{prefix}{oracle._EXTRA.get(n, '')}\n{body}"
        t = time.perf_counter()
        con.execute(sql).fetchall()
        times[n] = time.perf_counter() - t
    print(json.dumps({"metric": "duckdb_build_plus_all_queries_sec",
                      "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()}, "sf_dir": sf_dir}))


if __name__ == "__main__":
    main()
