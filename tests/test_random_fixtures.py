"""Random raw tables full of NULLs, duplicates, ties and dangling keys.

Every result set of the Spark build must equal the DuckDB oracle's literal
SQL over the very same raw tables. Keys that the source declares primary
(account, subscription, ticket, churn event) stay unique; everything else
is fair game.
"""

import datetime as dt
import random
import tempfile

import duckdb
import pytest

from compare import compare
from kpiforge import oracle
from kpiforge.functions.columns import round_doubles
from kpiforge.plans.kpis import CHECKS, KPIS
from kpiforge.plans.star import STAR_TABLES, RawTables, build_star
from kpiforge.plans.warehouse import materialize_star
from kpiforge.schemas import raw_schemas

D0 = dt.date(2022, 11, 20)


def _maybe(rnd, p, value):
    return None if rnd.random() < p else value


def _date(rnd, lo=0, hi=600):
    return D0 + dt.timedelta(days=rnd.randrange(lo, hi))


def random_raw(spark, seed: int) -> dict:
    rnd = random.Random(seed)
    names = ["Tech", "Retail", "tech", "Health"]
    plans = ["Basic", "Pro", "Enterprise", "pro"]
    accounts = [(f"A{i}", f"n{i}", _maybe(rnd, .15, rnd.choice(names)), "N1", _maybe(rnd, .05, _date(rnd)),
                 _maybe(rnd, .2, rnd.choice(["ads", "event", "partner"])), _maybe(rnd, .1, rnd.choice(plans)),
                 rnd.randrange(1, 20), _maybe(rnd, .05, rnd.random() < .3),
                 _maybe(rnd, .05, rnd.random() < .3)) for i in range(40)]
    acc_ids = [f"A{i}" for i in range(45)] + [None]          # some unknown, some NULL
    subs = []
    for i in range(220):
        s = _maybe(rnd, .03, _date(rnd))
        e = None if rnd.random() < .35 or s is None else s + dt.timedelta(days=rnd.randrange(-10, 300))
        if rnd.random() < .1 and subs:                       # same-day starts (ties)
            s = subs[-1][2]
        mrr = _maybe(rnd, .05, rnd.randrange(0, 500))
        subs.append((f"S{i}", rnd.choice(acc_ids), s, e, _maybe(rnd, .1, rnd.choice(plans)),
                     rnd.randrange(1, 9), mrr, None if mrr is None else mrr * 12,
                     _maybe(rnd, .05, rnd.random() < .3), _maybe(rnd, .05, rnd.random() < .2),
                     _maybe(rnd, .05, rnd.random() < .2), _maybe(rnd, .05, rnd.random() < .3),
                     "monthly", True))
    sub_ids = [f"S{i}" for i in range(230)] + [None]
    usage = []
    for i in range(400):
        uid = f"U{rnd.randrange(0, 250)}" if rnd.random() < .97 else None
        usage.append((uid, rnd.choice(sub_ids), _maybe(rnd, .03, _date(rnd)),
                      _maybe(rnd, .05, f"f{rnd.randrange(0, 12)}"), _maybe(rnd, .03, rnd.randrange(0, 9)),
                      rnd.randrange(0, 99), _maybe(rnd, .03, rnd.randrange(0, 3)),
                      _maybe(rnd, .03, rnd.random() < .2)))
    tickets = []
    for i in range(150):
        sub_at = _maybe(rnd, .03, dt.datetime.combine(_date(rnd), dt.time(rnd.randrange(24))))
        closed = None if sub_at is None or rnd.random() < .2 else sub_at + dt.timedelta(hours=rnd.randrange(1, 900))
        tickets.append((f"T{i}", rnd.choice(acc_ids), sub_at, closed, _maybe(rnd, .05, rnd.random() * 50),
                        _maybe(rnd, .05, rnd.choice(["urgent", "high", "medium", "low", "other"])),
                        _maybe(rnd, .05, rnd.randrange(0, 120)), _maybe(rnd, .4, rnd.randrange(1, 6)),
                        _maybe(rnd, .05, rnd.random() < .15)))
    churn = []
    for i in range(60):
        churn.append((f"C{i}", rnd.choice(acc_ids[:20] + [None]), _maybe(rnd, .03, _date(rnd, 100, 700)),
                      _maybe(rnd, .2, rnd.choice(["budget", "pricing", "support", "Budget"])),
                      _maybe(rnd, .05, rnd.randrange(0, 90)), _maybe(rnd, .05, rnd.random() < .3),
                      _maybe(rnd, .05, rnd.random() < .3), rnd.random() < .1, None))
    data = dict(accounts=accounts, subscriptions=subs, feature_usage=usage, support_tickets=tickets,
                churn_events=churn)
    schemas = raw_schemas(exact_int_money=True)
    return {n: spark.createDataFrame(rows, schemas[n]) for n, rows in data.items()}


NAMES = list(STAR_TABLES) + list(CHECKS) + list(KPIS)


@pytest.fixture(scope="module", params=[11, 12, 13])
def case(request, spark):
    frames = random_raw(spark, request.param)
    root = tempfile.mkdtemp(prefix=f"rand{request.param}-")
    con = duckdb.connect()
    staged = {}
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/raw/{name}")
        staged[name] = spark.read.parquet(f"{root}/raw/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/raw/{name}/*.parquet')")
    raw = RawTables(**staged)
    star = materialize_star(raw, f"{root}/star") if request.param == 11 else build_star(raw)
    return star, con


@pytest.mark.parametrize("name", NAMES)
def test_random_fixture_matches_oracle(case, name):
    star, con = case
    df = star[name] if name in STAR_TABLES else (KPIS.get(name) or CHECKS[name])(star)
    ok, msg = compare(round_doubles(df), con, oracle.statement(name, from_raw_tables=True))
    assert ok, msg
