"""CSV folders whose files differ in their headers."""

from __future__ import annotations

import datetime as dt
import gzip

import pytest

from kpiforge.schemas import ACCOUNTS
from kpiforge.sources.files import MissingInputError, read_raw_table

PLAIN = "account_id,account_name,industry,country,signup_date,referral_source,plan_tier,seats,is_trial,churn_flag\n"
TURNED = "churn_flag,note,seats,plan_tier,account_id,account_name,industry,country,signup_date,referral_source,is_trial\n"


def folder(tmp_path, files):
    for name, text in files.items():
        data = text.encode()
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return str(tmp_path)


def test_files_of_two_orders_load_right(spark, tmp_path):
    path = folder(tmp_path, {
        "a.csv": PLAIN + "A1,One,Tech,US,2023-01-05,ads,Pro,3,false,true\n",
        "b.csv": TURNED + '0,"a, note",5,Basic,A2,Two,Retail,DE,2023-02-01,,1\n1,,6,Pro,A3,Three,,DE,2023-02-02,ads,0\n',
        "c.csv": PLAIN + "A4,Four,Tech,US,2023-03-05,ads,Pro,7,0,0\n",
        "d.csv.gz": TURNED + "0,,8,Basic,A5,Five,Retail,DE,2023-02-01,,1\n",
        "e.csv": PLAIN, "f.csv": "", "_ignored.csv": "x\n1\n"})
    got = read_raw_table(spark, path, ACCOUNTS).orderBy("account_id")
    assert [(r.account_id, r.account_name, r.seats, r.plan_tier, r.is_trial, r.churn_flag) for r in got.collect()] == [
        ("A1", "One", 3, "Pro", False, True), ("A2", "Two", 5, "Basic", True, False),
        ("A3", "Three", 6, "Pro", False, True), ("A4", "Four", 7, "Pro", False, False),
        ("A5", "Five", 8, "Basic", True, False)]
    assert got.schema.fieldNames() == ACCOUNTS.fieldNames()
    assert got.first().signup_date == dt.date(2023, 1, 5)


def test_files_of_one_header_are_one_read(spark, tmp_path):
    row = "A{},One,Tech,US,2023-01-05,ads,Pro,3,false,true\n"
    path = folder(tmp_path, {f"{i}.csv": PLAIN + row.format(i) for i in range(5)})
    df = read_raw_table(spark, path, ACCOUNTS)
    assert "Union" not in df._jdf.queryExecution().analyzed().toString() and df.count() == 5


def test_a_file_that_lacks_a_column_fails(spark, tmp_path):
    path = folder(tmp_path, {"a.csv": PLAIN, "b.csv": "account_id,account_name\nA1,One\n"})
    with pytest.raises(MissingInputError, match="b.csv"):
        read_raw_table(spark, path, ACCOUNTS)


def test_a_folder_without_headers_fails(spark, tmp_path):
    with pytest.raises(MissingInputError):
        read_raw_table(spark, folder(tmp_path, {"a.csv": ""}), ACCOUNTS)


def test_columns_are_still_pruned(spark, tmp_path):
    path = folder(tmp_path, {"a.csv": PLAIN + "A1,One,Tech,US,2023-01-05,ads,Pro,3,false,true\n",
                             "b.csv": TURNED + "0,,5,Basic,A2,Two,Retail,DE,2023-02-01,,1\n"})
    text = read_raw_table(spark, path, ACCOUNTS).select("industry")._jdf.queryExecution().executedPlan().toString()
    assert text.count("ReadSchema: struct<industry:string>") == 2
