"""The raw panel is built with one pass over the orders each."""

import pytest
from pyspark.sql import functions as F

from loanspan.functions import months as M
from loanspan.sources import order_panel

ORDER = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)


@pytest.fixture
def folder(spark, tmp_path):
    rows = [
        (k, None if k % 13 == 0 else k % 7, "FOP"[k % 3], 100.0 + k, f"{1992 + k % 5}-{1 + k % 12:02d}-03", f"{1 + k % 5}-X")
        for k in range(300)
    ]
    frame = spark.createDataFrame(rows, ORDER.replace("timestamp_ntz", "string"))
    frame.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_pass(spark, folder):
    performance = order_panel.raw_performance(spark, folder)
    assert _plan(performance).count("Relation [") == 1 and "Join" not in _plan(performance)
    origination = order_panel.raw_origination(spark, folder)
    assert _plan(origination).count("Aggregate [") == 1


def test_rows_and_loans(spark, folder):
    feed = order_panel.report_feed(spark, folder)
    found = order_panel.raw_performance(spark, folder)
    months = feed.filter("loan_key IS NOT NULL").select("loan_key", "month").distinct()
    ids = order_panel.loans_of(feed).select("loan_key", "loan_id", "vintage")
    wanted = months.join(ids, "loan_key").select(
        "loan_id", F.col("month").cast("string"), F.col("vintage").cast("string")
    )
    rows = found.select("loan_id", "monthly_reporting_period", "vintage_year").collect()
    assert sorted(rows) == sorted(wanted.collect()) and len(rows) > 100
    known = order_panel.raw_origination(spark, folder).filter("loan_id IS NOT NULL")
    assert {r["loan_id"] for r in known.collect()} == {r["loan_id"] for r in rows}


def test_month_text(spark):
    texts = ["201601", "201612", "201613", "201600", "100001", "099912", "999912", " 20161", "+20161",
             "201601\n", "2016 1", "20161", "2016010", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = frame.select(M.yyyymm_to_date(F.col("t")).cast("string").alias("d")).collect()
    good = {"201601": "2016-01-01", "201612": "2016-12-01", "100001": "1000-01-01", "999912": "9999-12-01"}
    assert [r["d"] for r in found] == [good.get(t) for t in texts]
