"""A loan panel derived from the TPC-H-like `orders` table.

Each customer is a loan and each order is one raw monthly report. The rules are plain integer
arithmetic so that a SQL engine reproduces them exactly; see `loanspan.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanspan.contracts import CUTOFF
from loanspan.functions import months as M


def _pick(choice: Column, *values: str | None) -> Column:
    """values[choice] with a NULL for None."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), choice.cast("int") + 1)


def report_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw report per order, with duplicates and late rows as they come.

    `source_row` is the order key and stands for the file position.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key, okey = F.col("o_custkey"), F.col("o_orderkey")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    terminal = (status == "P") & (priority == "5-LOW")
    return orders.select(
        key.alias("loan_key"),
        okey.alias("source_row"),
        ((F.year("o_orderdate") + 21 + key % 6) * 100 + F.month("o_orderdate"))
        .cast("int")
        .alias("month"),
        F.col("o_totalprice").alias("upb"),
        F.when((status == "F") & (priority == "1-URGENT") & (okey % 3 == 0), 3)
        .when((status == "F") & (priority == "2-HIGH"), 2)
        .when((status == "F") & (priority == "3-MEDIUM"), 1)
        .otherwise(0)
        .alias("dq"),
        ((status == "O") & (priority == "1-URGENT") & (okey % 29 == 0)).alias("ra"),
        F.when(terminal & (okey % 2 == 0), "01")
        .when(terminal & (okey % 31 == 1), "02")
        .when(terminal & (okey % 31 == 3), "15")
        .alias("zb"),
    )


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (loan, month); the hash aggregate combines a hot customer's orders map-side."""
    return (
        report_feed(spark, sf_dir)
        .groupBy("loan_key", "month")
        .agg(
            F.max("dq").alias("dq"),
            F.max("ra").alias("ra"),
            # The code travels as an integer so that the aggregate keeps a primitive buffer.
            F.max(F.col("zb").cast("int")).alias("zb"),
            F.round(F.sum("upb"), 2).alias("upb"),
        )
    )


def _origin_columns(first_month: Column) -> dict[str, Column]:
    """First-payment and origin month numbers of a loan, from its first observed month."""
    key = F.col("loan_key")
    first = M.month_index(first_month)
    payment = F.when(key % 211 == 0, first + 2).otherwise(first - (key % 5).cast("int") + 1)
    return {"fp_index": payment, "origin_index": payment - 1}


def _loan_id() -> Column:
    origin = F.col("origin_index") - 1
    year = F.floor(origin / F.lit(12)).cast("int")
    quarter = F.floor((origin % 12) / F.lit(3)).cast("int") + 1
    return F.concat(
        F.lit("F"),
        F.lpad((year % 100).cast("string"), 2, "0"),
        F.lit("Q"),
        quarter.cast("string"),
        F.lpad(F.col("loan_key").cast("string"), 9, "0"),
    )


def _vintage() -> Column:
    return F.floor((F.col("origin_index") - 1) / F.lit(12)).cast("int")


def _first_months() -> tuple[Column, Column]:
    """Earliest month up to the cutoff, and of all: the first one that is there counts."""
    return F.min(F.when(F.col("month") <= CUTOFF, F.col("month"))), F.min("month")


def loans_of(months: DataFrame) -> DataFrame:
    """One row per loan key with its first payment, origin and public loan id."""
    firsts = months.groupBy("loan_key").agg(F.coalesce(*_first_months()).alias("first_month"))
    return firsts.withColumns(_origin_columns(F.col("first_month"))).select(
        "loan_key",
        "fp_index",
        "origin_index",
        _loan_id().alias("loan_id"),
        _vintage().alias("vintage"),
    )


def raw_origination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text origination table with special codes, one row per loan."""
    key = F.col("loan_key")

    def text(value: Column) -> Column:
        return value.cast("int").cast("string")

    ltv = 40 + (key * 31) % 61
    term = F.when(key % 4 == 0, 180).otherwise(360)
    tenths = 20 + key % 60
    return loans_of(report_feed(spark, sf_dir)).select(
        "loan_id",
        F.when(key % 37 == 0, "9999").otherwise(text(300 + (key * 7919) % 551)).alias("fico"),
        M.index_to_yyyymm(F.col("fp_index")).cast("string").alias("first_payment_date"),
        M.index_to_yyyymm(F.col("fp_index") + term).cast("string").alias("maturity_date"),
        F.when(key % 43 == 0, "999").otherwise(text(ltv + (key % 3) * 5)).alias("original_cltv"),
        F.when(key % 41 == 0, "999").otherwise(text(10 + (key * 19) % 51)).alias("original_dti"),
        text(50000 + (key * 137) % 450000).alias("original_upb"),
        F.when(key % 59 == 0, "999").otherwise(text(ltv)).alias("original_ltv"),
        F.concat(text(F.floor(tenths / F.lit(10))), F.lit("."), text(tenths % 10)).alias(
            "original_interest_rate"
        ),
        _pick(key % 4, "P", "I", "S", "9").alias("occupancy_status"),
        F.lit("FRM").alias("amortization_type"),
        _pick(key % 5, "CA", "TX", "NY", "FL", "WA").alias("property_state"),
        _pick(key % 7, "SF", "SF", "CO", "PU", "SF", "MH", "99").alias("property_type"),
        _pick(key % 6, "P", "C", "N", "P", "N", "9").alias("loan_purpose"),
        term.cast("string").alias("original_loan_term"),
        F.when(key % 31 == 0, "99").otherwise(text(1 + key % 3)).alias("number_borrowers"),
        F.when(key % 47 == 0, "9999").otherwise(text(305 + (key * 7919) % 541)).alias(
            "vantagescore_4"
        ),
        F.col("vintage").cast("string").alias("vintage_year"),
    )


def raw_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text monthly performance table with special codes, one row per (loan, month).

    Months after a termination code stay in on purpose.
    """
    # A loan has one row per calendar month here, so a window holds few rows, whatever its orders,
    # and the feed is aggregated once.
    loan = Window.partitionBy("loan_key")
    rows = (
        _months(spark, sf_dir)
        .filter(F.col("loan_key").isNotNull())
        .withColumn("first_month", F.coalesce(*[m.over(loan) for m in _first_months()]))
        .withColumns(_origin_columns(F.col("first_month")))
        .withColumns({"loan_id": _loan_id(), "vintage": _vintage()})
    )
    key, month = F.col("loan_key"), F.col("month")
    index = M.month_index(month)
    age = index - F.col("origin_index") + F.when((key % 53 == 0) & (month % 2 == 1), 1).otherwise(0)
    term = F.when(key % 4 == 0, 180).otherwise(360)
    tenths = 20 + key % 60
    code = F.lpad(F.col("zb").cast("string"), 2, "0")
    balance = F.col("upb").cast("decimal(18,2)").cast("string")
    missing = F.lit(None).cast("string")
    return rows.select(
        "loan_id",
        month.cast("string").alias("monthly_reporting_period"),
        balance.alias("current_actual_upb"),
        F.when(F.col("ra"), "RA")
        .when((F.col("dq") == 0) & ((key * 13 + month) % 97 == 0), "XX")
        .otherwise(F.lpad(F.col("dq").cast("string"), 2, "0"))
        .alias("delinquency_status"),
        age.cast("string").alias("loan_age"),
        F.when(key % 7 == 0, missing)
        .when((key % 19 == 0) & code.isNotNull(), "0")
        .otherwise((term - age).cast("string"))
        .alias("remaining_months_maturity"),
        F.when((key % 29 == 0) & (month % 2 == 1), "Y").alias("modification_flag"),
        code.alias("zero_balance_code"),
        F.when(code.isNotNull(), month.cast("string")).alias("zero_balance_effective_date"),
        F.concat(
            F.floor(tenths / F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string")
        ).alias("current_interest_rate"),
        M.index_to_yyyymm(index - 1).cast("string").alias("ddlpi"),
        missing.alias("payment_deferral_flag"),
        F.when(month < 201704, missing)
        .when((key + month) % 11 == 0, "999")
        .otherwise((40 + (key * 31) % 61).cast("string"))
        .alias("estimated_ltv"),
        missing.alias("delinquency_due_to_disaster"),
        missing.alias("borrower_assistance_plan"),
        balance.alias("current_interest_bearing_upb"),
        F.col("vintage").cast("string").alias("vintage_year"),
    )
