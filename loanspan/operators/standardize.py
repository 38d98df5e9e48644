"""Standardization of the raw all-text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanspan.contracts import CUTOFF_DATE
from loanspan.functions import months as M
from loanspan.functions.codes import (
    blank_to_null,
    coded_numeric,
    numeric_without_code,
    require_numeric,
    true,
)
from loanspan.functions.guards import enforce

# Not-available codes.
ORIGINATION_CODES = {
    "fico": ("9999", "smallint", "fico_not_available_flag"),
    "original_dti": ("999", "double", "dti_not_available_flag"),
    "original_ltv": ("999", "double", "ltv_not_available_flag"),
    "original_cltv": ("999", "double", "cltv_not_available_flag"),
    "vantagescore_4": ("9999", "smallint", "vantagescore_not_available_flag"),
}
CATEGORY_CODES = {"occupancy_status": "9", "property_type": "99", "loan_purpose": "9"}
BORROWER_CODE = "99"
ESTIMATED_LTV_CODE = "999"
ESTIMATED_LTV_START = 201704
SCORE_RANGE = (300, 850)
DTI_RANGE = (0, 65)


def origination_quarter() -> Column:
    """Quarter digit of the loan id."""
    return F.substring("loan_id", 5, 1).try_cast("tinyint")


def legacy_borrower_encoding(vintage: Column, quarter: Column) -> Column:
    """Vintages up to the first quarter of 2018 report borrowers as one or more than one."""
    return (vintage < 2018) | ((vintage == 2018) & (quarter <= 1))


def clean_origination(raw: DataFrame) -> DataFrame:
    """Typed origination columns; special codes become NULL with a flag, raw text is kept."""
    vintage = F.col("vintage_year").try_cast("smallint")
    quarter = origination_quarter()
    legacy = legacy_borrower_encoding(vintage, quarter)
    borrowers = F.col("number_borrowers")
    count = borrowers.try_cast("smallint")
    typed, flags, kept = [], [], []
    for name, (code, dtype, flag) in ORIGINATION_CODES.items():
        typed.append(numeric_without_code(F.col(name), code, dtype).alias(name))
        flags.append((F.col(name) == code).alias(flag))
        kept.append(F.col(name).alias(f"{name}_raw"))
    for name, code in CATEGORY_CODES.items():
        typed.append(F.when(F.col(name) != code, F.col(name)).alias(name))
        kept.append(F.col(name).alias(f"{name}_raw"))
    ltv = numeric_without_code(F.col("original_ltv"), "999", "double")
    cltv = numeric_without_code(F.col("original_cltv"), "999", "double")
    return raw.select(
        "loan_id",
        *typed,
        F.col("original_upb").try_cast("double").alias("original_upb"),
        F.col("original_interest_rate").try_cast("double").alias("original_interest_rate"),
        F.col("original_loan_term").try_cast("smallint").alias("original_loan_term"),
        "amortization_type",
        "property_state",
        vintage.alias("vintage_year"),
        "first_payment_date",
        "maturity_date",
        M.yyyymm_to_date(F.col("first_payment_date")).alias("first_payment_month"),
        M.yyyymm_to_date(F.col("maturity_date")).alias("maturity_month"),
        quarter.alias("origination_quarter"),
        (ltv.isNotNull() & (ltv > 100)).alias("ltv_above_100_flag"),
        (cltv.isNotNull() & (cltv > 100)).alias("cltv_above_100_flag"),
        legacy.alias("legacy_number_borrowers_encoding_flag"),
        (borrowers == BORROWER_CODE).alias("number_borrowers_not_available_flag"),
        F.when(borrowers != BORROWER_CODE, count >= 2).alias("multiple_borrowers_flag"),
        # Under the legacy encoding only "1" is an exact count.
        F.when(borrowers == BORROWER_CODE, None)
        .when(legacy, F.when(borrowers == "1", F.lit(1).cast("smallint")))
        .otherwise(count)
        .alias("number_borrowers"),
        borrowers.alias("number_borrowers_raw"),
        *flags,
        *kept,
    )


def clean_performance(raw: DataFrame) -> DataFrame:
    """Typed monthly columns; XX and RA have no delinquency number, raw text is kept."""
    status, eltv = F.col("delinquency_status"), F.col("estimated_ltv")
    period = F.col("monthly_reporting_period").try_cast("int")
    age = F.col("loan_age").try_cast("smallint")
    return raw.select(
        "loan_id",
        "monthly_reporting_period",
        period.alias("reporting_period_num"),
        M.yyyymm_to_date(F.col("monthly_reporting_period")).alias("reporting_month"),
        age.alias("loan_age"),
        F.col("remaining_months_maturity").try_cast("smallint").alias("remaining_months_maturity"),
        F.col("current_actual_upb").try_cast("double").alias("current_actual_upb"),
        F.col("current_interest_rate").try_cast("double").alias("current_interest_rate"),
        F.col("current_interest_bearing_upb")
        .try_cast("double")
        .alias("current_interest_bearing_upb"),
        status.try_cast("smallint").alias("delinquency_num"),
        (status == "XX").alias("is_xx"),
        (status == "RA").alias("is_ra"),
        status.alias("delinquency_status_raw"),
        numeric_without_code(eltv, ESTIMATED_LTV_CODE, "double").alias("estimated_ltv"),
        (eltv == ESTIMATED_LTV_CODE).alias("estimated_ltv_not_available_flag"),
        eltv.alias("estimated_ltv_raw"),
        "modification_flag",
        "zero_balance_code",
        "zero_balance_effective_date",
        M.yyyymm_to_date(F.col("zero_balance_effective_date")).alias(
            "zero_balance_effective_month"
        ),
        "ddlpi",
        M.yyyymm_to_date(F.col("ddlpi")).alias("ddlpi_month"),
        "payment_deferral_flag",
        "delinquency_due_to_disaster",
        "borrower_assistance_plan",
        F.col("vintage_year").try_cast("smallint").alias("vintage_year"),
        (age == 0).alias("is_loan_age_zero"),
        (period < ESTIMATED_LTV_START).alias("estimated_ltv_pre_201704_flag"),
        F.col("zero_balance_code").isNotNull().alias("has_zero_balance_event"),
    )


def trim_text(df: DataFrame) -> DataFrame:
    """Trim every string column except the raw ones; blanks become NULL."""
    return df.select(
        [
            blank_to_null(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) and not f.name.endswith("_raw")
            else F.col(f.name)
            for f in df.schema
        ]
    )


def standardize_origination(clean: DataFrame) -> DataFrame:
    """Final origination table: range checks, strict dates, origin proxy and review flags."""
    df = trim_text(clean)
    df = require_numeric(df, F.col("fico_raw"), "9999", "smallint", "fico")
    df = require_numeric(df, F.col("original_dti_raw"), "999", "double", "original_dti")
    months = ["first_payment_date", "maturity_date"]
    df = M.require_months(df, {name: F.col(name) for name in months})
    score = coded_numeric(F.col("fico_raw"), "9999", "smallint")
    dti = coded_numeric(F.col("original_dti_raw"), "999", "double")
    score_ok, dti_ok = score.between(*SCORE_RANGE), dti.between(*DTI_RANGE)
    first = M.yyyymm_to_date(F.col("first_payment_date"))
    maturity = M.yyyymm_to_date(F.col("maturity_date"))
    origin = F.add_months(first, -1)
    year = F.year(origin)
    return df.withColumns(
        {
            "first_payment_date_raw": F.col("first_payment_date"),
            "maturity_date_raw": F.col("maturity_date"),
            "fico": F.when(score_ok, score),
            "credit_score": F.when(score_ok, score),
            "original_dti": F.when(dti_ok, dti),
            "qc_credit_score_out_of_range": true(score.isNotNull() & ~score_ok),
            "qc_dti_out_of_range": true(dti.isNotNull() & ~dti_ok),
            "first_payment_date": first,
            "maturity_date": maturity,
            "first_payment_month": first,
            "maturity_month": maturity,
            "origination_vintage": F.col("vintage_year"),
            "operational_origination_date": origin,
            "operational_origination_year": year,
            "qc_proxy_year_differs_from_vintage": true(year != F.col("vintage_year")),
            "qc_original_upb_nonpositive": true(F.col("original_upb") <= 0),
            "qc_original_term_nonpositive": true(F.col("original_loan_term") <= 0),
        }
    )


def standardize_performance(clean: DataFrame) -> DataFrame:
    """Final performance table up to the cutoff; a missing reporting month fails the query."""
    df = trim_text(clean)
    months = ["monthly_reporting_period", "zero_balance_effective_date"]
    df = M.require_months(df, {name: F.col(name) for name in months})
    present = M.yyyymm_to_date(F.col("monthly_reporting_period"))
    in_time = present <= F.lit(CUTOFF_DATE).cast("date")
    df = enforce(df, present.isNotNull(), F.lit("performance_month is missing"), keep=in_time)
    return df.withColumns(
        {
            "zero_balance_effective_date_raw": F.col("zero_balance_effective_date"),
            "performance_month": present,
            "zero_balance_effective_date": M.yyyymm_to_date(F.col("zero_balance_effective_date")),
            "source_loan_age": F.col("loan_age"),
            "current_delinquency_status": blank_to_null(F.col("delinquency_status_raw")),
            "qc_current_upb_negative": true(F.col("current_actual_upb") < 0),
        }
    )
