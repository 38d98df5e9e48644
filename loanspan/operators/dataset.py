"""Loan-level model tables and their contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.contracts import (
    COMPETING_INPUT,
    CORE_PREDICTORS,
    COX_INPUT,
    CUTOFF,
    END_YEAR,
    FEATURES,
    LOAN_LEVEL,
    LOAN_MONTH,
    START_YEAR,
    STATIC_MONTHLY,
    SURVIVAL_INPUT,
    require_columns,
    require_types,
    require_zero,
    violations,
)
from loanspan.functions import months as M
from loanspan.functions.codes import all_of, any_of, is_finite, true
from loanspan.functions.guards import enforce
from loanspan.operators.clock import build_survival
from loanspan.operators.events import build_event_map, unique_rows


def complete_case() -> Column:
    return all_of(is_finite(F.col(name)) for name in CORE_PREDICTORS)


def expected_code() -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "DEFAULT", 1)
        .when(kind == "PREPAYMENT", 2)
        .when(kind == "CENSOR", 0)
        .cast("tinyint")
    )


def valid_time() -> Column:
    entry, exit_ = F.col("entry_time_month"), F.col("exit_time_month")
    return true(
        (entry >= 0) & (exit_ > entry) & (F.col("duration_months") == exit_)
    )


def build_model_dataset(
    orig: DataFrame, survival: DataFrame, start_year: int = START_YEAR, end_year: int = END_YEAR
) -> DataFrame:
    """Eligible loans of the study vintages with their origination features, one row each.

    A loan without origination row fails the query.
    """
    require_columns(orig, ["loan_id", *FEATURES], "Origination")
    population = survival.filter(
        true(F.col("survival_eligible")) & F.col("vintage_year").between(start_year, end_year)
    )
    features = unique_rows(
        orig.select("loan_id", F.lit(True).alias("_matched"), *FEATURES),
        "loan_id",
        ["_matched", *FEATURES],
        "Origination",
    )
    kind = F.col("event_type")
    joined = enforce(
        # The unique rows lie sorted by loan already: merged, they need not pass through the driver.
        population.join(features.hint("merge"), "loan_id", "left"),
        F.col("_matched"),
        F.concat(F.lit("Loan without origination row: "), F.col("loan_id")),
    )
    return (
        joined.withColumns(
            {
                "core_covariates_complete_flag": complete_case(),
                "km_default_event": (kind == "DEFAULT").cast("tinyint"),
                "km_prepayment_event": (kind == "PREPAYMENT").cast("tinyint"),
                "cr_event_code": F.col("competing_event_code").cast("tinyint"),
            }
        )
        .drop("_matched")
    )


def check_model_frame(
    frame: DataFrame, start_year: int = START_YEAR, end_year: int = END_YEAR, cutoff: int = CUTOFF
) -> DataFrame:
    """Key, scope, time and event violations, then sample counts."""
    kind = F.col("event_type")
    in_scope = F.col("vintage_year").between(start_year, end_year) & (
        F.col("event_month") <= cutoff
    )
    valid_event = (F.col("event_code") == expected_code()) & (
        F.col("event_code") == F.col("competing_event_code")
    )
    return frame.agg(
        (F.count("*") - F.count_distinct("loan_id")).alias("duplicate_loans"),
        *violations(
            missing_id=F.col("loan_id").isNull(),
            invalid_time=~valid_time(),
            outside_scope=~in_scope,
            invalid_event=~valid_event,
        ),
        F.count("*").alias("rows"),
        F.count_if("core_covariates_complete_flag").alias("complete_case"),
        F.count_if(kind == "DEFAULT").alias("default"),
        F.count_if(kind == "PREPAYMENT").alias("prepayment"),
        F.count_if(kind == "CENSOR").alias("censor"),
    )


def validate_model_frame(frame: DataFrame, **scope) -> dict:
    return require_zero(
        check_model_frame(frame, **scope),
        "Model dataset",
        ["rows", "complete_case", "default", "prepayment", "censor"],
    )


def check_loan_months(frame: DataFrame) -> DataFrame:
    """Violations of an enriched loan-month source: keys, months, static columns per loan."""
    require_types(frame, LOAN_MONTH, "Loan-month source")
    period = F.col("reporting_period_num")
    keyed = frame.withColumn(
        "_bad_month",
        F.coalesce(period != M.date_to_yyyymm(F.col("performance_month")), F.lit(True)),
    )
    # A static column varies when its minimum and maximum differ or it is NULL only in part;
    # both are cheap map-side aggregates, unlike a distinct count per column.
    varies = any_of(
        (F.col(f"_lo_{name}") != F.col(f"_hi_{name}"))
        | ((F.col(f"_nn_{name}") > 0) & (F.col(f"_nn_{name}") < F.col("_rows")))
        for name in STATIC_MONTHLY
    )
    static = []
    for name in STATIC_MONTHLY:
        static += [
            F.min(name).alias(f"_lo_{name}"),
            F.max(name).alias(f"_hi_{name}"),
            F.count(name).alias(f"_nn_{name}"),
        ]
    per_loan = keyed.groupBy("loan_id").agg(
        F.count("*").alias("_rows"),
        F.count_distinct("performance_month").alias("_months"),
        F.max(F.col("performance_month").isNull()).alias("_null_month"),
        F.count_if("_bad_month").alias("_bad"),
        *static,
    )
    return per_loan.agg(
        F.coalesce(F.sum(F.when(F.col("loan_id").isNull(), F.col("_rows"))), F.lit(0)).alias(
            "missing_loan_id"
        ),
        F.coalesce(
            F.sum(F.col("_rows") - F.col("_months") - F.col("_null_month").cast("int")), F.lit(0)
        ).alias("duplicate_keys"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("invalid_reporting_month"),
        F.count_if(true(varies)).alias("loans_with_varying_static_columns"),
    )


def validate_loan_months(frame: DataFrame) -> DataFrame:
    require_zero(check_loan_months(frame), "Loan-month source")
    return frame


def check_loan_level(
    frame: DataFrame, start_year: int = START_YEAR, end_year: int = END_YEAR
) -> DataFrame:
    """Violations of the one-row-per-loan model input."""
    require_types(frame, LOAN_LEVEL, "Loan-level model input")
    code = expected_code()
    is_default = (F.col("event_type") == "DEFAULT").cast("tinyint")
    is_prepay = (F.col("event_type") == "PREPAYMENT").cast("tinyint")
    valid_event = all_of(
        [
            F.col("event_code") == code,
            F.col("competing_event_code") == code,
            F.col("cr_event_code") == code,
            F.col("default_event") == is_default,
            F.col("km_default_event") == is_default,
            F.col("prepayment_event") == is_prepay,
            F.col("km_prepayment_event") == is_prepay,
        ]
    )
    return frame.agg(
        (F.count("loan_id") - F.count_distinct("loan_id")).alias("duplicate_loans"),
        *violations(
            missing_loan_id=F.col("loan_id").isNull(),
            invalid_event=~valid_event,
            invalid_time=~valid_time(),
            outside_cohort=~F.col("vintage_year").between(start_year, end_year),
            not_survival_eligible=~F.col("survival_eligible"),
            invalid_complete_case_flag=F.col("core_covariates_complete_flag") != complete_case(),
        ),
    )


def validate_loan_level(frame: DataFrame) -> DataFrame:
    require_zero(check_loan_level(frame), "Loan-level model input")
    return frame


def build_loan_level(monthly: DataFrame, validate: bool = True) -> DataFrame:
    """Loan-month source to loan-level input.

    The source must carry `delinquency_num` and `is_ra`. With validated static columns any row of a
    loan describes its origination.
    """
    if validate:
        validate_loan_months(monthly)
    orig = monthly.groupBy("loan_id").agg(*[F.first(name).alias(name) for name in STATIC_MONTHLY])
    return build_model_dataset(orig, build_survival(build_event_map(orig, monthly)))


def survival_view(frame: DataFrame) -> DataFrame:
    return frame.select(SURVIVAL_INPUT.names)


def cox_view(frame: DataFrame) -> DataFrame:
    return frame.filter("core_covariates_complete_flag").select(COX_INPUT.names)


def competing_view(frame: DataFrame) -> DataFrame:
    return frame.select(COMPETING_INPUT.names)
