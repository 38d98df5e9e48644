"""Start-stop intervals for the time-varying default model.

A value reported at month t holds over the interval after t, so the terminal month's report never
predicts the event that ends in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanspan.contracts import (
    CORE_PREDICTORS,
    DELINQUENCY_90_PLUS,
    DELINQUENCY_STATUSES,
    EVENT_TYPES,
    INTERVALS,
    LAG_COLUMNS,
    PERFORMANCE_SOURCE,
    TV_PREDICTORS,
    ContractError,
    merge_rows,
    require_columns,
    require_schema,
    require_types,
    require_zero,
    violations,
)
from loanspan.functions import months as M
from loanspan.functions.codes import all_of, any_of, is_finite, true


def check_performance_source(perf: DataFrame) -> DataFrame:
    """Violations of the monthly source: keys, months, finite values, known statuses."""
    require_types(perf, PERFORMANCE_SOURCE, "Performance source")
    month = F.col("performance_month")
    per_key = perf.groupBy("loan_id", "performance_month").agg(
        F.count("*").alias("rows"),
        *violations(
            invalid_month=F.col("reporting_period_num") != M.date_to_yyyymm(month),
            nonfinite_value=~(
                is_finite(F.col("current_actual_upb")) & is_finite(F.col("current_interest_rate"))
            ),
            invalid_delinquency=~F.col("current_delinquency_status").isin(DELINQUENCY_STATUSES),
        ),
    )
    zero = F.lit(0)
    return per_key.agg(
        F.coalesce(F.sum("rows"), zero).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("loan_id").isNull(), F.col("rows"))), zero).alias(
            "missing_loan_id"
        ),
        F.coalesce(F.sum(F.col("rows") - 1), zero).alias("duplicate_keys"),
        *[
            F.coalesce(F.sum(name), zero).alias(name)
            for name in ["invalid_month", "nonfinite_value", "invalid_delinquency"]
        ],
    )


def build_intervals(perf: DataFrame, loans: DataFrame, validate: bool = True) -> DataFrame:
    """Piecewise-constant intervals of the complete-case loans.

    The join and the window share the loan partitioning, so the monthly table shuffles once.
    """
    require_columns(
        loans,
        ["entry_time_month", "exit_time_month", "operational_origination_date", "event_type"],
        "Loan-level model input",
    )
    if validate:
        require_zero(check_performance_source(perf), "Performance source", ["rows"])
    cases = loans.filter("core_covariates_complete_flag").select(
        "loan_id",
        "vintage_year",
        M.date_month_index(F.col("operational_origination_date")).alias("origin_index"),
        "entry_time_month",
        "exit_time_month",
        "event_type",
        *CORE_PREDICTORS,
    )
    time = M.date_month_index(F.col("performance_month")) - F.col("origin_index")
    ordered = Window.partitionBy("loan_id").orderBy("start_time_month")
    status = F.col("current_delinquency_status")
    start, stop = F.col("start_time_month"), F.col("stop_time_month")
    observed = (
        perf.select(*PERFORMANCE_SOURCE.names)
        .join(cases, "loan_id")
        .withColumn("start_time_month", time.cast("int"))
        .filter(
            (start >= F.col("entry_time_month")) & (start < F.col("exit_time_month"))
        )
        .withColumn(
            "stop_time_month",
            F.coalesce(F.lead("start_time_month").over(ordered), F.col("exit_time_month")),
        )
    )

    def flag(cond):
        return true(cond).cast("tinyint")

    terminal = stop == F.col("exit_time_month")
    return observed.select(
        "loan_id",
        "vintage_year",
        F.col("performance_month").alias("covariate_month"),
        F.col("reporting_period_num").alias("source_reporting_period_num"),
        "start_time_month",
        "stop_time_month",
        (stop - start).alias("interval_length_months"),
        (stop - start > 1).alias("gap_interval_flag"),
        terminal.alias("terminal_interval_flag"),
        (terminal & (F.col("event_type") == "DEFAULT")).cast("tinyint").alias("default_event"),
        "event_type",
        *CORE_PREDICTORS,
        F.col("current_actual_upb").alias("lag_current_actual_upb"),
        F.col("current_interest_rate").alias("lag_current_interest_rate"),
        flag(status == "01").alias("lag_dq_1m"),
        flag(status == "02").alias("lag_dq_2m"),
        flag(status.isin(DELINQUENCY_90_PLUS)).alias("lag_dq_3plus"),
        flag(status == "XX").alias("lag_dq_xx"),
        flag(status == "RA").alias("lag_dq_ra"),
    )


def check_interval_coverage(intervals: DataFrame, loans: DataFrame) -> DataFrame:
    """Complete cases without an interval, and loans whose intervals miss their entry or exit."""
    cases = loans.filter("core_covariates_complete_flag").select(
        "loan_id", "entry_time_month", "exit_time_month"
    )
    spans = intervals.groupBy("loan_id").agg(
        F.min("start_time_month").alias("first_start"), F.max("stop_time_month").alias("last_stop")
    )
    joined = cases.join(spans, "loan_id", "left")
    return joined.agg(
        F.count_if(F.col("first_start").isNull()).alias("loans_without_interval"),
        F.count_if(
            (F.col("first_start") != F.col("entry_time_month"))
            | (F.col("last_stop") != F.col("exit_time_month"))
        ).alias("boundary_mismatches"),
    )


#: Months of a word of the bitmaps, and words at most.
WORD, MAX_WORDS = 64, 64


def _bit(month: Column, word: int) -> Column:
    """The month's bit, if it belongs to the word, else 0."""
    inside = F.floor(month / F.lit(WORD)) == word
    # The shift count is taken modulo 64.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (month % F.lit(WORD)).cast("int"))
    return F.when(inside, bit).otherwise(F.lit(0).cast("long"))


def _chain_broken(words: int) -> Column:
    """Whether a loan's intervals, each with start < stop, fail to make one chain without gap.

    They do if starts are distinct, stops are distinct, and the starts but the first are the stops
    but the last.
    """
    count = lambda name: sum((F.bit_count(f"{name}_{w}") for w in range(words)), F.lit(0))
    linked = [
        F.col(f"starts_{w}").bitwiseXOR(_bit(F.col("first_start"), w))
        != F.col(f"stops_{w}").bitwiseXOR(_bit(F.col("last_stop"), w))
        for w in range(words)
    ]
    return any_of([count("starts") != F.col("rows"), count("stops") != F.col("rows"), *linked])


def check_intervals(intervals: DataFrame) -> DataFrame:
    """Row, chain and terminal-event violations of an interval table.

    One hash aggregate per loan, without sort or window. Starts and stops are kept as bitmaps of
    months, which decide exactly whether the rows of a loan are disjoint and gap-free; repeated rows
    break that too. The last row's flags travel in the maximum of one packed number.
    """
    require_schema(intervals, INTERVALS, "Time-varying input")
    words = (intervals.agg(F.max("stop_time_month")).first()[0] or 0) // WORD + 1
    if words > MAX_WORDS:
        raise ContractError("The clock has too many months for the interval check.")
    start, stop = F.col("start_time_month"), F.col("stop_time_month")
    flags = [F.col(name) for name in LAG_COLUMNS[2:]]
    length = F.col("interval_length_months")
    event = F.col("default_event").cast("int")
    complete = all_of(is_finite(F.col(name)) for name in TV_PREDICTORS)
    exclusive = all_of(f.isin(0, 1) for f in flags) & (sum(flags[1:], flags[0]) <= 1)
    rules = {
        "invalid_interval": ~(
            (start >= 0)
            & (stop > start)
            & (length == stop - start)
            & (F.col("gap_interval_flag") == (length > 1))
        ),
        "incomplete_predictors": ~complete,
        "invalid_delinquency_flags": ~exclusive,
        "invalid_event_type": ~F.col("event_type").isin(EVENT_TYPES),
    }
    terminal = F.col("terminal_interval_flag").cast("int")
    per_loan = intervals.groupBy("loan_id").agg(
        F.count("*").alias("rows"),
        *violations(**rules),
        F.min("start_time_month").alias("first_start"),
        F.max("stop_time_month").alias("last_stop"),
        *[
            F.bit_or(_bit(month, w)).alias(f"{name}_{w}")
            for name, month in {"starts": start, "stops": stop}.items()
            for w in range(max(words, 1))
        ],
        F.sum(event).alias("events"),
        F.count_if("terminal_interval_flag").alias("terminals"),
        F.count_if(F.col("event_type") == "DEFAULT").alias("default_rows"),
        F.max(stop.cast("long") * 4 + terminal * 2 + event).alias("last_row"),
        *[F.min(name).alias(f"lo_{name}") for name in CORE_PREDICTORS],
        *[F.max(name).alias(f"hi_{name}") for name in CORE_PREDICTORS],
    )
    broken = _chain_broken(max(words, 1))
    expected = (F.col("default_rows") > 0).cast("int")
    bad_terminal = (
        ((F.col("default_rows") > 0) & (F.col("default_rows") < F.col("rows")))
        | (F.col("events") != expected)
        | (F.col("terminals") != 1)
        | (F.col("last_row") % 4 != 2 + expected)
    )
    zero = F.lit(0)
    return per_loan.agg(
        F.coalesce(F.sum("rows"), zero).alias("rows"),
        F.count_if(F.col("loan_id").isNull()).alias("missing_loan_id"),
        F.count_if(F.coalesce(broken, F.lit(True))).alias("noncontiguous_loans"),
        *[F.coalesce(F.sum(name), zero).alias(name) for name in rules],
        F.count_if(
            any_of(F.col(f"lo_{name}") != F.col(f"hi_{name}") for name in CORE_PREDICTORS)
        ).alias("loans_with_varying_static_predictors"),
        F.count_if(F.coalesce(bad_terminal, F.lit(True))).alias("loans_with_bad_terminal_event"),
    )


def validate_intervals(intervals: DataFrame, loans: DataFrame | None = None) -> DataFrame:
    check = check_intervals(intervals)
    if loans is not None:
        check = merge_rows(check, check_interval_coverage(intervals, loans))
    require_zero(check, "Time-varying input", ["rows"])
    return intervals
