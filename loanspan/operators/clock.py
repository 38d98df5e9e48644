"""Monthly survival clock with delayed entry, and the loan-age panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanspan.contracts import CUTOFF, violations
from loanspan.functions import months as M
from loanspan.functions.codes import true

#: Neighbouring source rows that are kept together.
ORDER_CHUNK = 1 << 20


def build_survival(events: DataFrame, cutoff: int = CUTOFF) -> DataFrame:
    """Entry and exit on the clock whose month 1 is the first payment month.

    The origin is the month before the first payment, a proxy of the origination month.
    """
    origin = F.add_months(F.col("first_payment_month"), -1)
    origin_index = M.date_month_index(F.col("first_payment_month")) - 1
    entry, exit_ = F.col("entry_time_month"), F.col("exit_time_month")
    reason = (
        F.when(
            F.col("operational_origination_date").isNull() | entry.isNull() | exit_.isNull(),
            "MISSING_TIME",
        )
        .when((entry < 0) | (exit_ < 0), "NEGATIVE_AGE")
        .when(exit_ < entry, "EVENT_BEFORE_ENTRY")
        .when(exit_ == entry, "ZERO_OBSERVED_INTERVAL")
        .when(F.col("event_month") > cutoff, "AFTER_CUTOFF")
    )
    return (
        events.withColumns(
            {
                "operational_origination_date": origin,
                "entry_time_month": (
                    M.month_index(F.col("first_observed_month")) - origin_index
                ).cast("int"),
                "exit_time_month": (M.month_index(F.col("event_month")) - origin_index).cast("int"),
            }
        )
        .withColumns(
            {
                "observed_duration_months": exit_ - entry,
                "raw_duration_months": exit_,
                "survival_exclusion_reason": reason,
                "survival_eligible": reason.isNull(),
                "default_event": (F.col("event_type") == "DEFAULT").cast("tinyint"),
                "prepayment_event": (F.col("event_type") == "PREPAYMENT").cast("tinyint"),
                "competing_event_code": F.col("event_code").cast("tinyint"),
            }
        )
        .withColumn("duration_months", F.when(F.col("survival_eligible"), exit_))
    )


def check_survival(survival: DataFrame) -> DataFrame:
    """Violation counts of a survival table, then counts of the eligible sample."""
    eligible = F.col("survival_eligible")
    duration = F.col("duration_months")
    kinds = {"default": "DEFAULT", "prepayment": "PREPAYMENT", "censor": "CENSOR"}
    return survival.agg(
        (F.count("*") - F.count_distinct("loan_id")).alias("duplicate_loans"),
        *violations(
            eligible_nonpositive_duration=eligible & (duration.isNull() | (duration <= 0)),
            excluded_with_duration=~eligible & duration.isNotNull(),
            default_flag_mismatch=(F.col("default_event") == 1)
            != (F.col("event_type") == "DEFAULT"),
            prepayment_flag_mismatch=(F.col("prepayment_event") == 1)
            != (F.col("event_type") == "PREPAYMENT"),
        ),
        F.count("*").alias("loans"),
        F.count_if(eligible).alias("eligible"),
        F.count_if(~eligible).alias("excluded"),
        *[
            F.count_if(eligible & (F.col("event_type") == kind)).alias(f"eligible_{name}")
            for name, kind in kinds.items()
        ],
    )


def _steps() -> Column:
    """Months since the loan's previous reported month."""
    index = M.month_index(F.col("reporting_period_num"))
    ordered = Window.partitionBy("loan_id").orderBy("reporting_period_num")
    return index - F.lag(index).over(ordered)


def _first_reports(rows: DataFrame, clock: DataFrame, chunk: int) -> DataFrame:
    """`rows` (loan_id, reporting_period_num, row_order, ..) with `month_step` and the loan's clock.

    A loan, or one month of it, may hold a third of all reports, so rows never meet another table on
    the loan alone. Each month is cut into chunks of neighbouring rows; a chunk carries its first
    row, the first of those is the month's, and a loan has one row for each month when steps are
    taken. Step and clock come to the chunk, and with it to at most `chunk` rows in one place.
    """
    month = ["loan_id", "reporting_period_num"]
    placed = rows.withColumn("chunk", F.floor(F.col("row_order") / F.lit(chunk)))
    chunks = placed.groupBy(*month, "chunk").agg(F.min("row_order").alias("first_row"))
    firsts = chunks.groupBy(*month).agg(F.min("first_row").alias("first_row"))
    steps = firsts.withColumn("gap_from_previous", _steps())
    carried = chunks.drop("first_row").join(steps, month).join(clock, "loan_id", "left")
    step = F.when(F.col("row_order") == F.col("first_row"), F.col("gap_from_previous")).otherwise(0)
    return (
        placed.join(carried, [*month, "chunk"])
        .withColumn("month_step", step)
        .drop("chunk", "first_row", "gap_from_previous")
    )


def build_loan_age_panel(
    perf: DataFrame,
    survival: DataFrame,
    cutoff: int = CUTOFF,
    row_order: str | None = None,
    chunk: int = ORDER_CHUNK,
) -> DataFrame:
    """Loan-months with their analysis month and review flags; odd rows stay in, flagged.

    Of several reports of one month the one with the smallest `row_order` is the first, the others
    get a zero step. Without `row_order` the table must be unique per (loan, month), which the key
    check of the standardized table establishes.
    """
    origin = M.date_month_index(F.col("operational_origination_date"))
    keep = ["loan_id", "reporting_period_num", F.col("loan_age").alias("source_loan_age")]
    rows = perf.filter(F.col("reporting_period_num") <= cutoff)
    clock = survival.select(
        "loan_id",
        "vintage_year",
        "first_payment_month",
        "operational_origination_date",
        "entry_time_month",
        "exit_time_month",
        "observed_duration_months",
        "event_month",
        "event_type",
        "event_code",
        "survival_eligible",
        "survival_exclusion_reason",
    )
    if row_order is None:
        # One report per month: the window can run on the rows themselves.
        panel = rows.select(*keep).withColumn("month_step", _steps()).join(clock, "loan_id", "left")
    else:
        panel = _first_reports(rows.select(*keep, F.col(row_order).alias("row_order")), clock, chunk)
    time = F.col("analysis_time_month")
    step = F.col("month_step")
    return (
        panel.withColumns(
            {
                "performance_month": M.yyyymm_to_first_day(F.col("reporting_period_num")),
                "analysis_time_month": (
                    M.month_index(F.col("reporting_period_num")) - origin
                ).cast("int"),
            }
        )
        .withColumns(
            {
                "negative_age_flag": true(time < 0),
                "reporting_gap_flag": true(step > 1),
                "duplicate_or_order_flag": true(step <= 0),
                "after_exit_flag": true(F.col("reporting_period_num") > F.col("event_month")),
                "missing_time_flag": time.isNull()
                | F.col("entry_time_month").isNull()
                | F.col("exit_time_month").isNull(),
            }
        )
        .withColumn(
            "within_observation_window",
            true(F.col("survival_eligible"))
            & ~F.col("negative_age_flag")
            & ~F.col("duplicate_or_order_flag")
            & ~F.col("after_exit_flag")
            & ~F.col("missing_time_flag"),
        )
    )


def check_loan_age_panel(panel: DataFrame) -> DataFrame:
    """Flag sums, key checks and the PASS / PASS_WITH_WARNING / FAIL decision."""
    per_key = panel.groupBy("loan_id", "reporting_period_num").agg(
        F.count("*").alias("rows"),
        *[
            F.count_if(flag).alias(name)
            for name, flag in {
                "missing_loan_id": F.col("loan_id").isNull(),
                "negative_age_rows": F.col("negative_age_flag"),
                "reporting_gap_rows": F.col("reporting_gap_flag"),
                "order_error_rows": F.col("duplicate_or_order_flag"),
                "after_exit_rows": F.col("after_exit_flag"),
                "missing_time_rows": F.col("missing_time_flag"),
                "eligible_negative_age_rows": F.col("within_observation_window")
                & (F.col("analysis_time_month") < 0),
                "excluded_rows": F.col("survival_exclusion_reason").isNotNull(),
            }.items()
        ],
    )
    sums = [
        "missing_loan_id",
        "negative_age_rows",
        "reporting_gap_rows",
        "order_error_rows",
        "after_exit_rows",
        "missing_time_rows",
        "eligible_negative_age_rows",
        "excluded_rows",
    ]
    stats = per_key.agg(
        F.sum("rows").alias("rows"),
        F.count_distinct("loan_id").alias("loans"),
        *[F.sum(name).alias(name) for name in sums],
        F.count_if(F.col("rows") > 1).alias("duplicate_keys"),
    )
    failed = (
        (F.col("missing_loan_id") > 0)
        | (F.col("missing_time_rows") > 0)
        | (F.col("order_error_rows") > 0)
        | (F.col("duplicate_keys") > 0)
        | (F.col("eligible_negative_age_rows") > 0)
    )
    warned = (
        (F.col("negative_age_rows") > 0)
        | (F.col("reporting_gap_rows") > 0)
        | (F.col("after_exit_rows") > 0)
        | (F.col("excluded_rows") > 0)
    )
    return stats.withColumn(
        "status",
        F.when(failed, "FAIL").when(warned, "PASS_WITH_WARNING").otherwise("PASS"),
    )


def panel_exclusions(panel: DataFrame) -> DataFrame:
    """Distinct loans per exclusion reason."""
    return (
        panel.filter(F.col("survival_exclusion_reason").isNotNull())
        .groupBy("loan_id", "survival_exclusion_reason")
        .agg(F.count("*").alias("rows"))
        .groupBy("survival_exclusion_reason")
        .agg(F.count("*").alias("loans"))
    )
