"""Single-event Kaplan-Meier curves for default with delayed entry.

`event_probability` is one minus survival; with prepayment treated as censoring it is not a
competing-risk default probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.contracts import (
    EVENT_TYPES,
    KM_RESULT,
    SURVIVAL_INPUT,
    ContractError,
    confidence,
    require_columns,
    require_schema,
    require_types,
    require_zero,
    violations,
)
from loanspan.functions.codes import any_of, is_finite
from loanspan.functions.stats import normal_quantile
from loanspan.operators.cells import GROUP, event_cells, month_table, up_to
from loanspan.operators.dataset import valid_time


def check_km_input(frame: DataFrame, group_col: str | None = None) -> DataFrame:
    """Key, event, clock and group violations."""
    require_types(frame, SURVIVAL_INPUT, "Kaplan-Meier input")
    flag = (F.col("event_type") == "DEFAULT").cast("tinyint")
    rules = {
        "missing_loan_id": F.col("loan_id").isNull(),
        "invalid_event": ~(
            F.col("event_type").isin(EVENT_TYPES) & (F.col("km_default_event") == flag)
        ),
        "invalid_time": ~valid_time(),
    }
    if group_col is not None:
        require_columns(frame, [group_col], "Kaplan-Meier input")
        rules["missing_group"] = F.col(group_col).isNull()
    return frame.agg(
        F.count("*").alias("rows"),
        (F.count("loan_id") - F.count_distinct("loan_id")).alias("duplicate_loans"),
        *violations(**rules),
    )


def log_sum(hazard: Column) -> Column:
    """Running sum of log(1 - hazard) over the months so far; -infinity once a hazard is one."""
    term = F.when(hazard >= 1, F.lit(float("-inf"))).otherwise(F.log1p(-hazard))
    return F.sum(term).over(up_to())


def fit_kaplan_meier(
    frame: DataFrame,
    group_col: str | None = None,
    confidence_level: float = 0.95,
    validate: bool = True,
) -> DataFrame:
    """Curve of each group on its own dense month grid, without extrapolation.

    Hazards use the loans with entry < t <= exit. The reported `n_at_risk` also counts the loans
    entering at t. Confidence limits are log-log Greenwood; they are one where survival is one and
    zero where it is zero.
    """
    z = normal_quantile(0.5 + confidence(confidence_level) / 2)
    if validate:
        if require_zero(check_km_input(frame, group_col), "Kaplan-Meier input", ["rows"])["rows"] == 0:
            raise ContractError("Kaplan-Meier input is empty.")
    cells = event_cells(frame, F.col("km_default_event"), group_col)
    d, n = F.col("defaults"), F.col("at_risk")
    hazard = F.when(n > 0, d / n).otherwise(F.lit(0.0))
    greenwood = F.when((d > 0) & (n > d), d / (n * (n - d))).otherwise(F.lit(0.0))
    theta = z * F.sqrt(F.col("greenwood")) / F.abs(F.col("log_s"))
    degenerate = (F.col("survival") <= 0) | (F.col("survival") >= 1)
    limit = F.when(degenerate, F.col("survival"))
    return (
        month_table(cells)
        .withColumns(
            {"log_s": log_sum(hazard), "greenwood": F.sum(greenwood).over(up_to())}
        )
        .withColumn("survival", F.exp("log_s"))
        .select(
            F.lit("kaplan_meier").alias("model_type"),
            F.lit("default").alias("endpoint"),
            *GROUP,
            F.col("t").alias("analysis_time"),
            "survival",
            limit.otherwise(F.exp(F.col("log_s") * F.exp(theta))).alias("ci_lower"),
            limit.otherwise(F.exp(F.col("log_s") * F.exp(-theta))).alias("ci_upper"),
            (1 - F.col("survival")).alias("event_probability"),
            F.col("present").alias("n_at_risk"),
            d.alias("n_events"),
            (F.col("censored") + F.col("prepays")).alias("n_censored"),
        )
    )


def check_km_results(result: DataFrame) -> DataFrame:
    require_schema(result, KM_RESULT, "Kaplan-Meier result")
    s, lo, hi = F.col("survival"), F.col("ci_lower"), F.col("ci_upper")
    valid = (
        is_finite(s)
        & s.between(0, 1)
        & lo.between(0, 1)
        & hi.between(0, 1)
        & (lo <= s)
        & (s <= hi)
        & (F.abs(F.col("event_probability") - (1 - s)) <= 1e-12)
    )
    return result.agg(
        F.count("*").alias("rows"),
        *violations(
            invalid_probability=~valid,
            null_rows=any_of(F.col(name).isNull() for name in KM_RESULT.names),
        ),
    )


def validate_km_results(result: DataFrame) -> DataFrame:
    if require_zero(check_km_results(result), "Kaplan-Meier result", ["rows"])["rows"] == 0:
        raise ContractError("Kaplan-Meier result is empty.")
    return result
