"""Cox proportional-hazards models: baseline, cause-specific and time-varying."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.contracts import (
    CORE_PREDICTORS,
    COX_DIAGNOSTICS,
    COX_INPUT,
    COX_RESULT,
    EVENT_TYPES,
    TV_DIAGNOSTICS,
    TV_PREDICTORS,
    ContractError,
    confidence,
    merge_rows,
    require_columns,
    require_schema,
    require_types,
    require_zero,
    small_frame,
    violations,
)
from loanspan.functions.codes import all_of, is_finite
from loanspan.functions.durable import durable
from loanspan.functions.stats import normal_quantile, two_sided_p
from loanspan.operators.concordance import concordance_index
from loanspan.operators.dataset import valid_time
from loanspan.operators.riskset import (
    Fit,
    Scaling,
    linear_score,
    newton,
    raw_units,
    run_fits,
    scale,
    standardized,
)

RANK_TOLERANCE = 1e-10
TV_PENALTY = 0.1


@dataclass
class CoxModel:
    """A fitted model: result tables plus what later operators reuse."""

    coefficients: DataFrame
    diagnostics: DataFrame
    names: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    fit: Fit
    scaling: Scaling
    code: int


def complete_predictors(names: list[str]) -> Column:
    return all_of(is_finite(F.col(name)) for name in names)


def check_cox_input(frame: DataFrame) -> DataFrame:
    """Violations of the complete-case one-row-per-loan input, with its event count."""
    require_types(frame, COX_INPUT, "Cox input")
    flag = (F.col("event_type") == "DEFAULT").cast("tinyint")
    return frame.agg(
        F.count("*").alias("rows"),
        F.sum("default_event").alias("events"),
        (F.count("loan_id") - F.count_distinct("loan_id")).alias("duplicate_loans"),
        *violations(
            missing_loan_id=F.col("loan_id").isNull(),
            invalid_event=~(
                F.col("event_type").isin(EVENT_TYPES) & (F.col("default_event") == flag)
            ),
            invalid_time=~valid_time(),
            incomplete_predictors=~complete_predictors(CORE_PREDICTORS),
        ),
    )


def check_paired_input(frame: DataFrame) -> DataFrame:
    """`check_cox_input` plus the prepayment flag, exclusive with default."""
    require_columns(frame, ["prepayment_event"], "Cause-specific input")
    flag = (F.col("event_type") == "PREPAYMENT").cast("tinyint")
    paired = frame.agg(
        F.sum("prepayment_event").alias("prepayment_events"),
        *violations(
            invalid_prepayment=(F.col("prepayment_event") != flag)
            | (F.col("default_event") + F.col("prepayment_event") > 1)
        ),
    )
    return merge_rows(check_cox_input(frame), paired)


def require_both_outcomes(events: int, rows: int, label: str) -> None:
    if not events or events == rows:
        raise ContractError(f"{label} must contain both events and other rows.")


def coefficient_rows(model_type, endpoint, names, beta, se, level) -> list[tuple]:
    """Result rows in the order of the coefficient schemas."""
    z = normal_quantile(0.5 + level / 2)
    rows = []
    for name, b, s in zip(names, beta, se):
        stat = b / s
        rows.append(
            (
                model_type,
                endpoint,
                name,
                float(b),
                math.exp(b),
                float(s),
                math.exp(b - z * s),
                math.exp(b + z * s),
                two_sided_p(stat),
                float(stat),
            )
        )
    if not all(math.isfinite(v) for row in rows for v in row[3:]):
        raise ContractError(f"{model_type} produced non-finite estimates.")
    return rows


def convergence(fit: Fit) -> tuple[str, str]:
    if fit.converged:
        return "PASS", ""
    return "WARNING", f"Newton steps stopped after {fit.iterations} iterations."


def _score_counts(table: DataFrame) -> dict:
    return (
        table.agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("entry") > 0).alias("delayed"),
        )
        .first()
        .asDict()
    )


def _fit_static(frame, code_column: Column, specs, level, with_concordance) -> list[CoxModel]:
    """Fit one model per (model_type, endpoint, code) on identical rows with shared scans."""
    spark = frame.sparkSession
    scaling = scale(frame, CORE_PREDICTORS)
    keep = [
        F.col("entry_time_month").alias("entry"),
        F.col("exit_time_month").alias("exit"),
        code_column.cast("int").alias("code"),
    ]
    models = []
    with durable(standardized(frame, scaling, keep)) as table:
        fits = run_fits(table, [newton(len(CORE_PREDICTORS), code) for _, _, code in specs])
        counts = _score_counts(table)
        for (model_type, endpoint, code), fit in zip(specs, fits):
            beta, cov = raw_units(fit, scaling)
            events = int(fit.sums.count(code).sum())
            index = None
            if with_concordance:
                index = concordance_index(
                    table,
                    linear_score(fit.beta),
                    F.col("exit"),
                    F.col("code") == code,
                    fit.sums.months - 1,
                )
            status, warning = convergence(fit)
            p = len(CORE_PREDICTORS)
            diagnostics = (
                model_type,
                endpoint,
                counts["rows"],
                events,
                counts["rows"] - events,
                p,
                counts["delayed"],
                fit.loglik,
                -2 * fit.loglik + 2 * p,
                index,
                status,
                warning,
            )
            rows = coefficient_rows(
                model_type, endpoint, CORE_PREDICTORS, beta, np.sqrt(np.diag(cov)), level
            )
            models.append(
                CoxModel(
                    small_frame(spark, rows, COX_RESULT),
                    small_frame(spark, [diagnostics], COX_DIAGNOSTICS),
                    CORE_PREDICTORS,
                    beta,
                    cov,
                    fit,
                    scaling,
                    code,
                )
            )
    return models


def fit_cox(
    frame: DataFrame,
    confidence_level: float = 0.95,
    validate: bool = True,
    with_concordance: bool = True,
) -> CoxModel:
    """Baseline default model: five predictors, delayed entry, Efron ties, no penalty.

    Limits are for hazard ratios. Concordance ignores entry times.
    """
    level = confidence(confidence_level)
    if validate:
        row = require_zero(check_cox_input(frame), "Cox input", ["rows", "events"])
        require_both_outcomes(row["events"], row["rows"], "Cox input")
    spec = [("cox_ph", "default", 1)]
    return _fit_static(frame, F.col("default_event"), spec, level, with_concordance)[0]


def fit_cause_specific(
    frame: DataFrame,
    causes=("DEFAULT", "PREPAYMENT"),
    confidence_level: float = 0.95,
    validate: bool = True,
    with_concordance: bool = True,
) -> dict[str, CoxModel]:
    """Cause-specific models; the other cause is censored at its own month."""
    codes = {"DEFAULT": 1, "PREPAYMENT": 2}
    unknown = [c for c in causes if c not in codes]
    if unknown:
        raise ContractError(f"Unknown cause {unknown}; expected one of {list(codes)}.")
    level = confidence(confidence_level)
    if validate:
        row = require_zero(
            check_paired_input(frame), "Cause-specific input", ["rows", "events", "prepayment_events"]
        )
        for name in ("events", "prepayment_events"):
            require_both_outcomes(row[name], row["rows"], "Cause-specific input")
    code = F.col("default_event").cast("int") + 2 * F.col("prepayment_event").cast("int")
    specs = [("CAUSE_SPECIFIC_COX", cause, codes[cause]) for cause in causes]
    return dict(zip(causes, _fit_static(frame, code, specs, level, with_concordance)))


def fit_time_varying(
    intervals: DataFrame,
    confidence_level: float = 0.95,
    penalty: float = TV_PENALTY,
    penalty_per_row: bool = True,
    names: list[str] | None = None,
) -> CoxModel:
    """Time-varying default model on start-stop intervals with a ridge penalty.

    The penalty is (penalty / 2) * sum of squared standardized coefficients, times the number of
    intervals when `penalty_per_row` is set. The variance is the inverse of the penalized
    information and the log-likelihood is the penalized one.
    """
    level = confidence(confidence_level)
    names = list(names or TV_PREDICTORS)
    spark = intervals.sparkSession
    scaling = scale(intervals, names)
    counts = time_varying_counts(intervals).first().asDict()
    require_both_outcomes(counts["n_events"], counts["n_loans"], "Time-varying Cox input")
    keep = [
        F.col("start_time_month").alias("entry"),
        F.col("stop_time_month").alias("exit"),
        F.col("default_event").cast("int").alias("code"),
    ]
    weight = penalty * (scaling.rows if penalty_per_row else 1)
    with durable(standardized(intervals, scaling, keep)) as table:
        fit = run_fits(table, [newton(len(names), 1, penalty=weight)])[0]
    beta, cov = raw_units(fit, scaling)
    status, warning = convergence(fit)
    diagnostics = (
        "time_varying_cox",
        "default",
        counts["n_intervals"],
        counts["n_loans"],
        counts["n_events"],
        counts["n_loans"] - counts["n_events"],
        len(names),
        counts["n_delayed_entry_loans"],
        counts["n_gap_intervals"],
        counts["max_interval_length_months"],
        penalty,
        "model_based",
        fit.loglik,
        -2 * fit.loglik + 2 * len(names),
        status,
        warning,
    )
    rows = coefficient_rows(
        "time_varying_cox", "default", names, beta, np.sqrt(np.diag(cov)), level
    )
    return CoxModel(
        small_frame(spark, rows, COX_RESULT),
        small_frame(spark, [diagnostics], TV_DIAGNOSTICS),
        names,
        beta,
        cov,
        fit,
        scaling,
        1,
    )


def time_varying_counts(intervals: DataFrame) -> DataFrame:
    """Intervals, loans, events, gaps, longest interval and delayed-entry loans."""
    per_loan = intervals.groupBy("loan_id").agg(
        F.count("*").alias("rows"),
        F.sum(F.col("default_event").cast("int")).alias("events"),
        F.count_if("gap_interval_flag").alias("gaps"),
        F.max("interval_length_months").alias("longest"),
        F.min("start_time_month").alias("first_start"),
    )
    return per_loan.agg(
        F.sum("rows").alias("n_intervals"),
        F.count("*").alias("n_loans"),
        F.sum("events").alias("n_events"),
        F.count_if(F.col("first_start") > 0).alias("n_delayed_entry_loans"),
        F.sum("gaps").alias("n_gap_intervals"),
        F.max("longest").alias("max_interval_length_months"),
    )


def predictor_support(intervals: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Per predictor: nulls, non-finite values, distinct values, spread and range.

    One pass computes all predictors; the wide row is then unpivoted.
    """
    names = list(names or TV_PREDICTORS)
    aggs = []
    for name in names:
        x = F.col(name).cast("double")
        aggs.append(
            F.struct(
                F.lit(name).alias("predictor"),
                F.count_if(x.isNull()).alias("null_count"),
                F.count_if(x.isNotNull() & ~is_finite(x)).alias("nonfinite_count"),
                F.stddev_samp(x).alias("sample_standard_deviation"),
                F.min(x).alias("minimum"),
                F.max(x).alias("maximum"),
            ).alias(name)
        )
    wide = intervals.agg(*aggs).select(F.explode(F.array(*names)).alias("s")).select("s.*")
    # Values travel with a small number instead of the name; NULL counts as one value.
    value = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).cast("tinyint").alias("i"), F.col(n).cast("double").alias("x")
                )
                for i, n in enumerate(names)
            ]
        )
    ).alias("v")
    unique = (
        intervals.select(value)
        .groupBy("v.i", "v.x")
        .agg(F.first(F.lit(1)).alias("seen"))
        .groupBy("i")
        .agg(F.count("*").alias("unique_value_count"))
        .select(
            F.element_at(F.array(*[F.lit(n) for n in names]), F.col("i") + 1).alias("predictor"),
            "unique_value_count",
        )
    )
    return wide.join(unique, "predictor").withColumn(
        "all_finite", (F.col("null_count") + F.col("nonfinite_count")) == 0
    )


def binary_support(intervals: DataFrame) -> DataFrame:
    """Positive counts of the delinquency indicators, overall and on terminal defaults."""
    terminal = F.col("terminal_interval_flag") & (F.col("default_event") == 1)
    names = TV_PREDICTORS[-2:]
    stats = [
        F.struct(
            F.lit(n).alias("predictor"),
            F.sum(F.col(n).cast("int")).alias("positive_count_overall"),
            F.sum(F.when(terminal, F.col(n).cast("int")).otherwise(0)).alias(
                "positive_count_default_terminal_intervals"
            ),
        ).alias(n)
        for n in names
    ]
    return intervals.agg(*stats).select(F.explode(F.array(*names)).alias("s")).select("s.*")


def interval_integrity(intervals: DataFrame) -> DataFrame:
    """Row, width and key counts with a PASS / FAILED status."""
    start, stop = F.col("start_time_month"), F.col("stop_time_month")
    terminal = F.col("terminal_interval_flag") & (F.col("default_event") == 1)
    stats = intervals.agg(
        F.count("*").alias("row_count"),
        F.count_if(start < 0).alias("negative_start_count"),
        F.count_if(stop == start).alias("zero_width_count"),
        F.count_if(stop < start).alias("negative_width_count"),
        F.count_distinct("loan_id", "start_time_month", "stop_time_month").alias(
            "unique_interval_key_count"
        ),
        F.count_if(terminal).alias("terminal_default_event_count"),
    ).withColumn(
        "duplicate_interval_key_count", F.col("row_count") - F.col("unique_interval_key_count")
    )
    bad = (
        F.col("negative_start_count")
        + F.col("zero_width_count")
        + F.col("negative_width_count")
        + F.col("duplicate_interval_key_count")
    )
    return stats.withColumn("status", F.when(bad == 0, "PASS").otherwise("FAILED"))


def information_rank(intervals: DataFrame, names: list[str] | None = None) -> dict:
    """Rank of the information matrix at zero coefficients, from one scan.

    Sums over partitions are rounded, so singular values below RANK_TOLERANCE of the largest one
    count as zero.
    """
    names = list(names or TV_PREDICTORS)
    scaling = scale(intervals, names)
    keep = [
        F.col("start_time_month").alias("entry"),
        F.col("stop_time_month").alias("exit"),
        F.col("default_event").cast("int").alias("code"),
    ]
    first = newton(len(names), 1, max_steps=0)
    fit = run_fits(standardized(intervals, scaling, keep), [first])[0]
    gradient = sum((m.residual for m in fit.months), np.zeros(len(names)))
    return {
        "initial_information_matrix_rank": int(
            np.linalg.matrix_rank(
                fit.information, tol=RANK_TOLERANCE * np.linalg.norm(fit.information, 2)
            )
        ),
        "initial_information_matrix_dimension": len(names),
        "initial_information_matrix_all_finite": bool(np.isfinite(fit.information).all()),
        "initial_gradient_all_finite": bool(np.isfinite(gradient).all()),
    }


def check_coefficients(result: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Identity, finiteness and limit order of a coefficient table."""
    require_schema(result, COX_RESULT, "Coefficient table")
    names = list(names or CORE_PREDICTORS)
    hr = F.col("hazard_ratio")
    numeric = COX_RESULT.names[3:]
    valid = (
        all_of(is_finite(F.col(n)) for n in numeric)
        & (hr > 0)
        & (F.col("ci_lower") > 0)
        & (F.col("ci_lower") <= hr)
        & (hr <= F.col("ci_upper"))
        & F.col("p_value").between(0, 1)
        & (F.col("standard_error") > 0)
    )
    return result.agg(
        F.abs(F.count("*") - len(names)).alias("wrong_row_count"),
        (F.lit(len(names)) - F.count_distinct(F.when(F.col("variable").isin(names), F.col("variable"))))
        .alias("missing_predictors"),
        *violations(invalid_estimates=~valid),
    )


def check_diagnostics(result: DataFrame, n_predictors: int = len(CORE_PREDICTORS)) -> DataFrame:
    """Counts and status of a diagnostics table."""
    require_schema(result, COX_DIAGNOSTICS, "Diagnostics table")
    status = F.col("convergence_status")
    return result.agg(
        F.abs(F.count("*") - 1).alias("wrong_row_count"),
        *violations(
            inconsistent_counts=F.col("n_events") + F.col("n_censored") != F.col("n_observations"),
            wrong_predictors=F.col("n_predictors") != n_predictors,
            invalid_status=~status.isin("PASS", "WARNING")
            | ((status == "PASS") & (F.col("convergence_warning") != "")),
            nonfinite=~(is_finite(F.col("log_likelihood")) & is_finite(F.col("partial_aic"))),
        ),
    )
