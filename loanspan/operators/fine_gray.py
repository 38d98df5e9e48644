"""Fine-Gray subdistribution model for default with delayed entry.

A loan that prepaid at month u stays in the risk set with weight g(t) / g(u), where g is the
product of the censoring survival and the entry distribution just before t (Geskus 2011). Within a
month events come first, then censoring, then entries. Because the weight factors, the weighted
risk sums obey K(t+1) = rho(t) (K(t) + E(t)) with E(t) the month sums of the loans prepaid at t and
rho(t) the one-month weight change: the fit scans the original loans and never expands them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanspan.contracts import (
    CORE_PREDICTORS,
    EVENT_TYPES,
    FINE_GRAY_DIAGNOSTICS,
    FINE_GRAY_RESULT,
    ContractError,
    confidence,
    require_columns,
    require_schema,
    require_zero,
    schema_of,
    small_frame,
    violations,
)
from loanspan.functions.codes import all_of, is_finite, true
from loanspan.functions.durable import durable
from loanspan.operators.cox import coefficient_rows, complete_predictors, convergence
from loanspan.operators.dataset import expected_code
from loanspan.operators.riskset import (
    MAX_MONTH_ROWS,
    Fit,
    MonthSums,
    Scaling,
    at_risk_counts,
    at_risk_sums,
    linear_score,
    newton,
    raw_units,
    run_fits,
    scale,
    standardized,
)

TARGET, COMPETING = 1, 2


@dataclass
class FineGrayModel:
    coefficients: DataFrame
    diagnostics: DataFrame
    beta: np.ndarray
    covariance: np.ndarray
    fit: Fit
    scaling: Scaling


def check_fine_gray_input(frame: DataFrame) -> DataFrame:
    """Violations of the complete-case input, with both event counts."""
    require_columns(
        frame,
        ["loan_id", "entry_time_month", "exit_time_month", "event_type", "cr_event_code"]
        + CORE_PREDICTORS,
        "Fine-Gray input",
    )
    entry, exit_ = F.col("entry_time_month"), F.col("exit_time_month")
    return frame.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("cr_event_code") == TARGET).alias("defaults"),
        F.count_if(F.col("cr_event_code") == COMPETING).alias("prepayments"),
        (F.count("loan_id") - F.count_distinct("loan_id")).alias("duplicate_loans"),
        *violations(
            missing_loan_id=F.col("loan_id").isNull(),
            invalid_event=~(
                F.col("event_type").isin(EVENT_TYPES) & (F.col("cr_event_code") == expected_code())
            ),
            invalid_time=~true((entry >= 0) & (exit_ > entry)),
            incomplete_predictors=~complete_predictors(CORE_PREDICTORS),
        ),
    )


def weight_steps(sums: MonthSums) -> np.ndarray:
    """rho(s): change of a prepaid loan's weight from month s to s + 1."""
    present = at_risk_counts(sums)
    censored = sums.count(0)
    after_events = present - sums.count(TARGET) - sums.count(COMPETING)
    after_all = present - sums.gone() + sums.entry_n
    stay = 1 - np.divide(
        censored, after_events, out=np.zeros(sums.months), where=after_events > 0
    )
    old = 1 - np.divide(sums.entry_n, after_all, out=np.zeros(sums.months), where=after_all > 0)
    prepaid = np.nonzero(sums.count(COMPETING))[0]
    if len(prepaid):
        first = prepaid[0]
        if (old[first:] <= 0).any():
            raise ContractError("All loans present after a prepayment month entered in that month.")
    return np.divide(stay, old, out=np.ones(sums.months), where=old > 0)


def subdistribution_sums(sums: MonthSums) -> np.ndarray:
    """Risk sums over loans at risk plus the weighted prepaid loans."""
    risk = at_risk_sums(sums)
    rho = weight_steps(sums)
    prepaid = sums.exit.get(COMPETING)
    if prepaid is None:
        return risk
    carried = np.zeros(risk.shape[1])
    for t in range(sums.months):
        risk[t] = risk[t] + carried
        carried = rho[t] * (carried + prepaid[t])
    return risk


def _loan_table(frame: DataFrame, scaling: Scaling) -> DataFrame:
    return standardized(
        frame,
        scaling,
        [
            F.col("entry_time_month").alias("entry"),
            F.col("exit_time_month").alias("exit"),
            F.col("cr_event_code").cast("int").alias("code"),
        ],
    )


def _residual_months(fit: Fit) -> tuple[list[tuple], list[tuple]]:
    """Month tables of the cumulative hazard terms a loan's score residual needs."""
    sums, p = fit.sums, fit.sums.p
    a = np.zeros((sums.months, 1 + p))
    dead = np.zeros((sums.months, 1 + p))
    mean = np.zeros((sums.months, p))
    for m in fit.months:
        k, d1, s1 = m.terms, m.tied[1 : 1 + p], m.total[1 : 1 + p]
        # Sums over the tied steps of 1/D and mean/D, for others and for the dying loans.
        a[m.month] = np.r_[k.inv, s1 * k.inv2 - d1 * k.inv2_f]
        dead[m.month] = np.r_[
            k.inv - k.inv_f,
            s1 * (k.inv2 - k.inv2_f) - d1 * (k.inv2_f - k.inv2_ff),
        ]
        mean[m.month] = m.mean
    cumulative = np.cumsum(a, axis=0)
    rho = weight_steps(sums)
    tail = np.zeros((sums.months + 1, 1 + p))
    for t in range(sums.months - 2, -1, -1):
        tail[t] = rho[t] * (a[t + 1] + tail[t + 1])
    entry_rows = [(int(t), *cumulative[t].tolist()) for t in range(sums.months)]
    exit_rows = []
    for t in range(sums.months):
        for code in (0, TARGET, COMPETING):
            upto = cumulative[t].copy()
            if code == TARGET:
                upto += dead[t] - a[t]
            if code == COMPETING:
                upto += tail[t]
            own = mean[t] if code == TARGET else np.zeros(p)
            exit_rows.append((int(t), code, *upto.tolist(), *own.tolist()))
    return entry_rows, exit_rows


def robust_covariance(table: DataFrame, fit: Fit) -> np.ndarray:
    """Sandwich covariance in standardized units; each loan is its own cluster.

    A loan's score residual needs its entry and exit month only, so it is two joins with month
    tables and one aggregate of products.
    """
    spark, p = table.sparkSession, fit.sums.p
    entry_rows, exit_rows = _residual_months(fit)
    entry_fields = ["entry int"] + [f"ea{i} double" for i in range(1 + p)]
    exit_fields = ["exit int", "code int"] + [f"xa{i} double" for i in range(1 + p)]
    exit_fields += [f"m{i} double" for i in range(p)]
    # A few hundred months each: broadcasting them is bounded by the clock.
    at_entry = F.broadcast(spark.createDataFrame(entry_rows, ", ".join(entry_fields)))
    at_exit = F.broadcast(spark.createDataFrame(exit_rows, ", ".join(exit_fields)))
    w, event = F.exp(linear_score(fit.beta)), (F.col("code") == TARGET).cast("double")
    base = F.col("xa0") - F.col("ea0")
    scores = table.join(at_entry, "entry").join(at_exit, ["exit", "code"]).select(
        *[
            (
                event * (F.col(f"z{i}") - F.col(f"m{i}"))
                - w * (F.col(f"z{i}") * base - (F.col(f"xa{i + 1}") - F.col(f"ea{i + 1}")))
            ).alias(f"u{i}")
            for i in range(p)
        ]
    )
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = scores.agg(
        *[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    ).first()
    meat = np.zeros((p, p))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = row[f"p{i}_{j}"]
    bread = np.linalg.inv(fit.information)
    return bread @ meat @ bread


def weight_runs(sums: MonthSums) -> list[tuple[int, int, int, float]]:
    """(prepay month, start, stop, weight) of the intervals a prepaid loan adds after its exit.

    Intervals end at default months, the only months that matter; neighbours with equal weight are
    merged.
    """
    rho = weight_steps(sums)
    events = np.nonzero(sums.count(TARGET))[0]
    runs = []
    for u in np.nonzero(sums.count(COMPETING))[0]:
        start, weight, open_run = int(u), 1.0, None
        position = int(u)
        for t in events[events > u]:
            while position < t:
                weight *= rho[position]
                position += 1
            if open_run and abs(open_run[3] - weight) <= 1e-12:
                open_run = (open_run[0], open_run[1], int(t), open_run[3])
            else:
                if open_run:
                    runs.append(open_run)
                    start = open_run[2]
                open_run = (int(u), start, int(t), float(weight))
        if open_run:
            runs.append(open_run)
    return runs


RUN_SCHEMA = schema_of("exit_time_month int, run_start int, run_stop int, run_weight double")


def expand_fine_gray(frame: DataFrame, sums: MonthSums) -> DataFrame:
    """Weighted start-stop rows: each loan's own interval, then the prepaid loans' later ones.

    For inspection and for weighted software; the fit itself does not use them.
    """
    spark = frame.sparkSession
    own = frame.select(
        "loan_id",
        F.col("entry_time_month").alias("fg_start"),
        F.col("exit_time_month").alias("fg_stop"),
        (F.col("cr_event_code") == TARGET).cast("int").alias("fg_status"),
        F.lit(1.0).alias("fg_weight"),
        F.lit(False).alias("extended"),
    )
    # One row per pair of months at most: broadcast while that stays small, else join by shuffle.
    found = weight_runs(sums)
    runs = spark.createDataFrame(found, RUN_SCHEMA)
    if len(found) <= MAX_MONTH_ROWS:
        runs = F.broadcast(runs)
    later = (
        frame.filter(F.col("cr_event_code") == COMPETING)
        .join(runs, "exit_time_month")
        .select(
            "loan_id",
            F.col("run_start").alias("fg_start"),
            F.col("run_stop").alias("fg_stop"),
            F.lit(0).alias("fg_status"),
            F.col("run_weight").alias("fg_weight"),
            F.lit(True).alias("extended"),
        )
    )
    return own.unionByName(later)


def audit_expansion(expanded: DataFrame, frame: DataFrame) -> DataFrame:
    """Row and extension counts plus violations of the expansion rules."""
    loans = frame.select("loan_id", "entry_time_month", "exit_time_month", "cr_event_code")
    joined = expanded.join(loans, "loan_id", "left")
    late = F.col("fg_stop") > F.col("exit_time_month")
    return joined.agg(
        F.count("*").alias("n_expanded_rows"),
        F.count_distinct(F.when(late, F.col("loan_id"))).alias("n_competing_extended"),
        *violations(
            invalid_interval=F.col("fg_stop") <= F.col("fg_start"),
            invalid_weight=~(is_finite(F.col("fg_weight")) & (F.col("fg_weight") >= 0)),
            invalid_status=~F.col("fg_status").isin(0, 1),
            unmapped_rows=F.col("exit_time_month").isNull(),
            lost_delayed_entry=F.col("fg_start") < F.col("entry_time_month"),
            extended_without_prepayment=late & (F.col("cr_event_code") != COMPETING),
        ),
    )


def fit_fine_gray(
    frame: DataFrame, confidence_level: float = 0.95, validate: bool = True
) -> FineGrayModel:
    """Default subdistribution hazard ratios with loan-clustered robust standard errors."""
    level = confidence(confidence_level)
    if validate:
        row = require_zero(
            check_fine_gray_input(frame), "Fine-Gray input", ["rows", "defaults", "prepayments"]
        )
        if not row["defaults"] or not row["prepayments"]:
            raise ContractError("Fine-Gray input must contain defaults and prepayments.")
    spark, p = frame.sparkSession, len(CORE_PREDICTORS)
    scaling = scale(frame, CORE_PREDICTORS)
    with durable(_loan_table(frame, scaling)) as table:
        fit = run_fits(table, [newton(p, TARGET, risk_of=subdistribution_sums)])[0]
        robust = robust_covariance(table, fit)
    beta, _ = raw_units(fit, scaling)
    covariance = robust / np.outer(scaling.std, scaling.std)
    rows = coefficient_rows(
        "FINE_GRAY", "DEFAULT", CORE_PREDICTORS, beta, np.sqrt(np.diag(covariance)), level
    )
    sums = fit.sums
    total = int(sums.gone().sum())
    runs = np.zeros(sums.months)
    for u, *_ in weight_runs(sums):
        runs[u] += 1
    status, warning = convergence(fit)
    diagnostics = (
        "FINE_GRAY",
        "DEFAULT",
        total,
        total + int(runs @ sums.count(COMPETING)),
        int(sums.count(TARGET).sum()),
        int(sums.count(COMPETING).sum()),
        int(sums.count(0).sum()),
        p,
        int(sums.entry_n[1:].sum()),
        "subject_clustered_robust_sandwich",
        status,
        warning,
    )
    return FineGrayModel(
        small_frame(spark, rows, FINE_GRAY_RESULT),
        small_frame(spark, [diagnostics], FINE_GRAY_DIAGNOSTICS),
        beta,
        covariance,
        fit,
        scaling,
    )


def check_fine_gray_results(result: DataFrame) -> DataFrame:
    require_schema(result, FINE_GRAY_RESULT, "Fine-Gray results")
    ratio = F.col("subdistribution_hazard_ratio")
    valid = (
        all_of(is_finite(F.col(n)) for n in FINE_GRAY_RESULT.names[3:])
        & (ratio > 0)
        & (F.col("ci_lower") > 0)
        & (F.col("ci_lower") <= ratio)
        & (ratio <= F.col("ci_upper"))
        & F.col("p_value").between(0, 1)
        & (F.col("standard_error") > 0)
    )
    return result.agg(
        F.abs(F.count("*") - len(CORE_PREDICTORS)).alias("wrong_row_count"),
        *violations(
            invalid_estimates=~valid,
            unknown_predictor=~F.col("variable").isin(CORE_PREDICTORS),
        ),
    )


def check_fine_gray_diagnostics(result: DataFrame) -> DataFrame:
    require_schema(result, FINE_GRAY_DIAGNOSTICS, "Fine-Gray diagnostics")
    events = F.col("n_default") + F.col("n_prepayment") + F.col("n_censored")
    status = F.col("convergence_status")
    return result.agg(
        F.abs(F.count("*") - 1).alias("wrong_row_count"),
        *violations(
            inconsistent_counts=events != F.col("n_input_loans"),
            too_few_rows=F.col("n_expanded_rows") < F.col("n_input_loans"),
            too_many_delayed=F.col("n_delayed_entry") > F.col("n_input_loans"),
            wrong_predictors=F.col("n_predictors") != len(CORE_PREDICTORS),
            invalid_status=~status.isin("PASS", "WARNING")
            | ((status == "PASS") & (F.col("convergence_warning") != "")),
        ),
    )
