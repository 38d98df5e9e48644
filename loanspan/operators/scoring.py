"""Batch competing-risk scoring of loan profiles, and its temporal validation.

A profile's curves are piecewise exponential: cumulative hazards are the baseline increments times
its partial hazards. The baseline holds one step per month and travels with the task, so scoring any
table is a map over Arrow batches without shuffle or join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.contracts import CORE_PREDICTORS, ContractError
from loanspan.functions.codes import true
from loanspan.operators.cox import CoxModel, fit_cause_specific

FORECAST_HORIZONS = [12, 24, 36]
TRAIN_LAST_VINTAGE = 2020
VALIDATION_VINTAGE = 2021
MIN_VALIDATION_LOANS = 1_000


@dataclass
class Hazards:
    """Baseline hazard steps of both causes and the coefficients on centered predictors."""

    months: list[int]
    default_steps: list[float]
    prepay_steps: list[float]
    default_beta: list[float]
    prepay_beta: list[float]
    centers: list[float]

    def check(self) -> "Hazards":
        steps = np.array([self.default_steps, self.prepay_steps])
        if not self.months or not np.isfinite(steps).all() or (steps < 0).any():
            raise ContractError("Baseline hazards must be finite and non-negative.")
        return self

    @property
    def max_month(self) -> int:
        """Last month supported by both causes."""
        both = [
            max((m for m, h in zip(self.months, steps) if h > 0), default=0)
            for steps in (self.default_steps, self.prepay_steps)
        ]
        return min(both)


def baseline_steps(model: CoxModel) -> dict[int, float]:
    """Breslow increments at the predictor means: deaths over the weighted risk set."""
    return {m.month: m.deaths / m.total[0] for m in model.fit.months}


def hazards_of(models: dict[str, CoxModel]) -> Hazards:
    default, prepay = models["DEFAULT"], models["PREPAYMENT"]
    steps = [baseline_steps(default), baseline_steps(prepay)]
    months = sorted(set(steps[0]) | set(steps[1]))
    return Hazards(
        months,
        [steps[0].get(m, 0.0) for m in months],
        [steps[1].get(m, 0.0) for m in months],
        default.beta.tolist(),
        prepay.beta.tolist(),
        default.scaling.mean.tolist(),
    ).check()


def partial_hazard(beta: list[float], centers: list[float], names=None) -> Column:
    score = F.lit(0.0)
    for name, b, c in zip(names or CORE_PREDICTORS, beta, centers):
        score = score + (F.col(name).cast("double") - float(c)) * float(b)
    return F.exp(score)


def _curve_kernel(hazards: Hazards, horizons: list[int]):
    """Arrow-batched kernel from partial hazards to (incidences, survival) at the horizons.

    A batch becomes a profiles-by-months matrix, so the exponentials run vectorized; folding the
    months per row with a higher-order function is several times slower because Spark interprets
    its lambda.
    """
    months = np.array(hazards.months)
    default, prepay = np.array(hazards.default_steps), np.array(hazards.prepay_steps)
    # Right-continuous: the last step at or before the horizon; before the first one nothing has
    # happened.
    last = np.searchsorted(months, horizons, side="right")

    @F.pandas_udf("default_cif array<double>, prepay_cif array<double>, survival array<double>")
    def kernel(d: pd.Series, p: pd.Series) -> pd.DataFrame:
        rate_d = np.outer(d.to_numpy(), default)
        rate_p = np.outer(p.to_numpy(), prepay)
        total = rate_d + rate_p
        cumulative = np.cumsum(total, axis=1)
        event = np.exp(total - cumulative) * -np.expm1(-total)
        share = np.divide(rate_d, total, out=np.zeros_like(total), where=total > 0)
        start = np.zeros((len(total), 1))
        paths = (
            np.hstack([start, np.cumsum(event * share, axis=1)]),
            np.hstack([start, np.cumsum(np.where(total > 0, event * (1 - share), 0.0), axis=1)]),
            np.hstack([start + 1, np.exp(-cumulative)]),
        )
        return pd.DataFrame(
            {
                name: list(path[:, last])
                for name, path in zip(("default_cif", "prepay_cif", "survival"), paths)
            }
        )

    return kernel


def score_horizons(
    profiles: DataFrame, hazards: Hazards, horizons: list[int] = FORECAST_HORIZONS
) -> DataFrame:
    """Survival and both incidences of every profile at each horizon, in long format.

    Before the first baseline step survival is 1 and both incidences are 0. No shuffle, no join.
    """
    hazards.check()
    kernel = _curve_kernel(hazards, horizons)
    scored = profiles.withColumn(
        "_curve",
        kernel(
            partial_hazard(hazards.default_beta, hazards.centers),
            partial_hazard(hazards.prepay_beta, hazards.centers),
        ),
    )
    points = F.arrays_zip(
        F.array(*[F.lit(h) for h in horizons]).alias("horizon_months"),
        F.col("_curve.default_cif").alias("default_cif"),
        F.col("_curve.prepay_cif").alias("prepay_cif"),
        F.col("_curve.survival").alias("survival"),
    )
    return scored.withColumn("_point", F.explode(points)).select(*profiles.columns, "_point.*")


def supported_horizons(scored: DataFrame, hazards: Hazards) -> DataFrame:
    """Drop horizons beyond a profile's own term or the baseline's support."""
    return scored.filter(
        (F.col("horizon_months") <= F.col("original_loan_term"))
        & (F.col("horizon_months") <= hazards.max_month)
    )


def training_ranges(frame: DataFrame) -> dict[str, tuple[float, float]]:
    row = frame.agg(
        *[F.min(F.col(n).cast("double")).alias(f"lo_{n}") for n in CORE_PREDICTORS],
        *[F.max(F.col(n).cast("double")).alias(f"hi_{n}") for n in CORE_PREDICTORS],
    ).first()
    return {
        n: (row[f"lo_{n}"], row[f"hi_{n}"]) for n in CORE_PREDICTORS if row[f"lo_{n}"] is not None
    }


def range_flags(profiles: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """`<predictor>_out_of_range` per profile."""
    return profiles.withColumns(
        {
            f"{name}_out_of_range": true(~F.col(name).cast("double").between(lo, hi))
            for name, (lo, hi) in ranges.items()
        }
    )


def validation_metrics(
    scored: DataFrame, minimum_loans: int = MIN_VALIDATION_LOANS
) -> DataFrame:
    """Multiclass Brier score, log-loss and mean predicted against observed, per horizon.

    Loans censored before a horizon are left out. `enough_loans` tells whether the eligible sample
    reaches the minimum.
    """
    h, duration = F.col("horizon_months"), F.col("duration_months")
    is_default = (F.col("event_type") == "DEFAULT") & (duration <= h)
    is_prepay = (F.col("event_type") == "PREPAYMENT") & (duration <= h)
    floor = F.lit(1e-12)

    def clipped(name):
        return F.least(F.greatest(F.col(name), floor), F.lit(1.0))

    total = F.col("c_d") + F.col("c_p") + F.col("c_s")
    eligible = (
        scored.filter((duration >= h) | is_default | is_prepay)
        .withColumns({"c_d": clipped("default_cif"), "c_p": clipped("prepay_cif"),
                      "c_s": clipped("survival")})
        .withColumns({"q_d": F.col("c_d") / total, "q_p": F.col("c_p") / total,
                      "q_s": F.col("c_s") / total})
        .withColumns({"y_d": is_default.cast("int"), "y_p": is_prepay.cast("int")})
        .withColumn("y_s", 1 - F.col("y_d") - F.col("y_p"))
    )
    squares = sum(
        ((F.col(f"q_{k}") - F.col(f"y_{k}")) * (F.col(f"q_{k}") - F.col(f"y_{k}")) for k in "dps"),
        F.lit(0.0),
    )
    chosen = (
        F.when(F.col("y_d") == 1, F.col("q_d")).when(F.col("y_p") == 1, F.col("q_p"))
        .otherwise(F.col("q_s"))
    )
    return eligible.groupBy("horizon_months").agg(
        F.count("*").alias("n_eligible"),
        F.sum("y_d").alias("observed_defaults"),
        F.sum("y_p").alias("observed_prepayments"),
        F.avg(squares).alias("multiclass_brier"),
        (-F.avg(F.log(chosen))).alias("log_loss"),
        F.avg("q_d").alias("mean_predicted_default"),
        F.avg("y_d").alias("mean_observed_default"),
        (F.count("*") >= minimum_loans).alias("enough_loans"),
    )


def temporal_validation(
    cases: DataFrame,
    train_last: int = TRAIN_LAST_VINTAGE,
    validate_on: int = VALIDATION_VINTAGE,
    minimum_loans: int = MIN_VALIDATION_LOANS,
) -> DataFrame:
    """Fit on early vintages, measure on a later one."""
    train = cases.filter(F.col("vintage_year") <= train_last)
    models = fit_cause_specific(train, with_concordance=False)
    later = cases.filter(F.col("vintage_year") == validate_on)
    return validation_metrics(score_horizons(later, hazards_of(models)), minimum_loans)
