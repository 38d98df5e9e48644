"""Proportional-hazards score tests and scaled Schoenfeld residuals.

The test of an added term g(t) x_j needs only the risk-set covariance V(t) and the residual sum of
every event month, which the fitted model already holds; no rows are read again for it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanspan.contracts import (
    PH_GLOBAL,
    PH_VARIABLE,
    SCHOENFELD,
    ContractError,
    conform,
    require_schema,
    small_frame,
    violations,
)
from loanspan.functions.codes import all_of, is_finite
from loanspan.functions.stats import chi2_sf
from loanspan.operators.cox import CoxModel
from loanspan.operators.riskset import at_risk_counts

ALPHA = 0.05
TRANSFORMS = ["rank", "km"]
TEST_METHOD = "score_test"
#: Hex digits of the id's digest that make a bucket.
BUCKET_DIGITS = 3


def ph_status(p_value: float, alpha: float = ALPHA) -> str:
    if not 0.0 <= p_value <= 1.0 or not 0.0 < alpha < 1.0:
        raise ContractError("p_value and alpha must be probabilities.")
    return "FLAGGED" if p_value < alpha else "PASS"


def month_transforms(model: CoxModel) -> dict[str, np.ndarray]:
    """g(t) per month: average rank of the exit month over all rows, and 1 - KM(t-).

    The Kaplan-Meier transform respects delayed entry and is left-continuous.
    """
    sums = model.fit.sums
    exits = sums.gone()
    rank = np.cumsum(exits) - exits + (exits + 1) / 2
    risk, deaths = at_risk_counts(sums), sums.count(model.code)
    hazard = np.divide(deaths, risk, out=np.zeros_like(deaths, dtype=float), where=risk > 0)
    survival = np.cumprod(1 - hazard)
    return {"rank": rank, "km": 1 - np.r_[1.0, survival[:-1]]}


def _centered(model: CoxModel, g: np.ndarray) -> np.ndarray:
    """Transform minus its mean over the events."""
    deaths = model.fit.sums.count(model.code)
    return g - float(g @ deaths) / float(deaths.sum())


def ph_tests(model: CoxModel, alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """Per-variable tests (one degree of freedom each) and the global test, per transform."""
    spark = model.coefficients.sparkSession
    p = len(model.names)
    variable_rows, global_rows = [], []
    for name, raw in month_transforms(model).items():
        g = _centered(model, raw)
        info = np.zeros((2 * p, 2 * p))
        score = np.zeros(p)
        for m in model.fit.months:
            weight = g[m.month]
            info[:p, :p] += m.information
            info[:p, p:] += weight * m.information
            info[p:, p:] += weight * weight * m.information
            score += weight * m.residual
        info[p:, :p] = info[:p, p:].T

        def statistic(added):
            keep = list(range(p)) + [p + j for j in added]
            u = np.r_[np.zeros(p), score[added]]
            return float(u @ np.linalg.solve(info[np.ix_(keep, keep)], u))

        for j, variable in enumerate(model.names):
            chi2 = statistic([j])
            pv = chi2_sf(chi2, 1)
            variable_rows.append(
                ("cox_ph", "default", variable, name, chi2, 1, pv, alpha, ph_status(pv, alpha),
                 TEST_METHOD)
            )
        chi2 = statistic(list(range(p)))
        pv = chi2_sf(chi2, p)
        global_rows.append(
            ("cox_ph", "default", name, chi2, p, pv, alpha, ph_status(pv, alpha), TEST_METHOD)
        )
    return small_frame(spark, variable_rows, PH_VARIABLE), small_frame(spark, global_rows, PH_GLOBAL)


def schoenfeld_residuals(
    model: CoxModel, frame: DataFrame, event_col: str = "default_event"
) -> DataFrame:
    """Scaled Schoenfeld residuals, one row per event, variable and transform.

    Event rows are numbered by exit month. Numbers come from counts per (month, id bucket) plus a
    row number inside the bucket, so even a month with very many events is never one task.
    """
    spark = frame.sparkSession
    p = len(model.names)
    deaths = model.fit.sums.count(model.code).sum()
    transforms = month_transforms(model)
    # Efron mean of the tied steps, back in raw units; at most a few hundred months.
    before, seen = [], 0
    for m in model.fit.months:
        before.append(seen)
        seen += m.deaths
    means = [
        (m.month, first, *(m.mean * model.scaling.std + model.scaling.mean).tolist(),
         *[float(transforms[t][m.month]) for t in TRANSFORMS])
        for m, first in zip(model.fit.months, before)
    ]
    fields = ["exit_time_month int", "month_offset bigint"] + [f"m{i} double" for i in range(p)]
    fields += [f"g_{t} double" for t in TRANSFORMS]
    month_means = spark.createDataFrame(means, ", ".join(fields))
    events = frame.filter(F.col(event_col) == 1).select(
        "loan_id",
        "exit_time_month",
        *[F.col(n).cast("double").alias(f"x{i}") for i, n in enumerate(model.names)],
        F.substring(F.md5(F.col("loan_id").cast("binary")), 1, BUCKET_DIGITS).alias("bucket"),
    )
    counts = events.groupBy("exit_time_month", "bucket").agg(F.count("*").alias("n"))
    earlier = (
        Window.partitionBy("exit_time_month")
        .orderBy("bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # At most one row per bucket in each window, whatever the number of events.
    offsets = counts.select(
        "exit_time_month",
        "bucket",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("exit_time_month", "bucket").orderBy("loan_id")
    numbered = (
        events.withColumn("rank", F.row_number().over(inside))
        .join(offsets, ["exit_time_month", "bucket"])
        .join(F.broadcast(month_means), "exit_time_month")
    )
    scaled = []
    for j, name in enumerate(model.names):
        value = F.lit(float(model.beta[j]))
        for i in range(p):
            factor = float(model.covariance[i, j] * deaths)
            value = value + (F.col(f"x{i}") - F.col(f"m{i}")) * factor
        for t in TRANSFORMS:
            scaled.append(
                F.struct(
                    F.lit(t).alias("time_transform"),
                    F.col(f"g_{t}").alias("transformed_time"),
                    F.lit(name).alias("variable"),
                    value.alias("scaled_schoenfeld_residual"),
                )
            )
    return conform(
        numbered.select(
            (F.col("month_offset") + F.col("offset") + F.col("rank")).alias("event_row"),
            F.col("exit_time_month").cast("double").alias("analysis_time"),
            F.explode(F.array(*scaled)).alias("r"),
        ).select("event_row", "analysis_time", "r.*"),
        SCHOENFELD,
    )


def check_model_matches(model: CoxModel, frame: DataFrame) -> DataFrame:
    """Differences between a model's diagnostics and the rows it is tested on."""
    d = model.diagnostics.first()
    return frame.agg(
        F.abs(F.count("*") - d["n_observations"]).alias("observations"),
        F.abs(F.count_if(F.col("default_event") == 1) - d["n_events"]).alias("events"),
        F.abs(F.count_if(F.col("entry_time_month") > 0) - d["delayed_entry_count"]).alias(
            "delayed_entry"
        ),
    )


def _check_values(result: DataFrame, keys: list[str], rows: int, alpha: float) -> DataFrame:
    status = F.when(F.col("p_value") < alpha, "FLAGGED").otherwise("PASS")
    numeric = ["test_statistic", "p_value", "alpha"]
    return result.agg(
        F.abs(F.count("*") - rows).alias("wrong_row_count"),
        (F.count("*") - F.count_distinct(*keys)).alias("duplicate_keys"),
        *violations(
            nonfinite=~all_of(is_finite(F.col(n)) for n in numeric),
            bad_degrees=F.col("degrees_of_freedom") <= 0,
            bad_p_value=~F.col("p_value").between(0, 1),
            bad_status=F.col("ph_status") != status,
        ),
    )


def check_ph_variables(result: DataFrame, predictors: int = 5, alpha: float = ALPHA) -> DataFrame:
    require_schema(result, PH_VARIABLE, "PH diagnostics")
    return _check_values(result, ["variable", "time_transform"], 2 * predictors, alpha)


def check_ph_global(result: DataFrame, alpha: float = ALPHA) -> DataFrame:
    require_schema(result, PH_GLOBAL, "PH global diagnostics")
    return _check_values(result, ["time_transform"], 2, alpha)
