"""Aalen-Johansen cumulative incidence with delayed entry, tied months and infinitesimal-jackknife
confidence limits.

A loan's influence on an incidence F(t) is linear in F(t), with coefficients that depend only on its
entry month, exit month and cause:

* after its exit it is a + b F(t);
* while at risk (entry < t < exit) it is G(t) + alpha(entry) - beta(entry) F(t).

The variance, the sum of squared influences, is therefore a polynomial in F(t) and G(t) whose
coefficients are running sums of cell moments. No cell is ever paired with every later month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanspan.contracts import (
    AJ_RESULT,
    COMPETING_INPUT,
    ENDPOINTS,
    EVENT_TYPES,
    ContractError,
    confidence,
    require_columns,
    require_schema,
    require_types,
    require_zero,
    violations,
)
from loanspan.functions.codes import is_finite
from loanspan.functions.stats import normal_quantile
from loanspan.operators.cells import GROUP, before, event_cells, month_table, up_to
from loanspan.operators.dataset import expected_code, valid_time
from loanspan.operators.kaplan_meier import log_sum

CURVE = [*GROUP, "endpoint"]


def check_aj_input(frame: DataFrame, group_col: str | None = None) -> DataFrame:
    """Key, event, clock and group violations; `events` must not be zero."""
    require_types(frame, COMPETING_INPUT, "Aalen-Johansen input")
    rules = {
        "missing_loan_id": F.col("loan_id").isNull(),
        "invalid_event": ~(
            F.col("event_type").isin(EVENT_TYPES) & (F.col("cr_event_code") == expected_code())
        ),
        "invalid_time": ~valid_time(),
    }
    if group_col is not None:
        require_columns(frame, [group_col], "Aalen-Johansen input")
        rules["missing_group"] = F.col(group_col).isNull()
    return frame.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("cr_event_code") > 0).alias("events"),
        (F.count("loan_id") - F.count_distinct("loan_id")).alias("duplicate_loans"),
        *violations(**rules),
    )


def validate_aj_input(frame: DataFrame, group_col: str | None = None) -> DataFrame:
    row = require_zero(
        check_aj_input(frame, group_col), "Aalen-Johansen input", ["rows", "events"]
    )
    if row["events"] == 0:
        raise ContractError("Aalen-Johansen input holds no default or prepayment.")
    return frame


def incidence_table(cells: DataFrame) -> DataFrame:
    """Month table with the hazards, `s_before` = S(t-) and both cumulative incidences."""
    n = F.col("at_risk")

    def hazard(count: Column) -> Column:
        return F.when(n > 0, count / n).otherwise(F.lit(0.0))

    return (
        month_table(cells)
        .withColumns(
            {
                "h1": hazard(F.col("defaults")),
                "h2": hazard(F.col("prepays")),
                "h": hazard(F.col("defaults") + F.col("prepays")),
            }
        )
        .withColumn("survival", F.exp(log_sum(F.col("h"))))
        .withColumn("s_before", F.coalesce(F.lag("survival").over(_ordered()), F.lit(1.0)))
        .withColumns(
            {
                "cif1": F.sum(F.col("s_before") * F.col("h1")).over(up_to()),
                "cif2": F.sum(F.col("s_before") * F.col("h2")).over(up_to()),
            }
        )
    )


def _ordered():
    return Window.partitionBy(*GROUP).orderBy("t")


def _per_endpoint(months: DataFrame) -> DataFrame:
    """One row per month and endpoint, with the running sums the influences need."""
    n, h = F.col("at_risk"), F.col("h")
    rows = months.select(
        *GROUP,
        "t",
        "at_risk",
        "h",
        "s_before",
        (F.col("defaults") + F.col("prepays") + F.col("censored") > 0).alias("is_exit_month"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("endpoint"),
                        F.lit(code).alias("k"),
                        F.col(f"h{code}").alias("hk"),
                        F.col(f"cif{code}").alias("cif"),
                    )
                    for code, name in enumerate(ENDPOINTS, start=1)
                ]
            )
        ).alias("e"),
    ).select("*", "e.*").drop("e")
    risk = F.when((n > 0) & (h < 1), h / (n * (1 - h))).otherwise(F.lit(0.0))
    p_step = F.when(n > 0, F.col("s_before") * F.col("hk") / n).otherwise(F.lit(0.0))
    window = up_to(CURVE)
    return rows.withColumns(
        {
            "p": F.sum(p_step).over(window),
            "q": F.sum(risk).over(window),
            "r": F.sum(risk * F.col("cif")).over(window),
            "v": F.when((n > 0) & (h < 1), 1 / (n * (1 - h))).otherwise(F.lit(0.0)),
            "share": F.when(n > 0, F.col("s_before") / n).otherwise(F.lit(0.0)),
        }
    )


STILL = ["m", "m_a", "m_b", "m_aa", "m_ab", "m_bb"]
GONE = ["x_aa", "x_ab", "x_bb"]


def _influence_moments(cells: DataFrame, curve: DataFrame) -> DataFrame:
    """Moments of the cell coefficients: added at the entry month, moved at the exit month.

    The curve enters as one row of month arrays per group and endpoint, so cells meet it in a
    single join on the group and index into it.
    """
    values = F.struct(
        "t",
        (F.col("p") + F.col("r")).alias("pr"),
        "q",
        "cif",
        "v",
        "share",
    )
    lookup = curve.groupBy(*CURVE, "k").agg(
        F.min("t").alias("t0"), F.sort_array(F.collect_list(values)).alias("months")
    )

    def at(month):
        return F.element_at("months", (F.col(month) - F.col("t0") + 1).cast("int"))

    event = (F.col("code") > 0).cast("double")
    own = (F.col("code") == F.col("k")).cast("double")
    n, alpha, beta = F.col("n"), F.col("at_entry.pr"), F.col("at_entry.q")
    gone = F.col("at_exit")
    a = alpha - gone["pr"] + own * gone["share"] + event * gone["cif"] * gone["v"]
    b = gone["q"] - beta - event * gone["v"]
    joined = (
        cells.join(lookup, GROUP)
        .select(*CURVE, "entry", "exit", "n", "code", "k", at("entry").alias("at_entry"),
                at("exit").alias("at_exit"))
        .select(*CURVE, "entry", "exit", "n", alpha.alias("alpha"), beta.alias("beta"),
                a.alias("a"), b.alias("b"))
    )
    alpha, beta, a, b = F.col("alpha"), F.col("beta"), F.col("a"), F.col("b")
    still = [n, n * alpha, n * beta, n * alpha * alpha, n * alpha * beta, n * beta * beta]
    left = [n * a * a, n * a * b, n * b * b]
    zero = F.lit(0.0)
    # `in_` moments count from the month after entry; `out_` and `x_` ones from the exit month on.
    enter = F.struct(
        F.col("entry").alias("t"),
        *[v.cast("double").alias(f"in_{k}") for k, v in zip(STILL, still)],
        *[zero.alias(f"out_{k}") for k in STILL],
        *[zero.alias(k) for k in GONE],
    )
    leave = F.struct(
        F.col("exit").alias("t"),
        *[zero.alias(f"in_{k}") for k in STILL],
        *[v.cast("double").alias(f"out_{k}") for k, v in zip(STILL, still)],
        *[v.alias(k) for k, v in zip(GONE, left)],
    )
    return joined.select(*CURVE, F.explode(F.array(enter, leave)).alias("move")).select(
        *CURVE, "move.*"
    )


def _variance(cells: DataFrame, curve: DataFrame) -> DataFrame:
    moments = _influence_moments(cells, curve)
    kept = ["at_risk", "is_exit_month", "cif", "p", "q", "r"]
    summed = [c for c in moments.columns if c not in [*CURVE, "t"]]
    # Curve and moments meet by union and one aggregate on the month instead of joins.
    joined = (
        curve.select(*CURVE, "t", *kept)
        .unionByName(moments, allowMissingColumns=True)
        .groupBy(*CURVE, "t")
        .agg(*[F.max(c).alias(c) for c in kept], *[F.sum(c).alias(c) for c in summed])
    )
    zero = F.lit(0.0)

    def upto(name):
        return F.coalesce(F.sum(name).over(up_to(CURVE)), zero)

    def earlier(name):
        return F.coalesce(F.sum(name).over(before(CURVE)), zero)

    sums = {k: earlier(f"in_{k}") - upto(f"out_{k}") for k in STILL}
    sums |= {k: upto(k) for k in GONE}
    f = F.col("cif")
    g = -F.col("p") + f * F.col("q") - F.col("r")
    variance = (
        F.col("s_x_aa")
        + 2 * f * F.col("s_x_ab")
        + f * f * F.col("s_x_bb")
        + F.col("s_m") * g * g
        + 2 * g * (F.col("s_m_a") - f * F.col("s_m_b"))
        + F.col("s_m_aa")
        - 2 * f * F.col("s_m_ab")
        + f * f * F.col("s_m_bb")
    )
    return joined.withColumns({f"s_{k}": v for k, v in sums.items()}).withColumn(
        "variance", F.greatest(variance, zero)
    )


def incidence_points(cells: DataFrame) -> DataFrame:
    """Point estimates only: (group, endpoint, analysis_time, cumulative_incidence, n_at_risk).

    Horizon tables need no confidence limits and skip the variance work.
    """
    exits = F.col("defaults") + F.col("prepays") + F.col("censored")
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("endpoint"), F.col(f"cif{code}").alias("cif"))
            for code, name in enumerate(ENDPOINTS, start=1)
        ]
    )
    return (
        incidence_table(cells)
        .filter(exits > 0)
        .select(*GROUP, "t", "at_risk", F.explode(pairs).alias("e"))
        .select(
            "e.endpoint",
            *GROUP,
            F.col("t").alias("analysis_time"),
            F.col("e.cif").alias("cumulative_incidence"),
            F.col("at_risk").alias("n_at_risk"),
        )
    )


def curves_from_cells(cells: DataFrame, confidence_level: float = 0.95) -> DataFrame:
    """Both incidence curves of every group at its distinct exit months."""
    z = normal_quantile(0.5 + confidence(confidence_level) / 2)
    f = F.col("cif")
    theta = z * F.sqrt("variance") / (f * F.abs(F.log(f)))
    limit = F.when((f <= 0) | (f >= 1), f)
    return (
        _variance(cells, _per_endpoint(incidence_table(cells)))
        .filter("is_exit_month")
        .select(
            F.lit("AALEN_JOHANSEN").alias("model_type"),
            "endpoint",
            *GROUP,
            F.col("t").alias("analysis_time"),
            f.alias("cumulative_incidence"),
            limit.otherwise(F.pow(f, F.exp(theta))).alias("ci_lower"),
            limit.otherwise(F.pow(f, F.exp(-theta))).alias("ci_upper"),
            F.col("at_risk").alias("n_at_risk"),
        )
    )


def fit_aalen_johansen(
    frame: DataFrame,
    group_col: str | None = None,
    confidence_level: float = 0.95,
    validate: bool = True,
) -> DataFrame:
    """Default and prepayment incidence, overall or for all groups of a column in one job.

    Hazards use entry < t <= exit. Limits are log-log and degenerate to the estimate itself where
    it is zero or one.
    """
    if validate:
        validate_aj_input(frame, group_col)
    return curves_from_cells(
        event_cells(frame, F.col("cr_event_code"), group_col), confidence_level
    )


def check_aj_results(result: DataFrame) -> DataFrame:
    """Bounds, endpoint pairs, their sum, and monotony of each curve."""
    require_schema(result, AJ_RESULT, "Aalen-Johansen result")
    wrong_model = F.col("model_type") != "AALEN_JOHANSEN"
    return check_curves(result, GROUP, wrong_model)


def check_curves(result: DataFrame, group: list[str], wrong_model: Column) -> DataFrame:
    """The rules of `check_aj_results` for curves of both endpoints in each `group`."""
    f, lo, hi = F.col("cumulative_incidence"), F.col("ci_lower"), F.col("ci_upper")
    bounded = (
        is_finite(f)
        & is_finite(lo)
        & is_finite(hi)
        & f.between(0, 1)
        & lo.between(0, 1)
        & hi.between(0, 1)
        & (lo <= f)
        & (f <= hi)
        & (F.col("analysis_time") >= 0)
        & (F.col("n_at_risk") > 0)
    )
    previous = F.lag(f).over(Window.partitionBy(*group, "endpoint").orderBy("analysis_time"))
    paired = (
        result.withColumn("drop", F.coalesce(f - previous < -1e-12, F.lit(False)))
        .groupBy(*group, "analysis_time")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(~bounded | wrong_model).alias("unbounded"),
            F.count_if("drop").alias("drops"),
            F.count_if(F.col("endpoint") == "DEFAULT").alias("default_rows"),
            F.count_if(F.col("endpoint") == "PREPAYMENT").alias("prepay_rows"),
            F.sum(f).alias("total"),
        )
    )
    zero = F.lit(0)
    return paired.agg(
        F.coalesce(F.sum("rows"), zero).alias("rows"),
        F.coalesce(F.sum("unbounded"), zero).alias("invalid_estimates"),
        F.coalesce(F.sum("drops"), zero).alias("decreasing_steps"),
        F.count_if((F.col("default_rows") != 1) | (F.col("prepay_rows") != 1)).alias(
            "unpaired_months"
        ),
        F.count_if(F.col("total") > 1 + 1e-12).alias("sums_above_one"),
    )


def validate_aj_results(result: DataFrame) -> DataFrame:
    if require_zero(check_aj_results(result), "Aalen-Johansen result", ["rows"])["rows"] == 0:
        raise ContractError("Aalen-Johansen result is empty.")
    return result
