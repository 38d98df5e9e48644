"""Default probability at fixed horizons: portfolio, vintage and risk band.

PD(H) is the default cumulative incidence at H. Curves are right-continuous steps, zero before the
first step and undefined beyond the last observed month.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.contracts import (
    ALLOWED_HORIZONS,
    COMPETING_INPUT,
    CUTOFF_DATE,
    END_YEAR,
    ENDPOINTS,
    GROUPED_PD,
    OVERALL_PD,
    PRIMARY_HORIZONS,
    START_YEAR,
    VINTAGE_CIF,
    VINTAGE_HORIZON,
    conform,
    horizons_of,
    merge_rows,
    require_columns,
    require_schema,
    violations,
)
from loanspan.functions.codes import is_finite, true
from loanspan.operators.aalen_johansen import (
    check_aj_input,
    check_curves,
    curves_from_cells,
    fit_aalen_johansen,
    incidence_points,
)
from loanspan.operators.cells import GROUP, band_cells, event_cells

ELIGIBLE = "ELIGIBLE"
INSUFFICIENT_FOLLOW_UP = "INSUFFICIENT_FOLLOW_UP"
INSUFFICIENT_OBSERVED_SUPPORT = "INSUFFICIENT_OBSERVED_SUPPORT"

# Band inventory and upper edges.
BANDS = {
    "fico_band": ["<650", "650–699", "700–749", "750+", "Missing"],
    "ltv_band": ["≤60%", ">60–70%", ">70–80%", ">80%", "Missing"],
    "dti_band": ["≤30%", ">30–40%", ">40–50%", ">50%", "Missing"],
}
BAND_SOURCES = {"fico_band": "fico", "ltv_band": "original_ltv", "dti_band": "original_dti"}
BAND_EDGES = {"fico_band": [650, 700, 750], "ltv_band": [60, 70, 80], "dti_band": [30, 40, 50]}


def add_calendar_months(date: Column, count: Column | int) -> Column:
    """Whole calendar months later, clipped to the end of the target month."""
    return F.add_months(date, count)


def fully_seasoned(latest_origination: Column, horizon: Column) -> Column:
    """The youngest loan of the group could have been followed for the whole horizon."""
    return true(
        add_calendar_months(latest_origination, horizon) <= F.lit(CUTOFF_DATE).cast("date")
    )


def horizon_role(horizon: Column) -> Column:
    return F.when(horizon.isin(PRIMARY_HORIZONS), "PRIMARY").otherwise("SUPPLEMENTARY")


def _each_horizon(horizons: list[int]) -> Column:
    return F.explode(F.array(*[F.lit(h) for h in horizons])).alias("h")


def check_pd_input(frame: DataFrame) -> DataFrame:
    """Competing-risk input violations plus origin dates and vintages."""
    require_columns(frame, ["operational_origination_date"], "PD input")
    origin = F.col("operational_origination_date")
    extra = frame.agg(
        *violations(
            invalid_origin=origin > F.lit(CUTOFF_DATE).cast("date"),
            invalid_vintage=~F.col("vintage_year").between(START_YEAR, END_YEAR),
        )
    )
    return merge_rows(check_aj_input(frame.select(COMPETING_INPUT.names)), extra)


def step_values(curves: DataFrame, horizons: Iterable[int] = ALLOWED_HORIZONS) -> DataFrame:
    """Step value of each curve at each horizon: the last one at or before it.

    Curves hold one row per month, so repeating them per horizon stays small, and the step lookup is
    an aggregate instead of a range join.
    """
    t, h = F.col("analysis_time"), F.col("h")
    f = F.col("cumulative_incidence")
    seen = t <= h
    return (
        curves.select("endpoint", *GROUP, t, f, _each_horizon(horizons_of(horizons)))
        .groupBy("endpoint", *GROUP, "h")
        .agg(
            F.max(t).alias("last_time"),
            F.max_by(F.when(seen, f), F.when(seen, t)).alias("value"),
        )
        .select(
            "endpoint",
            *GROUP,
            F.col("h").alias("horizon_months"),
            F.when(h <= F.col("last_time"), F.coalesce("value", F.lit(0.0))).alias("cif"),
        )
    )


def paired_steps(curves: DataFrame, horizons: Iterable[int] = ALLOWED_HORIZONS) -> DataFrame:
    """Step values of both endpoints side by side."""
    return (
        step_values(curves, horizons)
        .groupBy(*GROUP, "horizon_months")
        .pivot("endpoint", ENDPOINTS)
        .agg(F.first("cif"))
        .select(
            *GROUP,
            "horizon_months",
            F.col("DEFAULT").alias("default_step"),
            F.col("PREPAYMENT").alias("prepay_step"),
        )
    )


def support(cells: DataFrame, horizons: Iterable[int] = ALLOWED_HORIZONS) -> DataFrame:
    """Per group and horizon: loans, events and the number at risk, entry < H <= exit."""
    n, h = F.col("n"), F.col("h")

    def total(cond):
        return F.sum(F.when(cond, n).otherwise(0))

    return (
        cells.select(*GROUP, "entry", "exit", "code", "n", _each_horizon(horizons_of(horizons)))
        .groupBy(*GROUP, F.col("h").alias("horizon_months"))
        .agg(
            F.sum("n").alias("loan_count"),
            total((F.col("entry") < h) & (F.col("exit") >= h)).alias("n_at_risk"),
            total(F.col("code") == 1).alias("default_count"),
            total(F.col("code") == 2).alias("prepayment_count"),
        )
    )


def _with_steps(cells, curves, horizons) -> DataFrame:
    keys = [*GROUP, "horizon_months"]
    supported = (
        F.col("default_step").isNotNull()
        & F.col("prepay_step").isNotNull()
        & (F.col("n_at_risk") > 0)
    )
    return (
        support(cells, horizons)
        .join(paired_steps(curves, horizons), keys, "left")
        .withColumns(
            {"supported": true(supported), "horizon_role": horizon_role(F.col("horizon_months"))}
        )
    )


def overall_pd(
    frame: DataFrame,
    horizons: Iterable[int] = ALLOWED_HORIZONS,
    curves: DataFrame | None = None,
) -> DataFrame:
    """Portfolio PD(H) with its support."""
    cells = event_cells(frame, F.col("cr_event_code"))
    steps = _with_steps(cells, incidence_points(cells) if curves is None else curves, horizons)
    # The portfolio row asks for the default curve only; both curves share their months.
    value = F.when(F.col("supported"), F.col("default_step"))
    return conform(
        steps.select(
            F.lit("PD_HORIZON").alias("model_type"),
            F.lit("DEFAULT").alias("endpoint"),
            *GROUP,
            "horizon_months",
            "horizon_role",
            value.alias("default_cif"),
            value.alias("pd"),
            "loan_count",
            "n_at_risk",
            "default_count",
            "prepayment_count",
            F.col("supported").alias("follow_up_eligible"),
            F.when(F.col("supported"), ELIGIBLE)
            .otherwise(INSUFFICIENT_OBSERVED_SUPPORT)
            .alias("follow_up_status"),
        ),
        OVERALL_PD,
    )


def vintage_counts(frame: DataFrame) -> DataFrame:
    """Loans, events and latest origination per vintage."""
    kind = F.col("event_type")
    return frame.groupBy("vintage_year").agg(
        F.count("*").alias("loan_count"),
        F.count_if(kind == "DEFAULT").alias("default_count"),
        F.count_if(kind == "PREPAYMENT").alias("prepayment_count"),
        F.max("operational_origination_date").alias("latest_origination_date"),
    )


def fit_vintage_cif(
    frame: DataFrame, confidence_level: float = 0.95, validate: bool = True
) -> DataFrame:
    """Incidence curves per vintage with the vintage's counts."""
    curves = fit_aalen_johansen(frame, "vintage_year", confidence_level, validate)
    counts = vintage_counts(frame).drop("latest_origination_date")
    return conform(
        curves.withColumn("vintage_year", F.col("group_value").cast("smallint"))
        .join(counts, "vintage_year", "left")
        .withColumn("model_type", F.lit("VINTAGE_AALEN_JOHANSEN")),
        VINTAGE_CIF,
    )


def vintage_horizons(
    frame: DataFrame,
    horizons: Iterable[int] = ALLOWED_HORIZONS,
    curves: DataFrame | None = None,
) -> DataFrame:
    """Every vintage and horizon under the full-seasoning rule.

    `follow_up_eligible` is the seasoning rule alone; the status also needs observed support.
    """
    cells = event_cells(frame, F.col("cr_event_code"), "vintage_year")
    if curves is None:
        curves = incidence_points(cells)
    else:
        curves = curves.withColumns(
            {"group_name": F.lit("vintage_year"), "group_value": F.col("vintage_year").cast("string")}
        )
    latest = frame.groupBy(F.col("vintage_year").cast("string").alias("group_value")).agg(
        F.max("operational_origination_date").alias("latest_origination_date")
    )
    horizon = F.col("horizon_months")
    estimable = F.col("seasoned") & F.col("supported")
    return conform(
        _with_steps(cells, curves, horizons)
        .join(latest, "group_value")
        .withColumn("seasoned", fully_seasoned(F.col("latest_origination_date"), horizon))
        .select(
            F.lit("VINTAGE_PD_HORIZON").alias("model_type"),
            F.col("group_value").cast("smallint").alias("vintage_year"),
            "horizon_months",
            "horizon_role",
            F.when(estimable, F.col("default_step")).alias("default_cif"),
            F.when(estimable, F.col("prepay_step")).alias("prepayment_cif"),
            F.when(estimable, F.col("default_step")).alias("pd"),
            "loan_count",
            "n_at_risk",
            "default_count",
            "prepayment_count",
            "latest_origination_date",
            F.lit(CUTOFF_DATE).cast("date").alias("performance_cutoff"),
            F.col("seasoned").alias("follow_up_eligible"),
            F.when(~F.col("seasoned"), INSUFFICIENT_FOLLOW_UP)
            .when(~F.col("supported"), INSUFFICIENT_OBSERVED_SUPPORT)
            .otherwise(ELIGIBLE)
            .alias("follow_up_status"),
        ),
        VINTAGE_HORIZON,
    )


def fit_pd_vintage(
    frame: DataFrame, horizons: Iterable[int] = ALLOWED_HORIZONS, confidence_level: float = 0.95
) -> dict[str, DataFrame]:
    """Portfolio horizons, vintage curves and vintage horizons."""
    cif = fit_vintage_cif(frame, confidence_level)
    return {
        "overall_pd_horizons": overall_pd(frame, horizons),
        "vintage_cif_results": cif,
        "vintage_horizon_results": vintage_horizons(frame, horizons, cif),
    }


def band(value: Column, feature: str) -> Column:
    """Risk band of a raw feature value; missing and non-finite values are their own band."""
    x = value.try_cast("double")
    labels = BANDS[feature]
    expr = F.when(~is_finite(x), labels[-1])
    for edge, label in zip(BAND_EDGES[feature], labels):
        # Score bands exclude their upper edge, the ratio bands include it.
        expr = expr.when(x < edge if feature == "fico_band" else x <= edge, label)
    return expr.otherwise(labels[3])


def add_bands(frame: DataFrame) -> DataFrame:
    return frame.withColumns(
        {feature: band(F.col(source), feature) for feature, source in BAND_SOURCES.items()}
    )


def grouped_cells(frame: DataFrame) -> DataFrame:
    return band_cells(add_bands(frame), F.col("cr_event_code"), list(BANDS))


def grouped_curves(frame: DataFrame, confidence_level: float = 0.95) -> DataFrame:
    """Incidence curves of all bands of all three features, in one job."""
    return curves_from_cells(grouped_cells(frame), confidence_level)


def grouped_pd(
    frame: DataFrame,
    horizons: Iterable[int] = ALLOWED_HORIZONS,
    curves: DataFrame | None = None,
) -> DataFrame:
    """PD(H) per risk band; NULL where a horizon is not supported."""
    cells = grouped_cells(frame)
    steps = _with_steps(cells, incidence_points(cells) if curves is None else curves, horizons)
    default = F.when(F.col("supported"), F.col("default_step"))
    return conform(
        steps.select(
            F.col("group_name").alias("feature"),
            "group_value",
            "horizon_months",
            "horizon_role",
            default.alias("default_cif"),
            F.when(F.col("supported"), F.col("prepay_step")).alias("prepayment_cif"),
            default.alias("pd"),
            "loan_count",
            "n_at_risk",
            "default_count",
            "prepayment_count",
            F.col("supported").alias("follow_up_eligible"),
            F.when(F.col("supported"), ELIGIBLE)
            .otherwise(INSUFFICIENT_OBSERVED_SUPPORT)
            .alias("follow_up_status"),
        ),
        GROUPED_PD,
    )


def _count_rules() -> dict[str, Column]:
    loans = F.col("loan_count")
    return {
        "invalid_counts": ~(
            (loans > 0)
            & (F.col("n_at_risk") <= loans)
            & (F.col("default_count") + F.col("prepayment_count") <= loans)
        ),
        "invalid_role": F.col("horizon_role") != horizon_role(F.col("horizon_months")),
        "unsupported_horizon": ~F.col("horizon_months").isin(ALLOWED_HORIZONS),
    }


def _estimate_rules(names: list[str]) -> dict[str, Column]:
    """Estimates are probabilities when the status is eligible and NULL otherwise."""
    eligible = F.col("follow_up_status") == ELIGIBLE
    bad = F.lit(False)
    for name in names:
        bad = bad | F.when(eligible, ~true(F.col(name).between(0, 1))).otherwise(
            F.col(name).isNotNull()
        )
    rules = {"invalid_estimates": bad, "pd_differs": eligible & (F.col("pd") != F.col("default_cif"))}
    if "prepayment_cif" in names:
        rules["sum_above_one"] = eligible & (
            F.col("default_cif") + F.col("prepayment_cif") > 1 + 1e-12
        )
    return rules


def _nullsafe(rules: dict[str, Column]) -> dict[str, Column]:
    return {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}


def check_overall_pd(result: DataFrame) -> DataFrame:
    require_schema(result, OVERALL_PD, "Overall PD results")
    status_ok = (F.col("follow_up_status") == ELIGIBLE) == F.col("follow_up_eligible")
    return result.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("horizon_months")).alias("duplicate_keys"),
        *violations(
            **_nullsafe({**_count_rules(), **_estimate_rules(["default_cif", "pd"])}),
            invalid_status=~status_ok,
        ),
    )


def check_vintage_cif(result: DataFrame) -> DataFrame:
    """Curve checks plus stable counts per vintage."""
    require_schema(result, VINTAGE_CIF, "Vintage CIF results")
    counts = ["loan_count", "default_count", "prepayment_count"]
    unstable = F.lit(False)
    for name in counts:
        unstable = unstable | (F.col(f"lo_{name}") != F.col(f"hi_{name}"))
    stable = (
        result.groupBy("vintage_year")
        .agg(
            *[F.min(name).alias(f"lo_{name}") for name in counts],
            *[F.max(name).alias(f"hi_{name}") for name in counts],
        )
        .agg(
            *violations(
                unstable_counts=unstable,
                invalid_vintage=~F.col("vintage_year").between(START_YEAR, END_YEAR),
            )
        )
    )
    return merge_rows(check_curves(result, ["vintage_year"], F.lit(False)), stable)


def check_vintage_horizons(result: DataFrame) -> DataFrame:
    require_schema(result, VINTAGE_HORIZON, "Vintage horizon results")
    seasoned = fully_seasoned(F.col("latest_origination_date"), F.col("horizon_months"))
    status = F.col("follow_up_status")
    rules = {
        **_count_rules(),
        **_estimate_rules(["default_cif", "prepayment_cif", "pd"]),
        "invalid_eligibility": F.col("follow_up_eligible") != seasoned,
        "invalid_status": (status == INSUFFICIENT_FOLLOW_UP) == F.col("follow_up_eligible"),
        "invalid_cutoff": F.col("performance_cutoff") != F.lit(CUTOFF_DATE).cast("date"),
    }
    return result.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("vintage_year", "horizon_months")).alias("duplicate_keys"),
        *violations(**_nullsafe(rules)),
    )


def check_grouped_pd(result: DataFrame) -> DataFrame:
    """Band inventory, counts and estimates; every listed band must be present."""
    require_schema(result, GROUPED_PD, "Grouped PD results")
    known = F.lit(False)
    for feature, labels in BANDS.items():
        known = known | ((F.col("feature") == feature) & F.col("group_value").isin(labels))
    rules = {**_count_rules(), **_estimate_rules(["default_cif", "prepayment_cif", "pd"])}
    bands = sum(len(labels) for labels in BANDS.values())
    return result.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("feature", "group_value", "horizon_months")).alias(
            "duplicate_keys"
        ),
        (F.lit(bands) - F.count_distinct(F.when(known, F.struct("feature", "group_value")))).alias(
            "missing_bands"
        ),
        *violations(**_nullsafe(rules), unknown_band=~known),
    )
