"""Published projections: result tables conformed to stable schemas with provenance columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanspan.contracts import (
    ContractError,
    ALLOWED_HORIZONS,
    CUTOFF,
    conform,
    require_zero,
    schema_of,
    violations,
)
from loanspan.functions.codes import any_of

PORTFOLIO = schema_of(
    "total_loans bigint, default_count bigint, prepayment_count bigint, censor_count bigint, "
    "delayed_entry_count bigint, data_version string, performance_cutoff string, run_id string, "
    "code_commit string, specification_version string"
)
PD = schema_of(
    "horizon_months smallint, horizon_role string, default_cif double, pd double, "
    "loan_count bigint, n_at_risk bigint, default_count bigint, prepayment_count bigint, "
    "follow_up_eligible boolean, follow_up_status string, data_version string, "
    "model_version string, run_id string, code_commit string"
)
SURVIVAL = schema_of(
    "model string, model_version string, endpoint string, curve_type string, group_name string, "
    "group_value string, analysis_time int, survival_probability double, "
    "cumulative_incidence double, ci_lower double, ci_upper double, n_at_risk bigint, "
    "n_events bigint, n_censored bigint, data_version string, run_id string, code_commit string"
)
RISK_DRIVERS = schema_of(
    "model string, model_version string, endpoint string, predictor string, coefficient double, "
    "standard_error double, hazard_ratio double, subdistribution_hazard_ratio double, "
    "ci_lower double, ci_upper double, p_value double, data_version string, run_id string, "
    "code_commit string"
)
VINTAGE = schema_of(
    "vintage_year smallint, horizon_months smallint, horizon_role string, default_cif double, "
    "prepayment_cif double, pd double, loan_count bigint, n_at_risk bigint, default_count bigint, "
    "prepayment_count bigint, latest_origination_date date, performance_cutoff date, "
    "follow_up_eligible boolean, follow_up_status string, data_version string, "
    "model_version string, run_id string, code_commit string"
)
GROUPED = schema_of(
    "feature string, group_value string, horizon_months smallint, horizon_role string, "
    "default_cif double, prepayment_cif double, pd double, loan_count bigint, n_at_risk bigint, "
    "default_count bigint, prepayment_count bigint, follow_up_eligible boolean, "
    "follow_up_status string, data_version string, model_version string, run_id string, "
    "code_commit string"
)
DIAGNOSTICS = schema_of(
    "model string, model_version string, diagnostic_type string, endpoint string, "
    "predictor string, status string, test_statistic double, degrees_of_freedom bigint, "
    "p_value double, alpha double, convergence_status string, convergence_warning string, "
    "n_observations bigint, n_events bigint, n_censored bigint, n_predictors bigint, "
    "delayed_entry_count bigint, data_version string, run_id string, code_commit string"
)
SCHEMAS = {
    "portfolio_summary": PORTFOLIO,
    "pd_results": PD,
    "survival_results": SURVIVAL,
    "risk_driver_results": RISK_DRIVERS,
    "vintage_results": VINTAGE,
    "grouped_pd_results": GROUPED,
    "model_diagnostics": DIAGNOSTICS,
}

# Published model names, the version each carries, and the tables they come from.
COEFFICIENT_TABLES = {
    "cox_results": ("BASELINE_COX", "cox_ph"),
    "time_varying_cox_results": ("TV_COX", "time_varying_cox"),
    "fine_gray_default_results": ("FINE_GRAY_DEFAULT", "fine_gray_default"),
    "cause_specific_default_results": ("CAUSE_SPECIFIC_DEFAULT", "cause_specific_default"),
    "cause_specific_prepayment_results": ("CAUSE_SPECIFIC_PREPAYMENT", "cause_specific_prepayment"),
}
DIAGNOSTIC_TABLES = {
    "cox_diagnostics": ("BASELINE_COX", "cox_ph"),
    "ph_diagnostics": ("BASELINE_COX", "cox_ph"),
    "ph_global_diagnostics": ("BASELINE_COX", "cox_ph"),
    "time_varying_cox_diagnostics": ("TV_COX", "time_varying_cox"),
    "fine_gray_default_diagnostics": ("FINE_GRAY_DEFAULT", "fine_gray_default"),
    "cause_specific_default_diagnostics": ("CAUSE_SPECIFIC_DEFAULT", "cause_specific_default"),
    "cause_specific_prepayment_diagnostics": (
        "CAUSE_SPECIFIC_PREPAYMENT",
        "cause_specific_prepayment",
    ),
}


@dataclass
class Provenance:
    """Where a result comes from."""

    run_id: str
    data_version: str = "loans_2016_2026_cutoff_202603"
    code_commit: str = "unversioned"
    specification_version: str = "1"
    performance_cutoff: str = str(CUTOFF)
    model_versions: dict[str, str] = field(default_factory=dict)

    def columns(self, model: str | None = None) -> dict:
        values = {
            "data_version": self.data_version,
            "run_id": self.run_id,
            "code_commit": self.code_commit,
        }
        if model is not None:
            values["model_version"] = self.model_versions.get(model, "1")
        return {name: F.lit(value) for name, value in values.items()}


def check_finite(df: DataFrame) -> DataFrame:
    """Count of NaN or infinite values over all double columns."""
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    bad = any_of(F.isnan(n) | (F.abs(n) == float("inf")) for n in doubles)
    return df.agg(*violations(nonfinite_rows=F.coalesce(bad, F.lit(False))))


def attach(df: DataFrame, schema: T.StructType, validate: bool = True) -> DataFrame:
    """Conform to a published schema; absent columns become NULL, non-finite values are an error."""
    result = conform(df, schema)
    if validate:
        require_zero(check_finite(result), "Published projection")
    return result


def portfolio_summary(analysis: DataFrame, prov: Provenance) -> DataFrame:
    kind = F.col("event_type")
    counts = analysis.agg(
        F.count("*").alias("total_loans"),
        F.count_if(kind == "DEFAULT").alias("default_count"),
        F.count_if(kind == "PREPAYMENT").alias("prepayment_count"),
        F.count_if(kind == "CENSOR").alias("censor_count"),
        F.count_if(F.col("entry_time_month") > 0).alias("delayed_entry_count"),
    ).withColumns(
        {
            **prov.columns(),
            "performance_cutoff": F.lit(prov.performance_cutoff),
            "specification_version": F.lit(prov.specification_version),
        }
    )
    return conform(counts, PORTFOLIO)


def pd_results(overall: DataFrame, prov: Provenance, validate: bool = True) -> DataFrame:
    kept = overall.filter(F.col("horizon_months").isin(ALLOWED_HORIZONS))
    return attach(kept.withColumns(prov.columns("pd_horizons")), PD, validate)


def grouped_pd_results(grouped: DataFrame, prov: Provenance, validate: bool = True) -> DataFrame:
    kept = grouped.filter(F.col("horizon_months").isin(ALLOWED_HORIZONS))
    return attach(kept.withColumns(prov.columns("grouped_pd")), GROUPED, validate)


def survival_results(
    km: DataFrame, aj: DataFrame, prov: Provenance, validate: bool = True
) -> DataFrame:
    """Kaplan-Meier and Aalen-Johansen curves in one long table."""
    survival = km.withColumns(
        {
            **prov.columns("kaplan_meier"),
            "model": F.lit("KAPLAN_MEIER"),
            "endpoint": F.upper("endpoint"),
            "curve_type": F.lit("SURVIVAL"),
            "survival_probability": F.col("survival"),
        }
    )
    incidence = aj.withColumns(
        {
            **prov.columns("aalen_johansen"),
            "model": F.lit("AALEN_JOHANSEN"),
            "curve_type": F.concat(F.upper("endpoint"), F.lit("_CIF")),
        }
    )
    return attach(
        conform(survival, SURVIVAL).unionByName(conform(incidence, SURVIVAL)), SURVIVAL, validate
    )


def _stack(tables, sources, schema, prov, extra, validate) -> DataFrame:
    missing = [name for name in sources if name not in tables]
    if missing:
        raise ContractError(f"Missing result tables: {missing}.")
    parts = [
        conform(
            tables[name]
            .withColumns({**prov.columns(version), "model": F.lit(model)})
            .withColumns(extra(name, tables[name].columns)),
            schema,
        )
        for name, (model, version) in sources.items()
    ]
    return attach(reduce(DataFrame.unionByName, parts), schema, validate)


def risk_driver_results(
    tables: dict[str, DataFrame], prov: Provenance, validate: bool = True
) -> DataFrame:
    """Coefficients of all models with hazard or subdistribution hazard ratios."""

    def extra(_, __):
        return {"endpoint": F.upper("endpoint"), "predictor": F.col("variable")}

    return _stack(tables, COEFFICIENT_TABLES, RISK_DRIVERS, prov, extra, validate)


def vintage_results(horizons: DataFrame, prov: Provenance, validate: bool = True) -> DataFrame:
    return attach(horizons.withColumns(prov.columns("vintage_analysis")), VINTAGE, validate)


def model_diagnostics(
    tables: dict[str, DataFrame], prov: Provenance, validate: bool = True
) -> DataFrame:
    """Differently shaped diagnostics in one long table; status is the test's or the fit's."""

    def extra(name, columns):
        out = {
            "endpoint": F.upper("endpoint"),
            "diagnostic_type": F.lit(name.removesuffix("_diagnostics")),
        }
        if "variable" in columns:
            out["predictor"] = F.col("variable")
        if "ph_status" in columns:
            out["status"] = F.col("ph_status")
        elif "convergence_status" in columns:
            out["status"] = F.col("convergence_status")
        return out

    return _stack(tables, DIAGNOSTIC_TABLES, DIAGNOSTICS, prov, extra, validate)
