"""Registered queries of the regression family and of all that is built on its fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanspan.contracts import CORE_PREDICTORS, TV_PREDICTORS
from loanspan.operators import cox, fine_gray, ph_test, scoring
from loanspan.plans import projections, reads
from loanspan.plans import regression_oracle as _views  # noqa: F401
from loanspan.plans.registry import DIGITS, PROV, PROV_SQL, query, rnd
from loanspan.plans.study import Study


#: Digits of results with thousands of values.
FEWER = 6


def _rounded(view: str, columns: str, doubles: str, digits: int = DIGITS) -> str:
    return f"SELECT {columns}, {', '.join(rnd(d, digits=digits) for d in doubles.split())} FROM {view}"


COEFFICIENTS = "coefficient {ratio} standard_error ci_lower ci_upper p_value z_statistic"
HAZARD = COEFFICIENTS.format(ratio="hazard_ratio")
SUBDISTRIBUTION = COEFFICIENTS.format(ratio="subdistribution_hazard_ratio")
NAMES = "model_type, endpoint, variable"
FIT_COUNTS = (
    "model_type, endpoint, n_observations, n_events, n_censored, n_predictors, delayed_entry_count, "
    "convergence_status, convergence_warning"
)

query("cox_baseline", _rounded("coef_base", NAMES, HAZARD))(lambda s: s.baseline.coefficients)
query(
    "cox_baseline_diagnostics",
    _rounded("diag_base", FIT_COUNTS, "log_likelihood partial_aic concordance_index"),
)(lambda s: s.baseline.diagnostics)


def _both(s: Study, table: str) -> DataFrame:
    models = s.cause_specific
    return getattr(models["DEFAULT"], table).unionByName(getattr(models["PREPAYMENT"], table))


query("cox_cause_specific", _rounded("coef_cause", NAMES, HAZARD))(lambda s: _both(s, "coefficients"))
query(
    "cox_cause_specific_diagnostics",
    _rounded("diag_cause", FIT_COUNTS, "log_likelihood partial_aic concordance_index"),
)(lambda s: _both(s, "diagnostics"))
query("cox_time_varying", _rounded("coef_tv", NAMES, HAZARD))(lambda s: s.time_varying.coefficients)
query(
    "cox_time_varying_diagnostics",
    _rounded(
        "diag_tv",
        "model_type, endpoint, n_intervals, n_loans, n_events, n_censored_loans, n_predictors, "
        "n_delayed_entry_loans, n_gap_intervals, max_interval_length_months, variance_type, "
        "convergence_status, convergence_warning",
        "l2_penalizer log_likelihood partial_aic",
    ),
)(lambda s: s.time_varying.diagnostics)
query("fine_gray_default", _rounded("coef_fg", NAMES, SUBDISTRIBUTION))(lambda s: s.fine_gray.coefficients)
query("fine_gray_diagnostics", "SELECT * FROM diag_fg")(lambda s: s.fine_gray.diagnostics)


def _tv_rank(s: Study) -> DataFrame:
    found = cox.information_rank(s.intervals)
    return s.spark.createDataFrame([tuple(found.values())], list(found))


query(
    "tv_information_rank",
    f"""SELECT count(*) FILTER (WHERE v>1e-10*most) AS initial_information_matrix_rank,
  {len(TV_PREDICTORS)}::BIGINT AS initial_information_matrix_dimension,
  (SELECT bool_and(isfinite(v)) FROM info_tv_0) AS initial_information_matrix_all_finite,
  (SELECT bool_and(isfinite(v)) FROM grad_tv_0) AS initial_gradient_all_finite
FROM rank_tv""",
)(_tv_rank)


def _expansion(s: Study) -> DataFrame:
    return fine_gray.audit_expansion(
        fine_gray.expand_fine_gray(s.complete, s.fine_gray.fit.sums), s.complete
    )


query("fine_gray_expansion_audit", "SELECT * FROM expansion_fg")(_expansion)


def _ph(s: Study) -> DataFrame:
    variables, overall = ph_test.ph_tests(s.baseline)
    return variables.unionByName(
        overall.withColumn("variable", F.lit("GLOBAL")).select(variables.columns)
    )


query(
    "ph_tests",
    _rounded(
        "ph_rows",
        "model_type, endpoint, variable, time_transform, degrees_of_freedom, ph_status, test_method",
        "test_statistic p_value alpha",
    ),
)(_ph)
query(
    "schoenfeld_residuals",
    _rounded(
        "residuals_ph",
        "time_transform, event_row, variable",
        "analysis_time transformed_time scaled_schoenfeld_residual",
        FEWER,
    ),
    FEWER,
)(lambda s: ph_test.schoenfeld_residuals(s.baseline, s.complete))


def _drivers(s: Study) -> DataFrame:
    tables = {
        f"cause_specific_{cause.lower()}_results": model.coefficients
        for cause, model in s.cause_specific.items()
    }
    tables["fine_gray_default_results"] = s.fine_gray.coefficients
    tables["cox_results"] = s.baseline.coefficients
    tables["time_varying_cox_results"] = s.time_varying.coefficients
    view = reads.driver_view(projections.risk_driver_results(tables, PROV))
    return view.withColumn(
        "evidence", reads.evidence_label(F.col("p_value"), F.col("ci_low"), F.col("ci_high"))
    )


query(
    "risk_driver_view",
    f"""SELECT model, '1' AS model_version, upper(endpoint[1])||lower(endpoint[2:]) AS endpoint, variable,
  {', '.join(rnd(c) for c in ['coefficient', 'standard_error', 'hazard_ratio',
                              'subdistribution_hazard_ratio', 'p_value'])},
  {rnd('ci_lower', 'ci_low')}, {rnd('ci_upper', 'ci_high')}, {PROV_SQL}, model_type,
  {rnd('coalesce(subdistribution_hazard_ratio,hazard_ratio)', 'hr_shr')},
  CASE WHEN coefficient>0 THEN 'increase' WHEN coefficient<0 THEN 'decrease' ELSE 'neutral' END AS direction,
  CASE WHEN (p_value<0.05)<>(ci_lower>1 OR ci_upper<1) THEN 'P_VALUE_AND_CI_DISAGREE'
    WHEN p_value<0.05 THEN 'NOMINAL_EVIDENCE' ELSE 'INSUFFICIENT_EVIDENCE' END AS evidence
FROM all_coefs""",
)(_drivers)


def _diagnostics(s: Study) -> DataFrame:
    variables, overall = ph_test.ph_tests(s.baseline)
    tables = {
        "cox_diagnostics": s.baseline.diagnostics,
        "ph_diagnostics": variables,
        "ph_global_diagnostics": overall,
        "time_varying_cox_diagnostics": s.time_varying.diagnostics,
        "fine_gray_default_diagnostics": s.fine_gray.diagnostics,
    }
    tables |= {
        f"cause_specific_{cause.lower()}_diagnostics": model.diagnostics
        for cause, model in s.cause_specific.items()
    }
    return reads.diagnostics_view(projections.model_diagnostics(tables, PROV))


query(
    "diagnostics_view",
    f"""SELECT model, '1' AS model_version, diagnostic_type, upper(endpoint) AS endpoint, predictor, status,
  {rnd('test_statistic')}, degrees_of_freedom, {rnd('p_value')}, alpha, convergence_status, convergence_warning,
  n_observations, n_events, n_censored, n_predictors, delayed_entry_count, {PROV_SQL}, model_name,
  diagnostic_type AS diagnostic_name, coalesce(predictor,status) AS metric, {rnd('p_value', 'value')},
  status AS interpretation
FROM all_diagnostics""",
)(_diagnostics)


def _fitted_scores(s: Study) -> DataFrame:
    hazards = scoring.hazards_of(s.cause_specific)
    scored = scoring.score_horizons(s.complete.select("loan_id", *CORE_PREDICTORS), hazards)
    return scoring.supported_horizons(scored, hazards)


query(
    "fitted_profile_scores",
    f"""SELECT loan_id, fico, original_loan_term, horizon_months::INTEGER AS horizon_months,
  {', '.join(rnd(c, digits=FEWER) for c in ['original_ltv', 'original_dti', 'original_interest_rate',
                                            'default_cif', 'prepay_cif', 'survival'])}
FROM scored_cs JOIN complete USING (loan_id)
WHERE horizon_months<=original_loan_term AND horizon_months<=(SELECT last FROM last_cs)""",
    FEWER,
)(_fitted_scores)
query(
    "temporal_validation",
    _rounded(
        "validated_tr",
        "horizon_months, n_eligible, observed_defaults, observed_prepayments, enough_loans",
        "multiclass_brier log_loss mean_predicted_default mean_observed_default",
    ),
)(lambda s: scoring.temporal_validation(s.complete))
