"""Contract checks on damaged tables: every rule is broken somewhere, and SQL counts how often.

A table is damaged by rules that both engines read: a column, a condition on the row's number `k` and
the value that takes its place; rows that meet `again` come twice. What a check counts is restated
in SQL on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanspan.contracts import CORE_PREDICTORS, LAG_COLUMNS, STATIC_MONTHLY
from loanspan.operators import aalen_johansen as aj
from loanspan.operators import clock, cox, dataset, events, fine_gray, horizons, intervals
from loanspan.operators import kaplan_meier as km
from loanspan.plans.oracle import VIEWS
from loanspan.plans.registry import _PANEL_SQL, _loan_months, count_if, query
from loanspan.plans.regression_oracle import LAGGED

#: The number in a loan's id, which both engines read alike.
LOAN = "cast(substr(loan_id,6,9) as int)"
KINDS = "'DEFAULT','PREPAYMENT','CENSOR'"
LATE = "'ZB02','ZB03','ZB09','ZB01_PREPAYMENT','ZB15_WHOLE_LOAN_SALE','ZB16_REPERFORMING_SECURITIZATION','ZB96_DEFECT','MATURITY'"
CODE = "CASE event_type WHEN 'DEFAULT' THEN 1 WHEN 'PREPAYMENT' THEN 2 WHEN 'CENSOR' THEN 0 END"
DEFAULT, PREPAY = "(event_type='DEFAULT')::INT", "(event_type='PREPAYMENT')::INT"
TIME = "entry_time_month>=0 AND exit_time_month>entry_time_month AND duration_months=exit_time_month"
COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in CORE_PREDICTORS)

#: Table: condition of rows that come twice, then (column, condition, value).
RULES = {
    "model": (
        "k%101=17",
        [
            ("loan_id", "k%101=1", "NULL"),
            ("entry_time_month", "k%101=2", "-1"),
            ("exit_time_month", "k%101=3", "entry_time_month"),
            ("duration_months", "k%101=4", "duration_months+1"),
            ("vintage_year", "k%101=5", "1999"),
            ("event_month", "k%101=6", "209901"),
            ("event_code", "k%101=7", "9"),
            ("competing_event_code", "k%101=8", "9"),
            ("cr_event_code", "k%101=9", "5"),
            ("default_event", "k%101=10", "1-default_event"),
            ("km_default_event", "k%101=11", "1-km_default_event"),
            ("prepayment_event", "k%101=12", "1-prepayment_event"),
            ("event_type", "k%101=13", "'OTHER'"),
            ("fico", "k%101=14", "NULL"),
            ("survival_eligible", "k%101=15", "false"),
            ("operational_origination_date", "k%101=16", "date '2030-01-01'"),
        ],
    ),
    "survival": (
        "k%97=5",
        [
            ("duration_months", "k%97=1 AND survival_eligible OR k%2=0 AND NOT survival_eligible", "0"),
            ("default_event", "k%97=3", "1-default_event"),
            ("prepayment_event", "k%97=4", "1-prepayment_event"),
        ],
    ),
    "events": (
        "k%97=5",
        [
            ("event_type", "k%97=1", "'OTHER'"),
            ("event_month", "k%97=2", "NULL"),
            ("event_month", "k%97 IN (3,4)", "last_observed_month+1"),
            ("event_source", "k%97=3", "'D90'"),
            ("event_source", "k%97=4", "'MATURITY'"),
        ],
    ),
    "perf": (
        "k%89=5",
        [
            ("reporting_period_num", "k%89=1", "reporting_period_num+1"),
            ("current_actual_upb", "k%89=2", "NULL"),
            ("current_delinquency_status", "k%89=3", "'9Z'"),
            ("loan_id", "k%89=4", "NULL"),
        ],
    ),
    "months": (
        "k%89=5",
        [
            ("reporting_period_num", "k%89=1", "reporting_period_num+1"),
            ("performance_month", "k%89=2", "NULL"),
            ("fico", "k%89=3 AND reporting_period_num%2=0", "301"),
            ("loan_id", "k%89=4", "NULL"),
            ("original_upb", "k%89=6 AND reporting_period_num%2=0", "NULL"),
        ],
    ),
    "reports": ("k%71=5", [("loan_id", "k%71=1", "NULL")]),
    "intervals": (
        "k%83=10",
        [
            ("loan_id", "k%83=1", "NULL"),
            ("start_time_month", "k%83=2", "-1"),
            ("stop_time_month", "k%83=3", "stop_time_month+1"),
            ("fico", "k%83=4", "NULL"),
            ("lag_dq_1m", "k%83=5", "2"),
            ("event_type", "k%83=6", "'OTHER'"),
            ("original_ltv", "k%83=7 AND start_time_month%2=0", "original_ltv+1"),
            ("default_event", "k%83=8 AND terminal_interval_flag", "1-default_event"),
            ("terminal_interval_flag", "k%83=9", "false"),
        ],
    ),
    "km_curve": (
        "false",
        [
            ("survival", "k%13=1", "1.5"),
            ("ci_lower", "k%13=2", "NULL"),
            ("event_probability", "k%13=3", "event_probability+0.1"),
        ],
    ),
    "aj_curve": (
        "false",
        [
            ("cumulative_incidence", "k%13=1", "-0.5"),
            ("endpoint", "k%13=2 AND endpoint='DEFAULT'", "'OTHER'"),
            ("cumulative_incidence", "k%13=4", "0.9"),
            ("model_type", "k%13=5", "'OTHER'"),
        ],
    ),
}
KEYS = {"km_curve": "analysis_time", "aj_curve": "analysis_time"}


def _cases(table: str) -> dict[str, str]:
    """Each damaged column with its replacements as one expression."""
    found: dict[str, str] = {}
    for column, condition, value in RULES[table][1]:
        found[column] = found.get(column, "") + f" WHEN {condition} THEN {value}"
    return {column: f"CASE{whens} ELSE {column} END" for column, whens in found.items()}


def damaged(df: DataFrame, table: str) -> DataFrame:
    """`df` with the damage of `table`, in its own types."""
    numbered = df.withColumn("k", F.expr(KEYS.get(table, LOAN)))
    cases = _cases(table)
    rows = numbered.select(
        *[F.expr(cases.get(c, f"`{c}`")).cast(df.schema[c].dataType).alias(c) for c in df.columns], "k"
    )
    return rows.unionByName(rows.filter(RULES[table][0])).drop("k")


def _view(name: str, table: str, source: str) -> None:
    replaced = ", ".join(f"({case}) AS {column}" for column, case in _cases(table).items())
    VIEWS[f"whole_{name}"] = f"SELECT *, {KEYS.get(table, LOAN)} AS k FROM ({source})"
    VIEWS[f"hurt_{name}"] = f"SELECT * REPLACE ({replaced}) FROM whole_{name}"
    VIEWS[f"bad_{name}"] = f"SELECT * FROM hurt_{name} UNION ALL SELECT * FROM hurt_{name} WHERE {RULES[table][0]}"


FLAGS = f"""{DEFAULT} AS default_event, {PREPAY} AS prepayment_event, {DEFAULT} AS km_default_event,
  {PREPAY} AS km_prepayment_event, event_code::INT AS competing_event_code, event_code::INT AS cr_event_code"""
_MODEL = f"SELECT * REPLACE (event_code::INT AS event_code), {FLAGS}, true AS survival_eligible FROM model"
_view("model", "model", _MODEL)
_view("complete", "model", _MODEL + " WHERE core_covariates_complete_flag")
_view(
    "survival",
    "survival",
    f"""SELECT *, {DEFAULT} AS default_event, {PREPAY} AS prepayment_event,
  survival_exclusion_reason IS NULL AS survival_eligible,
  CASE WHEN survival_exclusion_reason IS NULL THEN exit_time_month END AS duration_months FROM survival""",
)
_view("events", "events", "SELECT * FROM events")
_view("perf", "perf", "SELECT * FROM perf")
_view("reports", "reports", "SELECT * FROM clean_perf")
_STATIC = ", ".join(f"o.{c}" for c in STATIC_MONTHLY)
_view(
    "months",
    "months",
    f"""SELECT p.loan_id, p.performance_month, p.reporting_period_num, {_STATIC}
FROM perf p JOIN orig o USING (loan_id)""",
)
_LAGS = dict(LAGGED) | {
    "lag_dq_3plus": "(NOT coalesce(st,'') IN ('','00','01','02','XX','RA'))::INT",
    "lag_dq_xx": "(coalesce(st,'')='XX')::INT",
    "lag_dq_ra": "(coalesce(st,'')='RA')::INT",
}
_view("intervals", "intervals", f"SELECT *, {', '.join(f'{v} AS {c}' for c, v in _LAGS.items())} FROM intervals")
_view(
    "km",
    "km_curve",
    """SELECT gn, gv, t AS analysis_time, s AS survival, lo AS ci_lower, hi AS ci_upper,
  1-s AS event_probability FROM km_all""",
)
_view(
    "aj",
    "aj_curve",
    """SELECT 'AALEN_JOHANSEN' AS model_type, endpoint, gn, gv, t AS analysis_time,
  f AS cumulative_incidence, lo AS ci_lower, hi AS ci_upper, n AS n_at_risk FROM curve_all""",
)


def _broken(rule: str, name: str) -> str:
    """Rows that break a rule, or for which it cannot be told."""
    return count_if(f"coalesce({rule},true)", name)


TWICE = "count(*)-count(DISTINCT loan_id) AS duplicate_loans"
TWICE_KNOWN = "count(loan_id)-count(DISTINCT loan_id) AS duplicate_loans"
NO_ID = _broken("loan_id IS NULL", "missing_loan_id")
BAD_TIME = _broken(f"NOT coalesce({TIME},false)", "invalid_time")
BY_KIND = ", ".join(count_if(f"event_type='{k.upper()}'", f'"{k}"') for k in ("default", "prepayment", "censor"))

query(
    "event_map_check_damaged",
    f"""SELECT *, abs(performance_loans-loans-excluded_loans) AS unreconciled_loans FROM (
SELECT count(*) AS loans, {TWICE}, {_broken(f'event_type NOT IN ({KINDS})', 'invalid_event_type')},
  {count_if('event_month IS NULL', 'missing_event_month')},
  {_broken(f'event_month>last_observed_month AND event_source NOT IN ({LATE})', 'late_event_not_allowed')},
  {count_if(f'event_month>last_observed_month AND event_source IN ({LATE})', 'known_late_events')}, {BY_KIND},
  {count_if('same_month_default_prepay_flag', 'same_month_conflicts')},
  (SELECT count(DISTINCT loan_id) FROM clean_perf WHERE reporting_period_num<=202603) AS performance_loans,
  (SELECT count(DISTINCT loan_id) FROM clean_perf WHERE reporting_period_num<=202603
    AND zero_balance_code IS NOT NULL AND zero_balance_effective_month IS NULL) AS excluded_loans
FROM bad_events)""",
)(lambda s: events.check_event_map(damaged(s.events, "events"), s.clean_perf))

query(
    "survival_check_damaged",
    f"""SELECT {TWICE},
  {_broken('survival_eligible AND (duration_months IS NULL OR duration_months<=0)', 'eligible_nonpositive_duration')},
  {_broken('NOT survival_eligible AND duration_months IS NOT NULL', 'excluded_with_duration')},
  {_broken(f'default_event<>{DEFAULT}', 'default_flag_mismatch')},
  {_broken(f'prepayment_event<>{PREPAY}', 'prepayment_flag_mismatch')}, count(*) AS loans,
  {count_if('survival_eligible', 'eligible')}, {count_if('NOT survival_eligible', 'excluded')},
  {count_if("survival_eligible AND event_type='DEFAULT'", 'eligible_default')},
  {count_if("survival_eligible AND event_type='PREPAYMENT'", 'eligible_prepayment')},
  {count_if("survival_eligible AND event_type='CENSOR'", 'eligible_censor')} FROM bad_survival""",
)(lambda s: clock.check_survival(damaged(s.survival, "survival")))

VIEWS["whole_panel_rows"] = _PANEL_SQL.format(tie="", source="bad_reports")
query(
    "loan_age_panel_check_damaged",
    f"""SELECT *, CASE WHEN missing_loan_id+missing_time_rows+order_error_rows+duplicate_keys
    +eligible_negative_age_rows>0 THEN 'FAIL'
  WHEN negative_age_rows+reporting_gap_rows+after_exit_rows+excluded_rows>0 THEN 'PASS_WITH_WARNING'
  ELSE 'PASS' END AS status
FROM (SELECT count(*) AS rows, count(DISTINCT loan_id) AS loans, {count_if('loan_id IS NULL', 'missing_loan_id')},
    {count_if('negative_age_flag', 'negative_age_rows')}, {count_if('reporting_gap_flag', 'reporting_gap_rows')},
    {count_if('duplicate_or_order_flag', 'order_error_rows')}, {count_if('after_exit_flag', 'after_exit_rows')},
    {count_if('missing_time_flag', 'missing_time_rows')},
    {count_if('within_observation_window AND analysis_time_month<0', 'eligible_negative_age_rows')},
    {count_if('loan_id IN (SELECT loan_id FROM survival WHERE survival_exclusion_reason IS NOT NULL)', 'excluded_rows')},
    (SELECT count(*) FROM (SELECT 1 FROM whole_panel_rows GROUP BY loan_id, reporting_period_num HAVING count(*)>1))
      AS duplicate_keys
  FROM whole_panel_rows)""",
)(
    lambda s: clock.check_loan_age_panel(
        clock.build_loan_age_panel(damaged(s.clean_perf, "reports"), s.survival)
    )
)
query(
    "model_dataset_check_damaged",
    f"""SELECT {TWICE}, {_broken('loan_id IS NULL', 'missing_id')}, {BAD_TIME},
  {_broken('NOT (vintage_year BETWEEN 2016 AND 2026 AND event_month<=202603)', 'outside_scope')},
  {_broken(f'NOT (event_code={CODE} AND event_code=competing_event_code)', 'invalid_event')},
  count(*) AS rows, {count_if('core_covariates_complete_flag', 'complete_case')}, {BY_KIND} FROM bad_model""",
)(lambda s: dataset.check_model_frame(damaged(s.model, "model")))

query(
    "loan_level_check_damaged",
    f"""SELECT {TWICE_KNOWN}, {NO_ID},
  {_broken(f'''NOT (event_code={CODE} AND competing_event_code={CODE} AND cr_event_code={CODE}
    AND default_event={DEFAULT} AND km_default_event={DEFAULT} AND prepayment_event={PREPAY}
    AND km_prepayment_event={PREPAY})''', 'invalid_event')}, {BAD_TIME},
  {_broken('NOT vintage_year BETWEEN 2016 AND 2026', 'outside_cohort')},
  {_broken('NOT survival_eligible', 'not_survival_eligible')},
  {_broken(f'core_covariates_complete_flag<>({COMPLETE})', 'invalid_complete_case_flag')} FROM bad_model""",
)(lambda s: dataset.check_loan_level(damaged(s.model, "model")))

_VARY = " OR ".join(
    f"coalesce(min({c})<>max({c}),false) OR (count({c})>0 AND count({c})<count(*))" for c in STATIC_MONTHLY
)
query(
    "loan_month_check_damaged",
    f"""SELECT coalesce(sum(n) FILTER (WHERE loan_id IS NULL),0)::BIGINT AS missing_loan_id,
  sum(n-months-(unknown>0)::INT)::BIGINT AS duplicate_keys, sum(bad)::BIGINT AS invalid_reporting_month,
  {count_if('vary', 'loans_with_varying_static_columns')}
FROM (SELECT loan_id, count(*) AS n, count(DISTINCT performance_month) AS months,
    count(*) FILTER (WHERE performance_month IS NULL) AS unknown, {_VARY} AS vary,
    {count_if('coalesce(reporting_period_num<>year(performance_month)*100+month(performance_month),true)', 'bad')}
  FROM bad_months GROUP BY loan_id)""",
)(lambda s: dataset.check_loan_months(damaged(_loan_months(s), "months")))

query(
    "performance_source_check_damaged",
    f"""SELECT count(*) AS rows, {NO_ID},
  (SELECT sum(n-1)::BIGINT FROM (SELECT count(*) AS n FROM bad_perf GROUP BY loan_id, performance_month))
    AS duplicate_keys,
  {_broken('reporting_period_num<>year(performance_month)*100+month(performance_month)', 'invalid_month')},
  {_broken('current_actual_upb IS NULL OR current_interest_rate IS NULL', 'nonfinite_value')},
  {_broken('''NOT (current_delinquency_status IN ('XX','RA')
    OR regexp_full_match(current_delinquency_status,'[0-9][0-9]'))''', 'invalid_delinquency')}
FROM bad_perf""",
)(lambda s: intervals.check_performance_source(damaged(s.perf, "perf")))

_LAG_FLAGS = LAG_COLUMNS[2:]
_BAD_FLAGS = f"NOT ({' AND '.join(f'{c} IN (0,1)' for c in _LAG_FLAGS)} AND {'+'.join(_LAG_FLAGS)}<=1)"
_DIFFER = " OR ".join(f"min({c})<>max({c})" for c in CORE_PREDICTORS)
query(
    "interval_check_damaged",
    f"""SELECT sum(n)::BIGINT AS rows, {count_if('loan_id IS NULL', 'missing_loan_id')},
  {count_if('broken', 'noncontiguous_loans')}, sum(wrong)::BIGINT AS invalid_interval,
  sum(open)::BIGINT AS incomplete_predictors, sum(flags)::BIGINT AS invalid_delinquency_flags,
  sum(kinds)::BIGINT AS invalid_event_type, {count_if('differ', 'loans_with_varying_static_predictors')},
  {count_if('''defaults>0 AND defaults<n OR ev<>(defaults>0)::INT OR terminals<>1
    OR last%4<>2+(defaults>0)::INT''', 'loans_with_bad_terminal_event')}
FROM (SELECT loan_id, count(*) AS n, bool_or(start_time_month<0 OR before<>start_time_month) AS broken,
    {_broken('''NOT (start_time_month>=0 AND stop_time_month>start_time_month
      AND interval_length_months=stop_time_month-start_time_month
      AND gap_interval_flag=(interval_length_months>1))''', 'wrong')},
    {_broken(f"NOT ({COMPLETE} AND current_actual_upb IS NOT NULL AND current_interest_rate IS NOT NULL)", 'open')},
    {_broken(_BAD_FLAGS, 'flags')}, {_broken(f'event_type NOT IN ({KINDS})', 'kinds')}, {_DIFFER} AS differ,
    sum(default_event) AS ev, {count_if('terminal_interval_flag', 'terminals')},
    {count_if("event_type='DEFAULT'", 'defaults')},
    max(stop_time_month*4+terminal_interval_flag::INT*2+default_event) AS last
  FROM (SELECT *, lag(stop_time_month) OVER (PARTITION BY loan_id ORDER BY start_time_month, stop_time_month) AS before
    FROM bad_intervals) GROUP BY loan_id)""",
)(lambda s: intervals.check_intervals(damaged(s.intervals, "intervals")))

query(
    "km_input_check_damaged",
    f"""SELECT count(*) AS rows, {TWICE_KNOWN}, {NO_ID},
  {_broken(f'NOT (event_type IN ({KINDS}) AND km_default_event={DEFAULT})', 'invalid_event')}, {BAD_TIME},
  {count_if('vintage_year IS NULL', 'missing_group')} FROM bad_model""",
)(lambda s: km.check_km_input(damaged(s.model, "model"), "vintage_year"))

_IN_UNIT = " AND ".join(f"{c} BETWEEN 0 AND 1" for c in ("survival", "ci_lower", "ci_upper"))
query(
    "km_result_check_damaged",
    f"""SELECT count(*) AS rows,
  {_broken(f'''NOT ({_IN_UNIT} AND ci_lower<=survival AND survival<=ci_upper
    AND abs(event_probability-(1-survival))<=1e-12)''', 'invalid_probability')},
  {count_if('survival IS NULL OR ci_lower IS NULL OR ci_upper IS NULL OR event_probability IS NULL', 'null_rows')}
FROM bad_km""",
)(lambda s: km.check_km_results(damaged(km.fit_kaplan_meier(s.model, validate=False), "km_curve")))

query(
    "aj_input_check_damaged",
    f"""SELECT count(*) AS rows, {count_if('cr_event_code>0', 'events')}, {TWICE_KNOWN}, {NO_ID},
  {_broken(f'NOT (event_type IN ({KINDS}) AND cr_event_code={CODE})', 'invalid_event')}, {BAD_TIME}
FROM bad_model""",
)(lambda s: aj.check_aj_input(damaged(s.model, "model")))

query(
    "aj_result_check_damaged",
    f"""SELECT sum(n)::BIGINT AS rows, sum(wrong)::BIGINT AS invalid_estimates, sum(drops)::BIGINT AS decreasing_steps,
  {count_if('d<>1 OR p<>1', 'unpaired_months')}, {count_if('total>1+1e-12', 'sums_above_one')}
FROM (SELECT gn, gv, analysis_time, count(*) AS n, {count_if('fell', 'drops')},
    {count_if('''model_type<>'AALEN_JOHANSEN' OR NOT (cumulative_incidence BETWEEN 0 AND 1
      AND ci_lower BETWEEN 0 AND 1 AND ci_upper BETWEEN 0 AND 1 AND ci_lower<=cumulative_incidence
      AND cumulative_incidence<=ci_upper AND analysis_time>=0 AND n_at_risk>0)''', 'wrong')},
    {count_if("endpoint='DEFAULT'", 'd')}, {count_if("endpoint='PREPAYMENT'", 'p')},
    sum(cumulative_incidence) AS total
  FROM (SELECT *, coalesce(cumulative_incidence-lag(cumulative_incidence) OVER
      (PARTITION BY gn, gv, endpoint ORDER BY analysis_time)<-1e-12,false) AS fell FROM bad_aj)
  GROUP BY gn, gv, analysis_time)""",
)(lambda s: aj.check_aj_results(damaged(aj.fit_aalen_johansen(s.model, validate=False), "aj_curve")))

query(
    "cox_input_check_damaged",
    f"""SELECT count(*) AS rows, sum(default_event)::BIGINT AS events, {TWICE_KNOWN}, {NO_ID},
  {_broken(f'NOT (event_type IN ({KINDS}) AND default_event={DEFAULT})', 'invalid_event')}, {BAD_TIME},
  {_broken(f'NOT ({COMPLETE})', 'incomplete_predictors')}, sum(prepayment_event)::BIGINT AS prepayment_events,
  {_broken(f'prepayment_event<>{PREPAY} OR default_event+prepayment_event>1', 'invalid_prepayment')}
FROM bad_complete""",
)(lambda s: cox.check_paired_input(damaged(s.complete, "model")))

query(
    "fine_gray_input_check_damaged",
    f"""SELECT count(*) AS rows, {count_if('cr_event_code=1', 'defaults')}, {count_if('cr_event_code=2', 'prepayments')},
  {TWICE_KNOWN}, {NO_ID}, {_broken(f'NOT (event_type IN ({KINDS}) AND cr_event_code={CODE})', 'invalid_event')},
  {_broken('NOT (entry_time_month>=0 AND exit_time_month>entry_time_month)', 'invalid_time')},
  {_broken(f'NOT ({COMPLETE})', 'incomplete_predictors')} FROM bad_complete""",
)(lambda s: fine_gray.check_fine_gray_input(damaged(s.complete, "model")))

query(
    "pd_input_check_damaged",
    f"""SELECT count(*) AS rows, {count_if('cr_event_code>0', 'events')}, {TWICE_KNOWN}, {NO_ID},
  {_broken(f'NOT (event_type IN ({KINDS}) AND cr_event_code={CODE})', 'invalid_event')}, {BAD_TIME},
  {_broken("operational_origination_date>DATE '2026-03-31'", 'invalid_origin')},
  {_broken('NOT vintage_year BETWEEN 2016 AND 2026', 'invalid_vintage')} FROM bad_model""",
)(lambda s: horizons.check_pd_input(damaged(s.model, "model")))
