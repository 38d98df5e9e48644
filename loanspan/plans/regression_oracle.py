"""Reference SQL of the regression family: Newton's method on Efron's partial likelihood.

Each model is a chain of views that restates it by definition: every loan stands in the risk set of
every event month it is present in, every tied step is a row, and each Newton step is an aggregate
followed by Gauss-Jordan elimination. Nothing is shared with the Spark code, which adds months by
differences, ties in closed form and never lays out a risk set.

Views of a model `m`: rows_m (g, id, entry, exit, ev), x_m (id, i, x), risk_m (g, id, t, wt, dead),
then for each step 0 .. STEPS: b (coefficients), sums, sys (information with the gradient in column
0), and the results fit_m, inv_m (inverse information) and ll_m.
"""

from __future__ import annotations

from loanspan.contracts import CORE_PREDICTORS, TV_PREDICTORS
from loanspan.plans.oracle import VIEWS

#: Newton steps; each doubles the number of right digits once the first are right.
STEPS = 8
TV_PENALTY = 0.1
#: 97.5 % point of the normal distribution.
Z = 1.959963984540054


def two_sided(x: str) -> str:
    """Two-sided tail probability of a normal value, by Simpson's rule over nine units."""
    n, width = 9000, 9.0
    f = f"exp(-power(abs({x})+k*{width / n},2)/2)*CASE WHEN k=0 OR k={n} THEN 1 WHEN k%2=1 THEN 4 ELSE 2 END"
    return (
        f"(2/sqrt(2*pi())*{width / n}/3*list_sum(list_transform(range({n + 1}), lambda k: {f})))"
    )


def chi_square_tail(x: str, degrees: int) -> str:
    """Upper tail for an odd number of degrees of freedom."""
    tail, term = two_sided(f"sqrt({x})"), f"sqrt(2*({x})/pi())*exp(-({x})/2)"
    for k in range(1, degrees, 2):
        tail = f"{tail}+{term}"
        term = f"{term}*({x})/{k + 2}"
    return f"({tail})"


def eliminate(name: str, source: str, n: int) -> str:
    """Views that solve `source` (g, i, j, v): columns behind the n-th become the solutions.

    Returns the name of the last one. The systems are positive definite, so no rows are exchanged.
    """
    before = source
    for k in range(1, n + 1):
        after = f"{name}_e{k}"
        VIEWS[after] = f"""
SELECT a.g, a.i, a.j, CASE WHEN a.i={k} THEN a.v/p.v ELSE a.v-c.v*r.v/p.v END AS v
FROM {before} a JOIN {before} p ON p.g=a.g AND p.i={k} AND p.j={k}
  JOIN {before} r ON r.g=a.g AND r.i={k} AND r.j=a.j
  JOIN {before} c ON c.g=a.g AND c.i=a.i AND c.j={k}"""
        before = after
    return before


def _long(source: str, key: str, names: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT {key} AS id, {i} AS i, ({n})::DOUBLE AS x FROM {source}" for i, n in enumerate(names, 1)
    )


def model_views(m: str, p: int, penalty: str = "0") -> None:
    """All views of model `m` behind rows_m, x_m and risk_m; `penalty` is an expression."""
    VIEWS[f"scale_{m}"] = f"SELECT i, avg(x) AS m, stddev_samp(x) AS s FROM x_{m} GROUP BY i"
    VIEWS[f"z_{m}"] = f"SELECT id, i, (x-m)/s AS z FROM x_{m} JOIN scale_{m} USING (i)"
    VIEWS[f"zz_{m}"] = f"""
SELECT id, a.i, b.i AS j, a.z*b.z AS zz FROM z_{m} a JOIN z_{m} b USING (id) WHERE b.i>=a.i"""
    VIEWS[f"b_{m}_0"] = f"SELECT g, i, 0.0::DOUBLE AS b FROM (SELECT DISTINCT g FROM rows_{m}), scale_{m}"
    for k in range(STEPS + 1):
        VIEWS[f"w_{m}_{k}"] = f"""
SELECT r.g, r.id, r.t, r.dead, r.wt*e.w AS w
FROM risk_{m} r JOIN (SELECT g, id, exp(sum(z*b)) AS w FROM z_{m} JOIN b_{m}_{k} USING (i) GROUP BY g, id) e
  ON e.g=r.g AND e.id=r.id"""
        VIEWS[f"s0_{m}_{k}"] = f"""
SELECT g, t, sum(w) AS s, sum(w) FILTER (WHERE dead) AS d, count(*) FILTER (WHERE dead) AS n
FROM w_{m}_{k} GROUP BY g, t"""
        VIEWS[f"s1_{m}_{k}"] = f"""
SELECT g, t, i, sum(w*z) AS s, sum(w*z) FILTER (WHERE dead) AS d, sum(z) FILTER (WHERE dead) AS e
FROM w_{m}_{k} JOIN z_{m} USING (id) GROUP BY g, t, i"""
        VIEWS[f"s2_{m}_{k}"] = f"""
SELECT g, t, i, j, sum(w*zz) AS s, sum(w*zz) FILTER (WHERE dead) AS d
FROM w_{m}_{k} JOIN zz_{m} USING (id) GROUP BY g, t, i, j"""
        VIEWS[f"tie_{m}_{k}"] = f"""
SELECT g, t, any_value(n) AS n, sum(ln(x)) AS lg, sum(1/x) AS a, sum(f/x) AS af, sum(1/(x*x)) AS q,
  sum(f/(x*x)) AS qf, sum(f*f/(x*x)) AS qff
FROM (SELECT g, t, n, k/n AS f, s-k/n*d AS x FROM s0_{m}_{k}, unnest(range(n)) u(k)) GROUP BY g, t"""
        VIEWS[f"res_{m}_{k}"] = f"""
SELECT g, t, i, e-(s*a-d*af) AS r, (s*a-d*af)/n AS mean FROM s1_{m}_{k} JOIN tie_{m}_{k} USING (g, t)"""
        VIEWS[f"half_{m}_{k}"] = f"""
SELECT o.g, o.t, o.i, o.j, o.s*a-o.d*af-(x.s*y.s*q-(x.s*y.d+x.d*y.s)*qf+x.d*y.d*qff) AS v
FROM s2_{m}_{k} o JOIN s1_{m}_{k} x ON x.g=o.g AND x.t=o.t AND x.i=o.i
  JOIN s1_{m}_{k} y ON y.g=o.g AND y.t=o.t AND y.i=o.j
  JOIN tie_{m}_{k} h ON h.g=o.g AND h.t=o.t"""
        VIEWS[f"cov_{m}_{k}"] = f"""
SELECT g, t, i, j, v FROM half_{m}_{k} UNION ALL SELECT g, t, j, i, v FROM half_{m}_{k} WHERE i<>j"""
        VIEWS[f"info_{m}_{k}"] = f"""
SELECT g, i, j, sum(v)+CASE WHEN i=j THEN ({penalty}) ELSE 0 END AS v FROM cov_{m}_{k} GROUP BY g, i, j"""
        VIEWS[f"grad_{m}_{k}"] = f"""
SELECT g, i, sum(r)-({penalty})*any_value(b) AS v FROM res_{m}_{k} JOIN b_{m}_{k} USING (g, i) GROUP BY g, i"""
        if k == STEPS:
            break
        VIEWS[f"sys_{m}_{k}"] = f"""
SELECT g, i, j, v FROM info_{m}_{k} UNION ALL SELECT g, i, 0, v FROM grad_{m}_{k}"""
        solved = eliminate(f"sol_{m}_{k}", f"sys_{m}_{k}", p)
        VIEWS[f"b_{m}_{k + 1}"] = f"""
SELECT g, i, b+v AS b FROM b_{m}_{k} JOIN (SELECT g, i, v FROM {solved} WHERE j=0) USING (g, i)"""
    VIEWS[f"wide_{m}"] = f"""
SELECT g, i, j, v FROM info_{m}_{STEPS}
UNION ALL SELECT g, i, {p}+j, CASE WHEN i=j THEN 1.0 ELSE 0.0 END FROM info_{m}_{STEPS}"""
    inverse = eliminate(f"invert_{m}", f"wide_{m}", p)
    VIEWS[f"inv_{m}"] = f"SELECT g, i, j-{p} AS j, v FROM {inverse} WHERE j>{p}"
    VIEWS[f"ll_{m}"] = f"""
SELECT g, eta-lg-pen AS ll FROM
  (SELECT g, sum(e*b) AS eta FROM s1_{m}_{STEPS} JOIN b_{m}_{STEPS} USING (g, i) GROUP BY g)
  JOIN (SELECT g, sum(lg) AS lg FROM tie_{m}_{STEPS} GROUP BY g) USING (g)
  JOIN (SELECT g, ({penalty})/2*sum(b*b) AS pen FROM b_{m}_{STEPS} GROUP BY g) USING (g)"""


def _present(m: str) -> str:
    return f"""
SELECT r.g, r.id, e.t, 1.0::DOUBLE AS wt, r.ev=1 AND r.exit=e.t AS dead
FROM rows_{m} r JOIN (SELECT DISTINCT g, exit AS t FROM rows_{m} WHERE ev=1) e
  ON e.g=r.g AND r.entry<e.t AND e.t<=r.exit"""


# Baseline and cause-specific models: the baseline is the default one under another name.
VIEWS["rows_cs"] = """
SELECT c.g, loan_id AS id, entry_time_month AS entry, exit_time_month AS exit, (event_type=c.g)::INT AS ev
FROM complete, (VALUES ('DEFAULT'),('PREPAYMENT')) c(g)"""
VIEWS["x_cs"] = _long("complete", "loan_id", CORE_PREDICTORS)
VIEWS["risk_cs"] = _present("cs")
model_views("cs", len(CORE_PREDICTORS))

# The same on the training vintages, for the temporal validation.
VIEWS["train_cases"] = "SELECT * FROM complete WHERE vintage_year<=2020"
VIEWS["rows_tr"] = VIEWS["rows_cs"].replace("complete", "train_cases")
VIEWS["x_tr"] = _long("train_cases", "loan_id", CORE_PREDICTORS)
VIEWS["risk_tr"] = _present("tr")
model_views("tr", len(CORE_PREDICTORS))

# Time-varying model: start-stop intervals, lagged state and a ridge penalty for each interval.
LAGGED = {
    "lag_current_actual_upb": "current_actual_upb",
    "lag_current_interest_rate": "current_interest_rate",
    "lag_dq_1m": "(coalesce(st,'')='01')::INT",
    "lag_dq_2m": "(coalesce(st,'')='02')::INT",
}
VIEWS["tv_rows"] = "SELECT *, loan_id||':'||start_time_month AS iid FROM intervals"
VIEWS["rows_tv"] = """
SELECT 'default' AS g, iid AS id, start_time_month AS entry, stop_time_month AS exit, default_event AS ev
FROM tv_rows"""
VIEWS["x_tv"] = _long("tv_rows", "iid", [LAGGED.get(n, n) for n in TV_PREDICTORS])
VIEWS["risk_tv"] = _present("tv")
model_views("tv", len(TV_PREDICTORS), f"(SELECT {TV_PENALTY}*count(*) FROM intervals)")

# Fine-Gray: prepaid loans stay at risk with a weight that follows censoring and late entry.
VIEWS["rows_fg"] = """
SELECT 'DEFAULT' AS g, loan_id AS id, entry_time_month AS entry, exit_time_month AS exit,
  (event_type='DEFAULT')::INT AS ev, event_type AS kind FROM complete"""
VIEWS["x_fg"] = _long("complete", "loan_id", CORE_PREDICTORS)
VIEWS["months_fg"] = """
SELECT s, CASE WHEN after_all>0 THEN
    CASE WHEN 1-entered/after_all>0
      THEN (1-CASE WHEN after_events>0 THEN censored/after_events ELSE 0 END)/(1-entered/after_all)
      ELSE 1 END
    ELSE 1-CASE WHEN after_events>0 THEN censored/after_events ELSE 0 END END AS rho
FROM (SELECT s, censored, entered, here-events AS after_events, here-events-censored+entered AS after_all
  FROM (SELECT u.s, count(*) FILTER (WHERE entry<u.s AND exit>=u.s) AS here,
      count(*) FILTER (WHERE exit=u.s AND kind='CENSOR') AS censored,
      count(*) FILTER (WHERE exit=u.s AND kind<>'CENSOR') AS events,
      count(*) FILTER (WHERE entry=u.s) AS entered
    FROM rows_fg, (SELECT unnest(range(0,(SELECT max(exit)+1 FROM rows_fg))) AS s) u GROUP BY u.s))"""
VIEWS["carried_fg"] = """
SELECT u.t AS u, e.t, product(rho) AS wt
FROM (SELECT DISTINCT exit AS t FROM rows_fg WHERE kind='PREPAYMENT') u
  JOIN (SELECT DISTINCT exit AS t FROM rows_fg WHERE ev=1) e ON e.t>u.t
  JOIN months_fg m ON m.s>=u.t AND m.s<e.t
GROUP BY u.t, e.t"""
VIEWS["risk_fg"] = f"""{_present('fg')}
UNION ALL SELECT r.g, r.id, c.t, c.wt, false FROM rows_fg r JOIN carried_fg c ON c.u=r.exit
WHERE r.kind='PREPAYMENT'"""
model_views("fg", len(CORE_PREDICTORS))
VIEWS["score_fg"] = f"""
SELECT f.id, f.i, f.own-f.cum AS u FROM (
  SELECT w.id, z.i, coalesce(sum(z.z-r.mean) FILTER (WHERE w.dead),0) AS own,
    sum(w.w*CASE WHEN w.dead
      THEN z.z*(h.a-h.af)-(s.s*(h.q-h.qf)-s.d*(h.qf-h.qff))
      ELSE z.z*h.a-(s.s*h.q-s.d*h.qf) END) AS cum
  FROM w_fg_{STEPS} w JOIN z_fg z USING (id) JOIN tie_fg_{STEPS} h ON h.t=w.t
    JOIN s1_fg_{STEPS} s ON s.t=w.t AND s.i=z.i JOIN res_fg_{STEPS} r ON r.t=w.t AND r.i=z.i
  GROUP BY w.id, z.i) f"""
VIEWS["robust_fg"] = """
SELECT a.g, a.i, b.j, sum(a.v*o.v*b.v) AS v
FROM inv_fg a JOIN (SELECT x.i, y.i AS j, sum(x.u*y.u) AS v
    FROM score_fg x JOIN score_fg y USING (id) GROUP BY x.i, y.i) o ON o.i=a.j
  JOIN inv_fg b ON b.i=o.j
GROUP BY a.g, a.i, b.j"""
VIEWS["runs_fg"] = """
SELECT u, count(*) AS runs FROM (
  SELECT u, t, wt, lag(wt) OVER (PARTITION BY u ORDER BY t) AS before FROM carried_fg)
WHERE before IS NULL OR abs(wt-before)>1e-12 GROUP BY u"""

# Tests of proportional hazards for the baseline model.
VIEWS["exits_ph"] = """
SELECT exit AS t, count(*) AS n, sum(ev) AS d FROM rows_cs WHERE g='DEFAULT' GROUP BY exit"""
VIEWS["events_ph"] = """
SELECT t, n, d, (SELECT count(*) FROM rows_cs r WHERE r.g='DEFAULT' AND r.entry<e.t AND r.exit>=e.t) AS here
FROM exits_ph e WHERE d>0"""
VIEWS["transform_ph"] = """
SELECT 'rank' AS tr, t, d, (SELECT coalesce(sum(x.n),0) FROM exits_ph x WHERE x.t<e.t)+(n+1)/2 AS g
FROM events_ph e
UNION ALL SELECT 'km', t, d,
  1-coalesce((SELECT product(1-x.d/x.here) FROM events_ph x WHERE x.t<e.t),1) FROM events_ph e"""
VIEWS["centered_ph"] = """
SELECT tr, t, g-sum(g*d) OVER (PARTITION BY tr)/sum(d) OVER (PARTITION BY tr) AS c, g FROM transform_ph"""
VIEWS["moments_ph"] = f"""
SELECT tr, i, j, sum(c*v) AS v1, sum(c*c*v) AS v2 FROM centered_ph JOIN cov_cs_{STEPS} USING (t)
WHERE cov_cs_{STEPS}.g='DEFAULT' GROUP BY tr, i, j"""
VIEWS["scores_ph"] = f"""
SELECT tr, i, sum(c*r) AS u FROM centered_ph JOIN res_cs_{STEPS} USING (t)
WHERE res_cs_{STEPS}.g='DEFAULT' GROUP BY tr, i"""
VIEWS["schur_ph"] = """
SELECT a.tr, a.i, a.j, any_value(a.v2)-sum(l.v1*n.v*r.v1) AS v
FROM moments_ph a JOIN moments_ph l ON l.tr=a.tr AND l.j=a.i
  JOIN moments_ph r ON r.tr=a.tr AND r.j=a.j
  JOIN inv_cs n ON n.g='DEFAULT' AND n.i=l.i AND n.j=r.i
GROUP BY a.tr, a.i, a.j"""
VIEWS["system_ph"] = """
SELECT tr AS g, i, j, v FROM schur_ph UNION ALL SELECT tr, i, 0, u FROM scores_ph"""
_SOLVED = eliminate("solve_ph", "system_ph", len(CORE_PREDICTORS))
VIEWS["tests_ph"] = f"""
SELECT tr, i, u*u/v AS chi, 1 AS df FROM scores_ph JOIN schur_ph USING (tr, i) WHERE i=j
UNION ALL SELECT tr, 0, sum(u*v), {len(CORE_PREDICTORS)} FROM scores_ph
  JOIN (SELECT g AS tr, i, v FROM {_SOLVED} WHERE j=0) USING (tr, i) GROUP BY tr"""

# Harrell's index: an event against every later exit, and censored exits of its own month.
VIEWS["eta_cs"] = f"""
SELECT z.id, b.g, sum(z*b) AS eta FROM z_cs z JOIN b_cs_{STEPS} b USING (i) GROUP BY z.id, b.g"""
VIEWS["harrell_cs"] = """
SELECT a.g, sum(CASE WHEN ea.eta-eb.eta>1e-9 THEN 1.0 WHEN abs(ea.eta-eb.eta)<=1e-9 THEN 0.5 ELSE 0.0 END)
  /count(*) AS c
FROM rows_cs a JOIN rows_cs b ON b.g=a.g AND (b.exit>a.exit OR (b.exit=a.exit AND b.ev=0))
  JOIN eta_cs ea ON ea.g=a.g AND ea.id=a.id JOIN eta_cs eb ON eb.g=b.g AND eb.id=b.id
WHERE a.ev=1 GROUP BY a.g"""


def _named(names: list[str]) -> str:
    values = ",".join(f"({i},'{n}')" for i, n in enumerate(names, 1))
    return f"(VALUES {values}) names(i, variable)"


def _coefficients(m: str, kind: str, endpoint: str, names, ratio: str, covariance: str, where="true") -> str:
    low, high = f"exp(b-{Z}*se)", f"exp(b+{Z}*se)"
    return f"""
SELECT '{kind}' AS model_type, {endpoint} AS endpoint, variable, b AS coefficient, exp(b) AS {ratio},
  se AS standard_error, {low} AS ci_lower, {high} AS ci_upper, {two_sided('b/se')} AS p_value,
  b/se AS z_statistic
FROM (SELECT g, variable, b/s AS b, sqrt(v)/s AS se FROM b_{m}_{STEPS} JOIN scale_{m} USING (i)
    JOIN (SELECT g, i, v FROM {covariance} WHERE i=j) USING (g, i) JOIN {_named(names)} USING (i))
WHERE {where}"""


VIEWS["coef_base"] = _coefficients(
    "cs", "cox_ph", "'default'", CORE_PREDICTORS, "hazard_ratio", "inv_cs", "g='DEFAULT'"
)
VIEWS["coef_cause"] = _coefficients("cs", "CAUSE_SPECIFIC_COX", "g", CORE_PREDICTORS, "hazard_ratio", "inv_cs")
VIEWS["coef_tv"] = _coefficients("tv", "time_varying_cox", "g", TV_PREDICTORS, "hazard_ratio", "inv_tv")
VIEWS["coef_fg"] = _coefficients(
    "fg", "FINE_GRAY", "g", CORE_PREDICTORS, "subdistribution_hazard_ratio", "robust_fg"
)


def _diagnostics(kind: str, endpoint: str, where: str) -> str:
    return f"""
SELECT '{kind}' AS model_type, {endpoint} AS endpoint, count(*) AS n_observations,
  sum(ev)::BIGINT AS n_events, (count(*)-sum(ev))::BIGINT AS n_censored,
  {len(CORE_PREDICTORS)}::BIGINT AS n_predictors,
  count(*) FILTER (WHERE entry>0) AS delayed_entry_count, any_value(ll) AS log_likelihood,
  -2*any_value(ll)+{2 * len(CORE_PREDICTORS)} AS partial_aic, any_value(c) AS concordance_index,
  'PASS' AS convergence_status, '' AS convergence_warning
FROM rows_cs JOIN ll_cs USING (g) JOIN harrell_cs USING (g) WHERE {where} GROUP BY g"""


VIEWS["diag_base"] = _diagnostics("cox_ph", "'default'", "g='DEFAULT'")
VIEWS["diag_cause"] = _diagnostics("CAUSE_SPECIFIC_COX", "g", "true")
VIEWS["diag_tv"] = f"""
SELECT 'time_varying_cox' AS model_type, 'default' AS endpoint, sum(n)::BIGINT AS n_intervals,
  count(*) AS n_loans, sum(ev)::BIGINT AS n_events, (count(*)-sum(ev))::BIGINT AS n_censored_loans,
  {len(TV_PREDICTORS)}::BIGINT AS n_predictors, count(*) FILTER (WHERE first_start>0) AS n_delayed_entry_loans,
  sum(gaps)::BIGINT AS n_gap_intervals, max(longest)::INTEGER AS max_interval_length_months,
  {TV_PENALTY}::DOUBLE AS l2_penalizer, 'model_based' AS variance_type,
  (SELECT ll FROM ll_tv) AS log_likelihood, (SELECT -2*ll+{2 * len(TV_PREDICTORS)} FROM ll_tv) AS partial_aic,
  'PASS' AS convergence_status, '' AS convergence_warning
FROM (SELECT loan_id, count(*) AS n, sum(default_event) AS ev, min(start_time_month) AS first_start,
    count(*) FILTER (WHERE gap_interval_flag) AS gaps, max(interval_length_months) AS longest
  FROM intervals GROUP BY loan_id)"""
VIEWS["diag_fg"] = f"""
SELECT 'FINE_GRAY' AS model_type, 'DEFAULT' AS endpoint, count(*) AS n_input_loans,
  (count(*)+coalesce(sum(runs) FILTER (WHERE kind='PREPAYMENT'),0))::BIGINT AS n_expanded_rows,
  sum(ev)::BIGINT AS n_default, count(*) FILTER (WHERE kind='PREPAYMENT') AS n_prepayment,
  count(*) FILTER (WHERE kind='CENSOR') AS n_censored, {len(CORE_PREDICTORS)}::BIGINT AS n_predictors,
  count(*) FILTER (WHERE entry>0) AS n_delayed_entry,
  'subject_clustered_robust_sandwich' AS variance_type, 'PASS' AS convergence_status,
  '' AS convergence_warning
FROM rows_fg LEFT JOIN runs_fg ON runs_fg.u=rows_fg.exit"""
VIEWS["ph_rows"] = f"""
SELECT 'cox_ph' AS model_type, 'default' AS endpoint, coalesce(variable,'GLOBAL') AS variable, tr AS time_transform, chi AS test_statistic,
  df AS degrees_of_freedom, p AS p_value, 0.05::DOUBLE AS alpha,
  CASE WHEN p<0.05 THEN 'FLAGGED' ELSE 'PASS' END AS ph_status, 'score_test' AS test_method
FROM (SELECT *, CASE WHEN i=0 THEN {chi_square_tail('chi', len(CORE_PREDICTORS))}
    ELSE {chi_square_tail('chi', 1)} END AS p FROM tests_ph) LEFT JOIN {_named(CORE_PREDICTORS)} USING (i)"""
VIEWS["residuals_ph"] = f"""
SELECT e.event_row, e.t::DOUBLE AS analysis_time, c.tr AS time_transform, c.g AS transformed_time, names.variable,
  any_value(b.b/s.s)+any_value(d.d)*sum((x.x-(r.mean*si.s+si.m))*v.v/(s.s*si.s)) AS scaled_schoenfeld_residual
FROM (SELECT loan_id AS id, exit_time_month AS t, row_number() OVER
      (ORDER BY exit_time_month, substr(md5(loan_id),1,3), loan_id) AS event_row
    FROM complete WHERE event_type='DEFAULT') e
  JOIN centered_ph c ON c.t=e.t
  JOIN b_cs_{STEPS} b ON b.g='DEFAULT' JOIN {_named(CORE_PREDICTORS)} ON names.i=b.i
  JOIN scale_cs s ON s.i=b.i
  JOIN x_cs x ON x.id=e.id JOIN scale_cs si ON si.i=x.i
  JOIN res_cs_{STEPS} r ON r.g='DEFAULT' AND r.t=e.t AND r.i=x.i
  JOIN inv_cs v ON v.g='DEFAULT' AND v.i=x.i AND v.j=b.i
  CROSS JOIN (SELECT sum(d) AS d FROM events_ph) d
GROUP BY e.event_row, e.t, c.tr, c.g, names.variable"""
VIEWS["rank_tv"] = " UNION ALL ".join(
    ["SELECT 1 AS k, v, (SELECT max(v) FROM info_tv_0) AS most FROM start_tv WHERE i=1 AND j=1"]
    + [
        f"SELECT {k} AS k, v, (SELECT max(v) FROM info_tv_0) AS most FROM plain_tv_e{k - 1} WHERE i={k} AND j={k}"
        for k in range(2, len(TV_PREDICTORS) + 1)
    ]
)
# Without the penalty, from zero coefficients.
VIEWS["start_tv"] = """
SELECT g, i, j, sum(v) AS v FROM cov_tv_0 GROUP BY g, i, j"""
eliminate("plain_tv", "start_tv", len(TV_PREDICTORS) - 1)

# Expanded rows of the Fine-Gray model: a loan's own interval, then one for each run of its weight.
VIEWS["expanded_fg"] = """
SELECT id, entry AS lo, exit AS hi, ev AS status, 1.0 AS wt FROM rows_fg
UNION ALL SELECT r.id, c.lo, c.hi, 0, c.wt FROM rows_fg r JOIN (
  SELECT u, run, coalesce(lag(max(t)) OVER (PARTITION BY u ORDER BY run),u) AS lo, max(t) AS hi, min(wt) AS wt
  FROM (SELECT u, t, wt, sum(fresh::INT) OVER (PARTITION BY u ORDER BY t) AS run FROM (
    SELECT u, t, wt, coalesce(abs(wt-lag(wt) OVER (PARTITION BY u ORDER BY t))>1e-12,true) AS fresh
    FROM carried_fg)) GROUP BY u, run) c ON c.u=r.exit WHERE r.kind='PREPAYMENT'"""
VIEWS["expansion_fg"] = """
SELECT count(*) AS n_expanded_rows, count(DISTINCT e.id) FILTER (WHERE hi>exit) AS n_competing_extended,
  count(*) FILTER (WHERE hi<=lo) AS invalid_interval,
  count(*) FILTER (WHERE NOT (isfinite(wt) AND wt>=0)) AS invalid_weight,
  count(*) FILTER (WHERE status NOT IN (0,1)) AS invalid_status,
  count(*) FILTER (WHERE r.id IS NULL) AS unmapped_rows,
  count(*) FILTER (WHERE lo<entry) AS lost_delayed_entry,
  count(*) FILTER (WHERE hi>exit AND kind<>'PREPAYMENT') AS extended_without_prepayment
FROM expanded_fg e LEFT JOIN rows_fg r USING (id)"""


def _scored(m: str, profiles: str, horizons=(12, 24, 36)) -> str:
    """Incidences and survival of `profiles` at the horizons, from the hazards of model `m`."""
    step = f"SELECT t, g, n/s AS h FROM s0_{m}_{STEPS} WHERE n>0"
    values = ",".join(f"({h})" for h in horizons)
    score = " + ".join(
        f"({n}-(SELECT m FROM scale_{m} WHERE i={i}))*"
        f"(SELECT b/s FROM b_{m}_{STEPS} JOIN scale_{m} USING (i) WHERE i={i} AND g='%s')"
        for i, n in enumerate(CORE_PREDICTORS, 1)
    )
    return f"""
SELECT p.loan_id, v.h AS horizon_months,
  coalesce(sum(exp(-before)*(1-exp(-a))*d/a) FILTER (WHERE t<=v.h),0) AS default_cif,
  coalesce(sum(exp(-before)*(1-exp(-a))*q/a) FILTER (WHERE t<=v.h),0) AS prepay_cif,
  exp(-coalesce(sum(a) FILTER (WHERE t<=v.h),0)) AS survival
FROM (SELECT loan_id, t, rd*hd AS d, rp*hp AS q, rd*hd+rp*hp AS a,
    coalesce(sum(rd*hd+rp*hp) OVER (PARTITION BY loan_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before
  FROM (SELECT loan_id, exp({score % (('DEFAULT',) * 5)}) AS rd, exp({score % (('PREPAYMENT',) * 5)}) AS rp
    FROM {profiles})
  CROSS JOIN (SELECT t, coalesce(max(h) FILTER (WHERE g='DEFAULT'),0) AS hd,
      coalesce(max(h) FILTER (WHERE g='PREPAYMENT'),0) AS hp FROM ({step}) GROUP BY t)) p
  CROSS JOIN (VALUES {values}) v(h)
GROUP BY p.loan_id, v.h"""


VIEWS["scored_cs"] = _scored("cs", "complete")
VIEWS["last_cs"] = f"""
SELECT min(t) AS last FROM (SELECT g, max(t) AS t FROM s0_cs_{STEPS} WHERE n>0 GROUP BY g)"""
VIEWS["later_cases"] = "SELECT * FROM complete WHERE vintage_year=2021"
VIEWS["scored_tr"] = _scored("tr", "later_cases")
VIEWS["judged_tr"] = """
SELECT h, yd, yp, 1-yd-yp AS ys, cd/(cd+cp+cs) AS qd, cp/(cd+cp+cs) AS qp, cs/(cd+cp+cs) AS qs
FROM (SELECT horizon_months AS h, least(greatest(default_cif,1e-12),1.0) AS cd,
    least(greatest(prepay_cif,1e-12),1.0) AS cp, least(greatest(survival,1e-12),1.0) AS cs,
    (event_type='DEFAULT' AND duration_months<=horizon_months)::INT AS yd,
    (event_type='PREPAYMENT' AND duration_months<=horizon_months)::INT AS yp, duration_months
  FROM scored_tr JOIN later_cases USING (loan_id))
WHERE duration_months>=h OR yd=1 OR yp=1"""
VIEWS["validated_tr"] = """
SELECT h::INTEGER AS horizon_months, count(*) AS n_eligible, sum(yd)::BIGINT AS observed_defaults,
  sum(yp)::BIGINT AS observed_prepayments,
  avg(power(qd-yd,2)+power(qp-yp,2)+power(qs-ys,2)) AS multiclass_brier,
  -avg(ln(CASE WHEN yd=1 THEN qd WHEN yp=1 THEN qp ELSE qs END)) AS log_loss,
  avg(qd) AS mean_predicted_default, avg(yd) AS mean_observed_default, count(*)>=1000 AS enough_loans
FROM judged_tr GROUP BY h"""

# Published views over all models.
_MODELS = {
    "coef_base": ("BASELINE_COX", "Cox PH"),
    "coef_tv": ("TV_COX", "Time-varying Cox"),
    "coef_fg": ("FINE_GRAY_DEFAULT", "Fine-Gray"),
    "coef_cause": ("CAUSE_SPECIFIC_", "Cause-specific Hazard"),
}
VIEWS["all_coefs"] = "\nUNION ALL ".join(
    f"SELECT '{model}'||CASE WHEN '{view}'='coef_cause' THEN endpoint ELSE '' END AS model, '{label}' AS model_type,"
    f" endpoint, variable, coefficient, standard_error,"
    f" {'NULL' if view == 'coef_fg' else 'hazard_ratio'}::DOUBLE AS hazard_ratio,"
    f" {'subdistribution_hazard_ratio' if view == 'coef_fg' else 'NULL'}::DOUBLE AS subdistribution_hazard_ratio,"
    f" ci_lower, ci_upper, p_value FROM {view}"
    for view, (model, label) in _MODELS.items()
)
_FIT = """SELECT '{model}'{more} AS model, '{label}' AS model_name, '{kind}'{lower} AS diagnostic_type, endpoint,
  NULL AS predictor, convergence_status AS status, NULL::DOUBLE AS test_statistic, NULL::BIGINT AS degrees_of_freedom,
  NULL::DOUBLE AS p_value, NULL::DOUBLE AS alpha, convergence_status, convergence_warning,
  {n} AS n_observations, {events} AS n_events, {censored} AS n_censored, n_predictors, {delayed} AS delayed_entry_count
FROM {view}"""


def _fit(view, model, label, kind, by_cause=False, n="n_observations", events="n_events",
         censored="n_censored", delayed="delayed_entry_count"):
    more, lower = ("||endpoint", "||lower(endpoint)") if by_cause else ("", "")
    return _FIT.format(view=view, model=model, label=label, kind=kind, more=more, lower=lower, n=n,
                       events=events, censored=censored, delayed=delayed)


VIEWS["all_diagnostics"] = "\nUNION ALL ".join(
    [
        _fit("diag_base", "BASELINE_COX", "Cox PH", "cox"),
        _fit("diag_cause", "CAUSE_SPECIFIC_", "Cause-specific Hazard", "cause_specific_", True),
        _fit("diag_tv", "TV_COX", "Time-varying Cox", "time_varying_cox", n="NULL::BIGINT",
             censored="NULL::BIGINT", delayed="NULL::BIGINT"),
        _fit("diag_fg", "FINE_GRAY_DEFAULT", "Fine-Gray", "fine_gray_default", n="NULL::BIGINT",
             events="NULL::BIGINT", delayed="NULL::BIGINT"),
        """SELECT 'BASELINE_COX', 'Cox PH', CASE WHEN variable='GLOBAL' THEN 'ph_global' ELSE 'ph' END, endpoint,
  nullif(variable,'GLOBAL'), ph_status, test_statistic, degrees_of_freedom::BIGINT, p_value, alpha, NULL, NULL,
  NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM ph_rows""",
    ]
)
