"""Reference SQL of the derived tables, in DuckDB's dialect.

Each view is one SELECT over the given tables and earlier views; `sql` puts the views a statement
needs in front of it. The statements restate the rules independently of the Spark code.
"""

from __future__ import annotations

import re


def idx(month: str) -> str:
    """Continuous month number of a YYYYMM integer."""
    return f"((({month})//100)*12+({month})%100)"


def ym(index: str) -> str:
    return f"(((({index})-1)//12)*100+(({index})-1)%12+1)"


def day(index: str) -> str:
    return f"make_date(((({index})-1)//12)::BIGINT, ((({index})-1)%12+1)::BIGINT, 1::BIGINT)"


def dindex(date: str) -> str:
    return f"(year({date})*12+month({date}))"


def mdate(text: str) -> str:
    return f"try_strptime({text}||'01','%Y%m%d')::DATE"


def dstr(date: str) -> str:
    return f"strftime({date},'%Y-%m-%d')"


CORE = ["fico", "original_ltv", "original_dti", "original_interest_rate", "original_loan_term"]

VIEWS = {
    "feed": """
SELECT o_custkey AS loan_key, o_orderkey AS source_row,
  ((year(o_orderdate)+21+o_custkey%6)*100+month(o_orderdate))::INTEGER AS month,
  o_totalprice AS upb,
  CASE WHEN o_orderstatus='F' AND o_orderpriority='1-URGENT' AND o_orderkey%3=0 THEN 3
       WHEN o_orderstatus='F' AND o_orderpriority='2-HIGH' THEN 2
       WHEN o_orderstatus='F' AND o_orderpriority='3-MEDIUM' THEN 1 ELSE 0 END AS dq,
  (o_orderstatus='O' AND o_orderpriority='1-URGENT' AND o_orderkey%29=0) AS ra,
  CASE WHEN o_orderstatus='P' AND o_orderpriority='5-LOW' THEN
    CASE WHEN o_orderkey%2=0 THEN '01' WHEN o_orderkey%31=1 THEN '02'
         WHEN o_orderkey%31=3 THEN '15' END END AS zb
FROM orders""",
    "months": """
SELECT loan_key, month, max(dq) AS dq, bool_or(ra) AS ra, max(zb) AS zb, round(sum(upb),2) AS upb
FROM feed GROUP BY loan_key, month""",
    "loans": f"""
SELECT loan_key, fp, fp-1 AS origin, (fp-2)//12 AS vintage,
  'F'||lpad((((fp-2)//12)%100)::VARCHAR,2,'0')||'Q'||(((fp-2)%12)//3+1)::VARCHAR
     ||lpad(loan_key::VARCHAR,9,'0') AS loan_id
FROM (SELECT loan_key,
        CASE WHEN loan_key%211=0 THEN {idx('fm')}+2 ELSE {idx('fm')}-loan_key%5+1 END AS fp
      FROM (SELECT loan_key, coalesce(min(month) FILTER (WHERE month<=202603), min(month)) AS fm
            FROM months GROUP BY loan_key))""",
    "raw_orig": f"""
SELECT loan_id,
  CASE WHEN k%37=0 THEN '9999' ELSE (300+(k*7919)%551)::VARCHAR END AS fico,
  {ym('fp')}::VARCHAR AS first_payment_date,
  {ym('fp+term')}::VARCHAR AS maturity_date,
  CASE WHEN k%43=0 THEN '999' ELSE (40+(k*31)%61+(k%3)*5)::VARCHAR END AS original_cltv,
  CASE WHEN k%41=0 THEN '999' ELSE (10+(k*19)%51)::VARCHAR END AS original_dti,
  (50000+(k*137)%450000)::VARCHAR AS original_upb,
  CASE WHEN k%59=0 THEN '999' ELSE (40+(k*31)%61)::VARCHAR END AS original_ltv,
  ((20+k%60)//10)::VARCHAR||'.'||((20+k%60)%10)::VARCHAR AS original_interest_rate,
  ['P','I','S','9'][k%4+1] AS occupancy_status, 'FRM' AS amortization_type,
  ['CA','TX','NY','FL','WA'][k%5+1] AS property_state,
  ['SF','SF','CO','PU','SF','MH','99'][k%7+1] AS property_type,
  ['P','C','N','P','N','9'][k%6+1] AS loan_purpose,
  term::VARCHAR AS original_loan_term,
  CASE WHEN k%31=0 THEN '99' ELSE (1+k%3)::VARCHAR END AS number_borrowers,
  CASE WHEN k%47=0 THEN '9999' ELSE (305+(k*7919)%541)::VARCHAR END AS vantagescore_4,
  vintage::VARCHAR AS vintage_year
FROM (SELECT *, loan_key AS k, CASE WHEN loan_key%4=0 THEN 180 ELSE 360 END AS term FROM loans)""",
    "raw_perf": f"""
SELECT loan_id, month::VARCHAR AS monthly_reporting_period,
  upb::DECIMAL(18,2)::VARCHAR AS current_actual_upb,
  CASE WHEN ra THEN 'RA' WHEN dq=0 AND (k*13+month)%97=0 THEN 'XX'
       ELSE lpad(dq::VARCHAR,2,'0') END AS delinquency_status,
  age::VARCHAR AS loan_age,
  CASE WHEN k%7=0 THEN NULL WHEN k%19=0 AND zb IS NOT NULL THEN '0'
       ELSE (term-age)::VARCHAR END AS remaining_months_maturity,
  CASE WHEN k%29=0 AND month%2=1 THEN 'Y' END AS modification_flag,
  zb AS zero_balance_code,
  CASE WHEN zb IS NOT NULL THEN month::VARCHAR END AS zero_balance_effective_date,
  ((20+k%60)//10)::VARCHAR||'.'||((20+k%60)%10)::VARCHAR AS current_interest_rate,
  {ym('mi-1')}::VARCHAR AS ddlpi,
  CASE WHEN month<201704 THEN NULL WHEN (k+month)%11=0 THEN '999'
       ELSE (40+(k*31)%61)::VARCHAR END AS estimated_ltv,
  upb::DECIMAL(18,2)::VARCHAR AS current_interest_bearing_upb,
  vintage::VARCHAR AS vintage_year
FROM (SELECT m.*, l.loan_id, l.vintage, m.loan_key AS k, {idx('m.month')} AS mi,
        {idx('m.month')}-l.origin+CASE WHEN m.loan_key%53=0 AND m.month%2=1 THEN 1 ELSE 0 END AS age,
        CASE WHEN m.loan_key%4=0 THEN 180 ELSE 360 END AS term
      FROM months m JOIN loans l USING (loan_key))""",
    "clean_orig": f"""
SELECT loan_id,
  CASE WHEN fico='9999' THEN NULL ELSE TRY_CAST(fico AS SMALLINT) END AS fico,
  CASE WHEN original_dti='999' THEN NULL ELSE TRY_CAST(original_dti AS DOUBLE) END AS original_dti,
  CASE WHEN original_ltv='999' THEN NULL ELSE TRY_CAST(original_ltv AS DOUBLE) END AS original_ltv,
  CASE WHEN original_cltv='999' THEN NULL ELSE TRY_CAST(original_cltv AS DOUBLE) END AS original_cltv,
  CASE WHEN vantagescore_4='9999' THEN NULL ELSE TRY_CAST(vantagescore_4 AS SMALLINT) END
    AS vantagescore_4,
  nullif(occupancy_status,'9') AS occupancy_status, nullif(property_type,'99') AS property_type,
  nullif(loan_purpose,'9') AS loan_purpose,
  TRY_CAST(original_upb AS DOUBLE) AS original_upb,
  TRY_CAST(original_interest_rate AS DOUBLE) AS original_interest_rate,
  TRY_CAST(original_loan_term AS SMALLINT) AS original_loan_term,
  amortization_type, property_state, TRY_CAST(vintage_year AS SMALLINT) AS vintage_year,
  first_payment_date, maturity_date,
  {mdate('first_payment_date')} AS first_payment_month, {mdate('maturity_date')} AS maturity_month,
  TRY_CAST(substr(loan_id,5,1) AS TINYINT) AS origination_quarter,
  coalesce(TRY_CAST(nullif(original_ltv,'999') AS DOUBLE)>100,false) AS ltv_above_100_flag,
  coalesce(TRY_CAST(nullif(original_cltv,'999') AS DOUBLE)>100,false) AS cltv_above_100_flag,
  (vintage_year::INT<2018 OR (vintage_year::INT=2018 AND substr(loan_id,5,1)::INT<=1))
    AS legacy_number_borrowers_encoding_flag,
  number_borrowers='99' AS number_borrowers_not_available_flag,
  CASE WHEN number_borrowers<>'99' THEN TRY_CAST(number_borrowers AS SMALLINT)>=2 END
    AS multiple_borrowers_flag,
  CASE WHEN number_borrowers='99' THEN NULL
       WHEN vintage_year::INT<2018 OR (vintage_year::INT=2018 AND substr(loan_id,5,1)::INT<=1)
         THEN CASE WHEN number_borrowers='1' THEN 1::SMALLINT END
       ELSE TRY_CAST(number_borrowers AS SMALLINT) END AS number_borrowers,
  number_borrowers AS number_borrowers_raw,
  fico='9999' AS fico_not_available_flag, original_dti='999' AS dti_not_available_flag,
  original_ltv='999' AS ltv_not_available_flag, original_cltv='999' AS cltv_not_available_flag,
  vantagescore_4='9999' AS vantagescore_not_available_flag,
  fico AS fico_raw, original_dti AS original_dti_raw, original_ltv AS original_ltv_raw,
  original_cltv AS original_cltv_raw
FROM raw_orig""",
    "clean_perf": f"""
SELECT loan_id, monthly_reporting_period,
  TRY_CAST(monthly_reporting_period AS INTEGER) AS reporting_period_num,
  {mdate('monthly_reporting_period')} AS reporting_month,
  TRY_CAST(loan_age AS SMALLINT) AS loan_age,
  TRY_CAST(remaining_months_maturity AS SMALLINT) AS remaining_months_maturity,
  TRY_CAST(current_actual_upb AS DOUBLE) AS current_actual_upb,
  TRY_CAST(current_interest_rate AS DOUBLE) AS current_interest_rate,
  TRY_CAST(delinquency_status AS SMALLINT) AS delinquency_num,
  delinquency_status='XX' AS is_xx, delinquency_status='RA' AS is_ra,
  delinquency_status AS delinquency_status_raw,
  CASE WHEN estimated_ltv='999' THEN NULL ELSE TRY_CAST(estimated_ltv AS DOUBLE) END AS estimated_ltv,
  estimated_ltv='999' AS estimated_ltv_not_available_flag, estimated_ltv AS estimated_ltv_raw,
  modification_flag, zero_balance_code, zero_balance_effective_date,
  {mdate('zero_balance_effective_date')} AS zero_balance_effective_month,
  {mdate('ddlpi')} AS ddlpi_month,
  TRY_CAST(vintage_year AS SMALLINT) AS vintage_year,
  loan_age='0' AS is_loan_age_zero,
  TRY_CAST(monthly_reporting_period AS INTEGER)<201704 AS estimated_ltv_pre_201704_flag,
  zero_balance_code IS NOT NULL AS has_zero_balance_event
FROM raw_perf""",
    "orig": """
SELECT c.* REPLACE (
    CASE WHEN c.fico BETWEEN 300 AND 850 THEN c.fico END AS fico,
    CASE WHEN c.original_dti BETWEEN 0 AND 65 THEN c.original_dti END AS original_dti),
  coalesce(c.fico NOT BETWEEN 300 AND 850,false) AS qc_credit_score_out_of_range,
  coalesce(c.original_dti NOT BETWEEN 0 AND 65,false) AS qc_dti_out_of_range,
  (c.first_payment_month - INTERVAL 1 MONTH)::DATE AS operational_origination_date,
  year((c.first_payment_month - INTERVAL 1 MONTH)::DATE) AS operational_origination_year,
  coalesce(year((c.first_payment_month - INTERVAL 1 MONTH)::DATE)<>c.vintage_year,false)
    AS qc_proxy_year_differs_from_vintage,
  coalesce(c.original_upb<=0,false) AS qc_original_upb_nonpositive,
  coalesce(c.original_loan_term<=0,false) AS qc_original_term_nonpositive
FROM clean_orig c""",
    "perf": """
SELECT *, reporting_month AS performance_month, delinquency_status_raw AS current_delinquency_status,
  coalesce(current_actual_upb<0,false) AS qc_current_upb_negative
FROM clean_perf WHERE reporting_month<=DATE '2026-03-31'""",
    "monthly": """
SELECT loan_id, reporting_period_num AS month, delinquency_num, is_ra, zero_balance_code AS code,
  (year(zero_balance_effective_month)*100+month(zero_balance_effective_month))::INTEGER AS em
FROM clean_perf WHERE reporting_period_num<=202603""",
    "candidates": """
SELECT loan_id, month AS m, 0 AS rk, 'DEFAULT' AS typ, 'D90' AS src, NULL AS code, false AS mism
FROM monthly WHERE delinquency_num>=3
UNION ALL SELECT loan_id, month, 1, 'DEFAULT', 'RA', NULL, false FROM monthly WHERE is_ra
UNION ALL SELECT loan_id, em,
  CASE code WHEN '02' THEN 2 WHEN '03' THEN 3 WHEN '09' THEN 4 WHEN '01' THEN 5 WHEN '15' THEN 6
            WHEN '16' THEN 7 ELSE 8 END,
  CASE WHEN code IN ('02','03','09') THEN 'DEFAULT' WHEN code='01' THEN 'PREPAYMENT'
       ELSE 'CENSOR' END,
  CASE code WHEN '01' THEN 'ZB01_PREPAYMENT' WHEN '15' THEN 'ZB15_WHOLE_LOAN_SALE'
            WHEN '16' THEN 'ZB16_REPERFORMING_SECURITIZATION' WHEN '96' THEN 'ZB96_DEFECT'
            ELSE 'ZB'||code END,
  code, em<>month
FROM monthly WHERE code IS NOT NULL AND em<=202603""",
    "picked": """
SELECT loan_id, m, typ, src, code, mism, at_d, at_p FROM (
  SELECT c.*, row_number() OVER (PARTITION BY loan_id ORDER BY m, rk, mism) AS rn,
    bool_or(typ='DEFAULT') OVER (PARTITION BY loan_id, m) AS at_d,
    bool_or(typ='PREPAYMENT') OVER (PARTITION BY loan_id, m) AS at_p
  FROM candidates c) WHERE rn=1""",
    "events": f"""
SELECT f.loan_id, f.fo AS first_observed_month, f.lo AS last_observed_month,
  coalesce(p.src,'RIGHT_CENSOR') AS event_source,
  coalesce(p.mism,false) AS effective_reporting_month_mismatch,
  coalesce(p.code, z.code) AS raw_zero_balance_code,
  o.vintage_year, o.first_payment_month, o.maturity_month,
  coalesce(p.m,f.lo) AS event_month, coalesce(p.typ,'CENSOR') AS event_type,
  (CASE coalesce(p.typ,'CENSOR') WHEN 'DEFAULT' THEN 1 WHEN 'PREPAYMENT' THEN 2 ELSE 0 END)::TINYINT
    AS event_code,
  {day(idx('coalesce(p.m,f.lo)'))} AS event_date,
  coalesce(p.at_d AND p.at_p,false) AS same_month_default_prepay_flag
FROM (SELECT loan_id, min(month) AS fo, max(month) AS lo FROM monthly GROUP BY loan_id) f
LEFT JOIN picked p ON p.loan_id=f.loan_id
LEFT JOIN (SELECT loan_id, arg_min(code, em*100+code::INT) AS code FROM monthly
           WHERE code IS NOT NULL GROUP BY loan_id) z ON z.loan_id=f.loan_id
LEFT JOIN clean_orig o ON o.loan_id=f.loan_id""",
    "survival": f"""
SELECT *, CASE WHEN entry_time_month IS NULL OR exit_time_month IS NULL THEN 'MISSING_TIME'
    WHEN entry_time_month<0 OR exit_time_month<0 THEN 'NEGATIVE_AGE'
    WHEN exit_time_month<entry_time_month THEN 'EVENT_BEFORE_ENTRY'
    WHEN exit_time_month=entry_time_month THEN 'ZERO_OBSERVED_INTERVAL'
    WHEN event_month>202603 THEN 'AFTER_CUTOFF' END AS survival_exclusion_reason
FROM (SELECT e.*, (e.first_payment_month - INTERVAL 1 MONTH)::DATE AS operational_origination_date,
    ({idx('e.first_observed_month')}-{dindex('e.first_payment_month')}+1)::INTEGER
      AS entry_time_month,
    ({idx('e.event_month')}-{dindex('e.first_payment_month')}+1)::INTEGER AS exit_time_month
  FROM events e)""",
    "model": """
SELECT s.*, s.exit_time_month AS duration_months, o.fico, o.original_ltv, o.original_dti,
  o.original_interest_rate, o.original_loan_term, o.original_cltv, o.original_upb,
  o.occupancy_status, o.property_type, o.loan_purpose, o.property_state, o.number_borrowers,
  o.multiple_borrowers_flag, o.origination_quarter,
  (o.fico IS NOT NULL AND o.original_ltv IS NOT NULL AND o.original_dti IS NOT NULL
   AND o.original_interest_rate IS NOT NULL AND o.original_loan_term IS NOT NULL)
    AS core_covariates_complete_flag
FROM survival s LEFT JOIN orig o ON o.loan_id=s.loan_id
WHERE s.survival_exclusion_reason IS NULL AND s.vintage_year BETWEEN 2016 AND 2026""",
    "complete": "SELECT * FROM model WHERE core_covariates_complete_flag",
    "intervals": f"""
SELECT *, stop_time_month-start_time_month AS interval_length_months,
  stop_time_month-start_time_month>1 AS gap_interval_flag,
  stop_time_month=exit_time_month AS terminal_interval_flag,
  (stop_time_month=exit_time_month AND event_type='DEFAULT')::INT AS default_event
FROM (SELECT *, coalesce(lead(start_time_month) OVER (PARTITION BY loan_id ORDER BY start_time_month),
                        exit_time_month) AS stop_time_month
  FROM (SELECT p.loan_id, m.vintage_year, p.performance_month, p.reporting_period_num,
      m.entry_time_month, m.exit_time_month, m.event_type,
      {', '.join('m.' + c for c in CORE)},
      p.current_actual_upb, p.current_interest_rate, p.current_delinquency_status AS st,
      ({dindex('p.performance_month')}-{dindex('m.operational_origination_date')})::INTEGER
        AS start_time_month
    FROM perf p JOIN complete m USING (loan_id))
  WHERE start_time_month>=entry_time_month AND start_time_month<exit_time_month)""",
    "fico_banded": """
SELECT *, CASE WHEN fico IS NULL THEN 'Missing' WHEN fico<650 THEN '<650' WHEN fico<700 THEN '650–699'
    WHEN fico<750 THEN '700–749' ELSE '750+' END AS fico_band,
  CASE WHEN original_ltv IS NULL THEN 'Missing' WHEN original_ltv<=60 THEN '≤60%'
    WHEN original_ltv<=70 THEN '>60–70%' WHEN original_ltv<=80 THEN '>70–80%' ELSE '>80%' END
    AS ltv_band,
  CASE WHEN original_dti IS NULL THEN 'Missing' WHEN original_dti<=30 THEN '≤30%'
    WHEN original_dti<=40 THEN '>30–40%' WHEN original_dti<=50 THEN '>40–50%' ELSE '>50%' END
    AS dti_band
FROM model""",
    "lc_all": """
SELECT 'portfolio' AS gn, 'all' AS gv, entry_time_month AS e, exit_time_month AS x,
  event_code::INT AS c FROM model""",
    "lc_vintage": """
SELECT 'vintage_year' AS gn, vintage_year::VARCHAR AS gv, entry_time_month AS e,
  exit_time_month AS x, event_code::INT AS c FROM model""",
    "lc_band": """
SELECT 'fico_band' AS gn, fico_band AS gv, entry_time_month AS e, exit_time_month AS x,
  event_code::INT AS c FROM fico_banded
UNION ALL SELECT 'ltv_band', ltv_band, entry_time_month, exit_time_month, event_code::INT
FROM fico_banded
UNION ALL SELECT 'dti_band', dti_band, entry_time_month, exit_time_month, event_code::INT
FROM fico_banded""",
    "candidate_loans": """
SELECT p.*, z.first_prepay_month, z.first_maturity_month, z.first_zb01_ambiguous_month,
  least(first_d90_month, first_ra_month, first_credit_zb_month) AS first_default_evidence_month
FROM (SELECT loan_id, vintage_year,
    min(reporting_period_num) FILTER (WHERE delinquency_num>=3) AS first_d90_month,
    min(reporting_period_num) FILTER (WHERE is_ra) AS first_ra_month,
    min(coalesce(zero_balance_effective_date::INTEGER,reporting_period_num))
      FILTER (WHERE zero_balance_code IN ('02','03','09')) AS first_credit_zb_month,
    min(coalesce(zero_balance_effective_date::INTEGER,reporting_period_num))
      FILTER (WHERE zero_balance_code IN ('15','16','96')) AS first_admin_termination_month,
    max(reporting_period_num) AS last_observed_month
  FROM clean_perf GROUP BY loan_id, vintage_year) p
LEFT JOIN (SELECT loan_id,
    min(zb_event_month) FILTER (WHERE zb01_classification LIKE 'PREPAY%') AS first_prepay_month,
    min(zb_event_month) FILTER (WHERE zb01_classification LIKE 'MATURED%') AS first_maturity_month,
    min(zb_event_month) FILTER (WHERE zb01_classification='AMBIGUOUS')
      AS first_zb01_ambiguous_month
  FROM payoffs GROUP BY loan_id) z USING (loan_id)""",
    "payoffs": """
SELECT p.loan_id, p.vintage_year,
  coalesce(p.zero_balance_effective_date::INTEGER,p.reporting_period_num) AS zb_event_month,
  CASE WHEN p.remaining_months_maturity>0 THEN 'PREPAY_REMAINING_MATURITY'
       WHEN p.remaining_months_maturity<=0 THEN 'MATURED_REMAINING_MATURITY'
       WHEN p.zero_balance_effective_month<o.maturity_month THEN 'PREPAY_FALLBACK_MATURITY_DATE'
       WHEN p.zero_balance_effective_month>=o.maturity_month THEN 'MATURED_FALLBACK_MATURITY_DATE'
       ELSE 'AMBIGUOUS' END AS zb01_classification
FROM clean_perf p LEFT JOIN clean_orig o USING (loan_id) WHERE p.zero_balance_code='01'""",
    "relations": """
SELECT *, CASE WHEN first_default_evidence_month<first_prepay_month THEN 'DEFAULT_BEFORE_PREPAY'
    WHEN first_default_evidence_month=first_prepay_month THEN 'DEFAULT_AND_PREPAY_SAME_MONTH'
    WHEN first_prepay_month<first_default_evidence_month THEN 'PREPAY_BEFORE_DEFAULT'
    ELSE 'NO_DEFAULT_PREPAY_CONFLICT' END AS default_prepay_relation
FROM candidate_loans""",
    "timed_events": f"""
SELECT *, {idx('event_month')}-{dindex('first_payment_month')}+1 AS dur,
  {idx('event_month')} AS ev, {dindex('first_payment_month')} AS fpi FROM events""",
    "aged": f"""
SELECT p.*, e.first_payment_month,
  ({idx('p.reporting_period_num')}-{dindex('e.first_payment_month')}+1)::INTEGER AS age,
  (p.loan_age-({idx('p.reporting_period_num')}-{dindex('e.first_payment_month')}+1))::INTEGER
    AS diff
FROM clean_perf p JOIN events e USING (loan_id)""",
    "timeline": f"""
SELECT p.loan_id, p.reporting_period_num,
  ({idx('p.reporting_period_num')}-{dindex('m.operational_origination_date')})::INTEGER
    AS analysis_time_month,
  p.current_delinquency_status, p.delinquency_num, p.is_ra, p.current_actual_upb,
  p.current_interest_rate, p.zero_balance_code,
  CASE WHEN p.reporting_period_num=m.event_month
       THEN CASE WHEN m.event_type='PREPAYMENT' THEN 'VOLUNTARY_PREPAYMENT' ELSE m.event_type END
       ELSE 'CENSORED' END AS event_type
FROM perf p JOIN model m USING (loan_id)
WHERE p.reporting_period_num<=202603 AND p.reporting_period_num<=m.event_month
  AND {idx('p.reporting_period_num')}>={dindex('m.operational_origination_date')}""",
}


def _curve_views(tag: str) -> None:
    """Month table, incidence curves, influences and horizon tables of one grouping."""
    lc = f"lc_{tag}"
    VIEWS[f"mt_{tag}"] = f"""
SELECT g.gn, g.gv, g.t::INTEGER AS t,
  count(*) FILTER (WHERE e<t AND x>=t) AS n, count(*) FILTER (WHERE e<=t AND x>=t) AS present,
  count(*) FILTER (WHERE x=t AND c=1) AS d1, count(*) FILTER (WHERE x=t AND c=2) AS d2,
  count(*) FILTER (WHERE x=t AND c=0) AS c0
FROM (SELECT gn, gv, unnest(generate_series(min(e),max(x))) AS t FROM {lc} GROUP BY gn, gv) g
JOIN {lc} l ON l.gn=g.gn AND l.gv=g.gv GROUP BY g.gn, g.gv, g.t"""
    VIEWS[f"haz_{tag}"] = f"""
SELECT *, CASE WHEN n>0 THEN d1/n::DOUBLE ELSE 0 END AS h1,
  CASE WHEN n>0 THEN d2/n::DOUBLE ELSE 0 END AS h2,
  CASE WHEN n>0 THEN (d1+d2)/n::DOUBLE ELSE 0 END AS h FROM mt_{tag}"""
    VIEWS[f"sb_{tag}"] = f"""
SELECT *, exp(coalesce(sum(CASE WHEN h>=1 THEN -1e300 ELSE ln(1-h) END)
    OVER (PARTITION BY gn, gv ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)) AS sb
FROM haz_{tag}"""
    VIEWS[f"cif_{tag}"] = f"""
SELECT *, sum(sb*h1) OVER w AS f1, sum(sb*h2) OVER w AS f2 FROM sb_{tag}
WINDOW w AS (PARTITION BY gn, gv ORDER BY t)"""
    VIEWS[f"long_{tag}"] = f"""
SELECT gn, gv, t, n, h, sb, d1+d2+c0>0 AS ex, 'DEFAULT' AS endpoint, 1 AS k, h1 AS hk, f1 AS f
FROM cif_{tag}
UNION ALL SELECT gn, gv, t, n, h, sb, d1+d2+c0>0, 'PREPAYMENT', 2, h2, f2 FROM cif_{tag}"""
    VIEWS[f"run_{tag}"] = f"""
SELECT *, sum(CASE WHEN n>0 THEN sb*hk/n ELSE 0 END) OVER w AS p,
  sum(CASE WHEN n>0 AND h<1 THEN h/(n*(1-h)) ELSE 0 END) OVER w AS q,
  sum(CASE WHEN n>0 AND h<1 THEN h/(n*(1-h))*f ELSE 0 END) OVER w AS r
FROM long_{tag} WINDOW w AS (PARTITION BY gn, gv, endpoint ORDER BY t)"""
    # Influence of every loan on every later month of its curve, then the sum of squares.
    VIEWS[f"var_{tag}"] = f"""
SELECT c.gn, c.gv, c.endpoint, c.t, any_value(c.f) AS f, any_value(c.n) AS n,
  coalesce(sum(l.m*power(-(least_p-a.p)+c.f*(least_q-a.q)-(least_r-a.r)
    +CASE WHEN l.x<=c.t AND l.c=c.k THEN b.sb/b.n ELSE 0 END
    -CASE WHEN l.x<=c.t AND l.c>0 AND b.h<1 THEN (c.f-b.f)/(b.n*(1-b.h)) ELSE 0 END,2)),0) AS v
FROM run_{tag} c
JOIN (SELECT gn, gv, e, x, c, count(*) AS m FROM lc_{tag} GROUP BY ALL) l
  ON l.gn=c.gn AND l.gv=c.gv AND l.e<c.t
JOIN run_{tag} a ON a.gn=c.gn AND a.gv=c.gv AND a.endpoint=c.endpoint AND a.t=l.e
JOIN run_{tag} b ON b.gn=c.gn AND b.gv=c.gv AND b.endpoint=c.endpoint AND b.t=l.x,
LATERAL (SELECT CASE WHEN l.x<c.t THEN b.p ELSE c.p END AS least_p,
  CASE WHEN l.x<c.t THEN b.q ELSE c.q END AS least_q,
  CASE WHEN l.x<c.t THEN b.r ELSE c.r END AS least_r)
WHERE c.ex GROUP BY c.gn, c.gv, c.endpoint, c.t"""
    VIEWS[f"curve_{tag}"] = f"""
SELECT gn, gv, endpoint, t, f, n,
  CASE WHEN f<=0 OR f>=1 THEN f
       ELSE power(f, exp(1.959963984540054*sqrt(v)/(f*abs(ln(f))))) END AS lo,
  CASE WHEN f<=0 OR f>=1 THEN f
       ELSE power(f, exp(-1.959963984540054*sqrt(v)/(f*abs(ln(f))))) END AS hi
FROM var_{tag}"""
    VIEWS[f"steps_{tag}"] = f"""
SELECT gn, gv, endpoint, h.h,
  CASE WHEN h.h<=max(t) THEN coalesce(arg_max(f,t) FILTER (WHERE t<=h.h),0) END AS cif
FROM long_{tag}, (SELECT unnest([12,24,36,60]) AS h) h WHERE ex GROUP BY gn, gv, endpoint, h.h"""
    VIEWS[f"hz_{tag}"] = f"""
SELECT s.*, d.cif AS dc, p.cif AS pc,
  coalesce(d.cif IS NOT NULL AND p.cif IS NOT NULL AND s.nr>0,false) AS ok,
  CASE WHEN s.h=60 THEN 'SUPPLEMENTARY' ELSE 'PRIMARY' END AS role
FROM (SELECT gn, gv, h.h, count(*) AS lcount, count(*) FILTER (WHERE e<h.h AND x>=h.h) AS nr,
        count(*) FILTER (WHERE c=1) AS dcount, count(*) FILTER (WHERE c=2) AS pcount
      FROM lc_{tag}, (SELECT unnest([12,24,36,60]) AS h) h GROUP BY gn, gv, h.h) s
LEFT JOIN steps_{tag} d ON d.gn=s.gn AND d.gv=s.gv AND d.h=s.h AND d.endpoint='DEFAULT'
LEFT JOIN steps_{tag} p ON p.gn=s.gn AND p.gv=s.gv AND p.h=s.h AND p.endpoint='PREPAYMENT'"""


for _tag in ("all", "vintage", "band"):
    _curve_views(_tag)


def _km_view(tag: str) -> None:
    VIEWS[f"km_{tag}"] = f"""
SELECT gn, gv, t, present, d1, d2+c0 AS cens, exp(ls) AS s,
  CASE WHEN exp(ls)<=0 OR exp(ls)>=1 THEN exp(ls)
       ELSE exp(ls*exp(1.959963984540054*sqrt(g)/abs(ls))) END AS lo,
  CASE WHEN exp(ls)<=0 OR exp(ls)>=1 THEN exp(ls)
       ELSE exp(ls*exp(-1.959963984540054*sqrt(g)/abs(ls))) END AS hi
FROM (SELECT *, sum(CASE WHEN h1>=1 THEN -1e300 ELSE ln(1-h1) END) OVER w AS ls,
        sum(CASE WHEN d1>0 AND n>d1 THEN d1/(n*(n-d1))::DOUBLE ELSE 0 END) OVER w AS g
      FROM haz_{tag} WINDOW w AS (PARTITION BY gn, gv ORDER BY t))"""


for _tag in ("all", "vintage"):
    _km_view(_tag)


VIEWS["pd_overall"] = """
SELECT h, role, CASE WHEN ok THEN dc END AS cif, lcount, nr, dcount, pcount, ok,
  CASE WHEN ok THEN 'ELIGIBLE' ELSE 'INSUFFICIENT_OBSERVED_SUPPORT' END AS st FROM hz_all"""
VIEWS["pd_band"] = """
SELECT gn, gv, h, role, CASE WHEN ok THEN dc END AS cif, CASE WHEN ok THEN pc END AS pcif,
  lcount, nr, dcount, pcount, ok,
  CASE WHEN ok THEN 'ELIGIBLE' ELSE 'INSUFFICIENT_OBSERVED_SUPPORT' END AS st FROM hz_band"""
VIEWS["pd_vintage"] = """
SELECT gv::SMALLINT AS vintage_year, h, role, lcount, nr, dcount, pcount, latest, seasoned,
  CASE WHEN ok AND seasoned THEN dc END AS cif, CASE WHEN ok AND seasoned THEN pc END AS pcif,
  CASE WHEN NOT seasoned THEN 'INSUFFICIENT_FOLLOW_UP'
       WHEN NOT ok THEN 'INSUFFICIENT_OBSERVED_SUPPORT' ELSE 'ELIGIBLE' END AS st
FROM (SELECT z.*, o.latest,
        (o.latest+to_months(z.h::INTEGER))::DATE<=DATE '2026-03-31' AS seasoned
      FROM hz_vintage z JOIN (SELECT vintage_year::VARCHAR AS gv,
        max(operational_origination_date) AS latest FROM model GROUP BY 1) o USING (gv))"""
VIEWS["pd_rows"] = """
SELECT h AS horizon, 'portfolio' AS grp, 'all' AS gv, cif, coalesce((SELECT arg_max(f,t)
    FROM long_all l WHERE l.ex AND l.endpoint='PREPAYMENT' AND l.t<=pd_overall.h),0) AS pcif,
  cif AS pd, lcount, nr, dcount, pcount, ok, st FROM pd_overall
UNION ALL SELECT h, gn, gv, cif, pcif, cif, lcount, nr, dcount, pcount, ok, st FROM pd_band"""


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [name for name in VIEWS if name in words]


def sql(statement: str) -> str:
    """The statement with every view it needs, directly or not, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for name in _needs(text):
            if name != own and name not in ordered:
                visit(VIEWS[name], name)
                ordered.append(name)

    visit(statement, None)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    return f"WITH {ctes}\n{statement.strip()}" if ordered else statement.strip()
