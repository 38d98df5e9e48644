"""Registered queries: each operator over the whole study tables, with its reference SQL.

Doubles are rounded to nine digits and dates are shown as text so that engines compare equal.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanspan.contracts import CORE_PREDICTORS, CUTOFF, TV_PREDICTORS, merge_rows
from loanspan.functions import months as M
from loanspan.functions.codes import delinquency_label, event_label
from loanspan.operators import aalen_johansen as aj
from loanspan.operators import audit, clock, cox, dataset, events, fine_gray, horizons, intervals
from loanspan.operators import kaplan_meier as km
from loanspan.operators import ph_test, sampling, scoring, outcomes, validate
from loanspan.plans import projections, reads, release
from loanspan.plans.oracle import dindex, dstr, idx, sql
from loanspan.plans.study import Study, study
from loanspan.sources import archives, text
from loanspan.sources import tables as io

DIGITS = 9
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
PROV = projections.Provenance("run_a")
PROV_SQL = (
    "'loans_2016_2026_cutoff_202603' AS data_version, 'run_a' AS run_id, "
    "'unversioned' AS code_commit"
)


def comparable(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles and print dates."""
    columns = []
    for f in df.schema:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            col = F.round(col, digits)
        elif isinstance(f.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        columns.append(col.alias(f.name))
    return df.select(columns)


def query(name: str, statement: str | None = None, digits: int = DIGITS):
    """Register a query with its SQL. Where very many values come out of long sums, `digits` leaves
    fewer of them on the edge between two rounded values."""

    def register(build: Callable[[Study], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return comparable(build(study(spark, sf_dir)), digits)

        QUERIES[name] = run
        if statement is not None:
            ORACLE[name] = sql(statement)
        return build

    return register


def rnd(expr: str, name: str | None = None, digits: int = DIGITS) -> str:
    return f"round(({expr})::DOUBLE,{digits}) AS {name or expr}"


def count_if(cond: str, name: str) -> str:
    return f"count(*) FILTER (WHERE {cond}) AS {name}"


# ---- sources and sinks -----------------------------------------------------------------------


def _scanned(s: Study, kind: str) -> DataFrame:
    """Every vintage's text file through the strict scan."""
    folder = s.text_folder(kind)
    parts = [
        text.scan_text(s.spark, f"{folder}/vintage_year={year}", kind, year) for year in s.vintages
    ]
    return reduce(DataFrame.unionByName, parts)


def _unpacked(s: Study, kind: str) -> DataFrame:
    """Every vintage's archives through the member stream."""
    folder = s.archive_folder(kind)
    paths = {year: f"{folder}/{year}" for year in s.vintages}
    return archives.scan_yearly_archives(s.spark, paths, kind)


RAW_PERFORMANCE = """SELECT *, NULL::VARCHAR AS payment_deferral_flag,
  NULL::VARCHAR AS delinquency_due_to_disaster, NULL::VARCHAR AS borrower_assistance_plan
FROM raw_perf"""
query("text_scan_origination", "SELECT * FROM raw_orig")(lambda s: _scanned(s, "origination"))
query("text_scan_performance", RAW_PERFORMANCE)(lambda s: _scanned(s, "performance"))
query("archive_scan_origination", "SELECT * FROM raw_orig")(lambda s: _unpacked(s, "origination"))
query("archive_scan_performance", RAW_PERFORMANCE)(lambda s: _unpacked(s, "performance"))

query(
    "typed_text_performance",
    f"""SELECT loan_id, {dstr('reporting_month')} AS performance_month, current_actual_upb,
  delinquency_status_raw AS current_delinquency_status, loan_age::DOUBLE AS source_loan_age,
  modification_flag, zero_balance_code,
  {dstr('zero_balance_effective_month')} AS zero_balance_effective_date, current_interest_rate
FROM clean_perf""",
)(
    lambda s: text.scan_typed_text(
        s.spark,
        [f"{s.text_folder('performance')}/vintage_year={year}" for year in s.vintages],
        "performance",
    ).select(*text.TYPED_PERFORMANCE.values())
)

query(
    "typed_text_line_numbers",
    "SELECT vintage_year, count(*) AS lines, count(*) AS numbered FROM clean_orig GROUP BY 1",
)(
    lambda s: text.scan_typed_text(
        s.spark,
        [f"{s.text_folder('origination')}/vintage_year={year}" for year in s.vintages],
        "origination",
    )
    .select(F.substring("loan_id", 2, 2).cast("int").alias("yy"), "source_file", "source_row")
    .groupBy((F.col("yy") + 2000).cast("smallint").alias("vintage_year"), "source_file")
    .agg(
        F.count("*").alias("lines"),
        (F.max("source_row") - F.min("source_row") + 1).alias("numbered"),
    )
    .groupBy("vintage_year")
    .agg(F.sum("lines").alias("lines"), F.sum("numbered").alias("numbered"))
)

query(
    "csv_round_trip",
    f"""SELECT vintage_year, count(*) AS loans, {count_if("event_type='DEFAULT'", 'default_loans')},
  {count_if("event_type='PREPAYMENT'", 'prepayment_loans')},
  {count_if("event_type='CENSOR'", 'censored_loans')},
  {count_if('same_month_default_prepay_flag', 'same_month_conflicts')},
  {count_if('event_month>last_observed_month', 'events_after_last_report')}
FROM events GROUP BY vintage_year""",
)(lambda s: _csv_round_trip(s, audit.event_summary(s.events)))


def _csv_round_trip(s: Study, df: DataFrame) -> DataFrame:
    path = io.write_csv(df, f"{s.folder}/event_summary_csv")
    return io.read_csv(s.spark, path, df.schema)


query(
    "vintage_partitions",
    "SELECT vintage_year::INTEGER AS vintage_year, count(*) AS loans FROM model GROUP BY 1",
)(lambda s: _vintage_partitions(s))


def _vintage_partitions(s: Study) -> DataFrame:
    """A second write without force adds nothing."""
    path = f"{s.folder}/model_by_vintage"
    io.write_vintages(s.model, path, force=True)
    io.write_vintages(s.model, path)
    return s.spark.read.parquet(path).groupBy("vintage_year").agg(F.count("*").alias("loans"))


query(
    "checked_export",
    "SELECT event_type, count(*) AS loans FROM model GROUP BY 1",
)(
    lambda s: s.spark.read.parquet(
        io.export_checked(s.model, f"{s.folder}/analysis_loans", dataset.validate_model_frame)
    )
    .groupBy("event_type")
    .agg(F.count("*").alias("loans"))
)



def _snapshots(s: Study) -> DataFrame:
    """Two versions of the model table published one after the other, and what readers get."""
    root = f"{s.folder}/analysis_versions"
    last = max((n for n, _ in io.pointed(s.spark, root)), default=0)
    first = io.publish_snapshot(
        s.model.filter("event_type <> 'CENSOR'"), root, dataset.validate_model_frame, last
    )
    io.publish_snapshot(s.model, root, dataset.validate_model_frame, first)
    parts = {"current": io.read_snapshot(s.spark, root), "earlier": io.read_snapshot(s.spark, root, first)}
    return reduce(
        DataFrame.unionByName,
        [
            df.groupBy("event_type").agg(F.count("*").alias("loans")).withColumn("version", F.lit(name))
            for name, df in parts.items()
        ],
    )


query(
    "snapshot_publication",
    """SELECT 'current' AS version, event_type, count(*) AS loans FROM model GROUP BY 2
UNION ALL SELECT 'earlier', event_type, count(*) FROM model WHERE event_type<>'CENSOR' GROUP BY 2""",
)(_snapshots)

# ---- standardization -------------------------------------------------------------------------

query(
    "raw_origination_table",
    "SELECT * FROM raw_orig",
)(lambda s: s.raw_orig)

query(
    "raw_performance_table",
    """SELECT *, NULL::VARCHAR AS payment_deferral_flag,
  NULL::VARCHAR AS delinquency_due_to_disaster, NULL::VARCHAR AS borrower_assistance_plan
FROM raw_perf""",
)(lambda s: s.raw_perf)

query(
    "origination_cleaned",
    f"""SELECT loan_id, fico, original_dti, original_ltv, original_cltv, vantagescore_4,
  occupancy_status, property_type, loan_purpose, original_upb, original_interest_rate,
  original_loan_term, vintage_year, {dstr('first_payment_month')} AS first_payment_month,
  {dstr('maturity_month')} AS maturity_month, origination_quarter, ltv_above_100_flag,
  cltv_above_100_flag, legacy_number_borrowers_encoding_flag, number_borrowers_not_available_flag,
  multiple_borrowers_flag, number_borrowers, fico_not_available_flag, dti_not_available_flag,
  ltv_not_available_flag, cltv_not_available_flag, vantagescore_not_available_flag
FROM clean_orig""",
)(
    lambda s: s.clean_orig.select(
        "loan_id", "fico", "original_dti", "original_ltv", "original_cltv", "vantagescore_4",
        "occupancy_status", "property_type", "loan_purpose", "original_upb",
        "original_interest_rate", "original_loan_term", "vintage_year", "first_payment_month",
        "maturity_month", "origination_quarter", "ltv_above_100_flag", "cltv_above_100_flag",
        "legacy_number_borrowers_encoding_flag", "number_borrowers_not_available_flag",
        "multiple_borrowers_flag", "number_borrowers", "fico_not_available_flag",
        "dti_not_available_flag", "ltv_not_available_flag", "cltv_not_available_flag",
        "vantagescore_not_available_flag",
    )
)

query(
    "performance_cleaned",
    f"""SELECT loan_id, reporting_period_num, {dstr('reporting_month')} AS reporting_month, loan_age,
  remaining_months_maturity, current_actual_upb, current_interest_rate, delinquency_num, is_xx,
  is_ra, estimated_ltv, estimated_ltv_not_available_flag,
  {dstr('zero_balance_effective_month')} AS zero_balance_effective_month,
  {dstr('ddlpi_month')} AS ddlpi_month, vintage_year, is_loan_age_zero,
  estimated_ltv_pre_201704_flag, has_zero_balance_event
FROM clean_perf""",
)(
    lambda s: s.clean_perf.select(
        "loan_id", "reporting_period_num", "reporting_month", "loan_age",
        "remaining_months_maturity", "current_actual_upb", "current_interest_rate",
        "delinquency_num", "is_xx", "is_ra", "estimated_ltv", "estimated_ltv_not_available_flag",
        "zero_balance_effective_month", "ddlpi_month", "vintage_year", "is_loan_age_zero",
        "estimated_ltv_pre_201704_flag", "has_zero_balance_event",
    )
)

query(
    "origination_standardized",
    f"""SELECT loan_id, fico, original_dti, qc_credit_score_out_of_range, qc_dti_out_of_range,
  {dstr('first_payment_month')} AS first_payment_date, {dstr('maturity_month')} AS maturity_date,
  vintage_year AS origination_vintage,
  {dstr('operational_origination_date')} AS operational_origination_date,
  operational_origination_year::INTEGER AS operational_origination_year,
  qc_proxy_year_differs_from_vintage, qc_original_upb_nonpositive, qc_original_term_nonpositive
FROM orig""",
)(
    lambda s: s.orig.select(
        "loan_id", "fico", "original_dti", "qc_credit_score_out_of_range", "qc_dti_out_of_range",
        "first_payment_date", "maturity_date", "origination_vintage",
        "operational_origination_date", "operational_origination_year",
        "qc_proxy_year_differs_from_vintage", "qc_original_upb_nonpositive",
        "qc_original_term_nonpositive",
    )
)

query(
    "performance_standardized",
    f"""SELECT loan_id, {dstr('performance_month')} AS performance_month, reporting_period_num,
  current_delinquency_status, delinquency_num, current_actual_upb, current_interest_rate,
  loan_age AS source_loan_age, zero_balance_code,
  {dstr('zero_balance_effective_month')} AS zero_balance_effective_date, qc_current_upb_negative
FROM perf""",
)(
    lambda s: s.perf.select(
        "loan_id", "performance_month", "reporting_period_num", "current_delinquency_status",
        "delinquency_num", "current_actual_upb", "current_interest_rate", "source_loan_age",
        "zero_balance_code", "zero_balance_effective_date", "qc_current_upb_negative",
    )
)

_OQC = [
    "qc_credit_score_out_of_range", "qc_dti_out_of_range", "qc_proxy_year_differs_from_vintage",
    "qc_original_upb_nonpositive", "qc_original_term_nonpositive",
]
_ONULL = ["fico", "original_dti", "original_ltv", "original_cltv", "property_type", "loan_purpose"]
query(
    "origination_key_check",
    f"""SELECT count(*) AS table_rows, {count_if('loan_id IS NULL', 'missing_keys')},
  count(*)-count(DISTINCT loan_id) AS repeated_keys,
  {', '.join(count_if(c + ' IS NULL', 'null_' + c) for c in _ONULL)},
  {', '.join(count_if(c, 'flag_' + c) for c in _OQC)}
FROM orig""",
)(
    lambda s: validate.key_check(s.orig, ["loan_id"]).select(
        "table_rows", "missing_keys", "repeated_keys", *[f"null_{c}" for c in _ONULL],
        *[f"flag_{c}" for c in _OQC],
    )
)

query(
    "performance_key_check",
    f"""SELECT count(*) AS table_rows,
  {count_if('p.loan_id IS NULL OR performance_month IS NULL', 'missing_keys')},
  (SELECT count(*) FROM (SELECT 1 FROM perf GROUP BY loan_id, performance_month
    HAVING count(*)>1)) AS repeated_keys,
  count(DISTINCT p.loan_id) FILTER (WHERE o.loan_id IS NULL) AS orphan_loans,
  {count_if("performance_month>DATE '2026-03-31'", 'months_after_cutoff')},
  {count_if('delinquency_num IS NULL', 'null_delinquency_num')},
  {count_if('estimated_ltv IS NULL', 'null_estimated_ltv')},
  {count_if('qc_current_upb_negative', 'flag_qc_current_upb_negative')}
FROM perf p LEFT JOIN (SELECT loan_id FROM orig) o ON o.loan_id=p.loan_id""",
)(
    lambda s: validate.key_check(s.perf, ["loan_id", "performance_month"], s.orig).select(
        "table_rows", "missing_keys", "repeated_keys", "orphan_loans", "months_after_cutoff",
        "null_delinquency_num", "null_estimated_ltv", "flag_qc_current_upb_negative",
    )
)

query(
    "cleaning_reconciliation",
    f"""SELECT * FROM (SELECT count(*) AS orig_rows,
  {count_if("fico_raw='9999'", 'fico_codes')}, {count_if('fico_not_available_flag', 'fico_flags')},
  {count_if("original_dti_raw='999'", 'dti_codes')},
  {count_if('dti_not_available_flag', 'dti_flags')},
  {count_if("original_cltv_raw='999'", 'cltv_codes')},
  {count_if('cltv_not_available_flag', 'cltv_flags')},
  {count_if("legacy_number_borrowers_encoding_flag AND number_borrowers_raw='2'",
            'legacy_multiple_borrower_rows')} FROM clean_orig),
 (SELECT count(*) AS perf_rows, {count_if("delinquency_status_raw='XX'", 'xx_codes')},
  {count_if('is_xx', 'xx_flags')}, {count_if("estimated_ltv_raw='999'", 'eltv_codes')},
  {count_if('estimated_ltv_not_available_flag', 'eltv_flags')}, 'PASS' AS status FROM clean_perf)""",
)(
    lambda s: validate.clean_reconciliation(
        s.raw_orig, s.raw_perf, s.clean_orig, s.clean_perf
    ).select(
        "orig_rows", "fico_codes", "fico_flags", "dti_codes", "dti_flags", "cltv_codes",
        "cltv_flags", "legacy_multiple_borrower_rows", "perf_rows", "xx_codes", "xx_flags",
        "eltv_codes", "eltv_flags", "status",
    )
)

# ---- structural validation -------------------------------------------------------------------

query(
    "table_sizes",
    """SELECT 'origination' AS table_name, count(*) AS table_rows,
  count(DISTINCT loan_id) AS unique_loans FROM raw_orig
UNION ALL SELECT 'performance', count(*), count(DISTINCT loan_id) FROM raw_perf""",
)(
    lambda s: validate.table_size(s.raw_orig)
    .withColumn("table_name", F.lit("origination"))
    .unionByName(validate.table_size(s.raw_perf).withColumn("table_name", F.lit("performance")))
)

query(
    "observation_range",
    """SELECT min(monthly_reporting_period) AS first_period,
  max(monthly_reporting_period) AS last_period, min(loan_age::BIGINT) AS min_loan_age,
  max(loan_age::BIGINT) AS max_loan_age FROM raw_perf""",
)(lambda s: validate.observation_range(s.raw_perf))

query(
    "orphan_performance_ids",
    """SELECT count(DISTINCT loan_id) AS orphan_loans FROM raw_perf
WHERE loan_id NOT IN (SELECT loan_id FROM raw_orig)""",
)(lambda s: validate.ids_missing_from(s.raw_perf, s.raw_orig, "orphan_loans"))

# Loans whose only reports come after the cutoff have no usable performance.
_SEEN = "(SELECT loan_id FROM raw_perf WHERE monthly_reporting_period<='202603')"
_FPN = "first_payment_date::INTEGER"


def _reports_to_cutoff(s: Study) -> DataFrame:
    return s.raw_perf.filter(F.col("monthly_reporting_period") <= str(CUTOFF))


query(
    "loans_without_performance",
    f"""SELECT count(*) AS orig_missing_in_perf,
  {count_if(f'{_FPN} IS NULL', 'invalid_first_payment')},
  {count_if(f'{_FPN}<202603', 'first_payment_before_cutoff')},
  {count_if(f'{_FPN}>=202603', 'first_payment_at_or_after_cutoff')}
FROM raw_orig WHERE loan_id NOT IN {_SEEN}""",
)(lambda s: validate.missing_performance_split(s.raw_orig, _reports_to_cutoff(s)))

query(
    "silent_loans",
    f"""SELECT loan_id, first_payment_date, maturity_date, fico, original_ltv, original_dti,
  original_upb, original_interest_rate, original_loan_term, vintage_year
FROM raw_orig WHERE loan_id NOT IN {_SEEN}""",
)(lambda s: validate.loans_without_performance(s.raw_orig, _reports_to_cutoff(s)))

query(
    "vintage_tags",
    "SELECT vintage_year, count(*) AS tag_rows FROM raw_perf GROUP BY vintage_year",
)(lambda s: validate.vintage_tags(s.raw_perf))

query(
    "vintage_consistency",
    """SELECT count(*) FILTER (WHERE n>1) AS inconsistent_loans FROM (
  SELECT loan_id, count(DISTINCT v) AS n FROM (SELECT loan_id, vintage_year AS v FROM raw_orig
    UNION ALL SELECT loan_id, vintage_year FROM raw_perf) GROUP BY loan_id)""",
)(lambda s: validate.vintage_consistency(s.raw_orig, s.raw_perf))

query(
    "special_status_counts",
    f"""SELECT {count_if("delinquency_status='RA'", 'ra_rows')},
  {count_if("delinquency_status='XX'", 'xx_rows')} FROM raw_perf""",
)(lambda s: validate.special_status_counts(s.raw_perf))

query(
    "zero_balance_distribution",
    """SELECT zero_balance_code, count(*) AS code_rows FROM raw_perf
WHERE zero_balance_code IS NOT NULL GROUP BY 1""",
)(lambda s: validate.zero_balance_distribution(s.raw_perf))

query(
    "duplicate_reports",
    """SELECT count(*) AS duplicate_loan_months FROM (SELECT 1 FROM feed GROUP BY loan_key, month
HAVING count(*)>1)""",
)(lambda s: validate.duplicate_keys(s.feed, ["loan_key", "month"], "duplicate_loan_months"))

query(
    "period_problems",
    f"""SELECT {count_if('month%100<1 OR month%100>12', 'invalid_period')},
  {count_if('month>202603', 'after_cutoff')} FROM feed""",
)(lambda s: validate.period_problems(s.feed, F.col("month")))

query(
    "file_order_violations",
    """SELECT count(*) FILTER (WHERE month<prev) AS order_violations FROM (
  SELECT month, lag(month) OVER (PARTITION BY loan_key ORDER BY source_row) AS prev FROM feed)""",
)(
    lambda s: validate.order_violations(
        s.feed.withColumnRenamed("loan_key", "loan_id"), "month", chunk=1000
    )
)



def _stored_orders(s: Study) -> DataFrame:
    """Order check of the standardized reports, stored in their order and by month instead."""
    keys = ["loan_id", "performance_month"]
    parts = []
    for name, order in {"ordered": keys, "by_month": keys[::-1]}.items():
        path = s.written_path(f"reports_{name}", s.perf.select(*keys).orderBy(*order))
        check = validate.stored_order(s.spark, path, keys)
        parts.append(check.select(F.lit(name).alias("stored"), "*"))
    return parts[0].unionByName(parts[1])


query(
    "stored_order_check",
    """SELECT 'ordered' AS stored, count(*) AS table_rows, count(*) FILTER (WHERE FALSE) AS order_violations
FROM perf
UNION ALL SELECT 'by_month', count(*), count(*) FILTER (WHERE loan_id<id OR (loan_id=id AND performance_month<m))
FROM (SELECT loan_id, performance_month, lag(loan_id) OVER w AS id, lag(performance_month) OVER w AS m FROM perf
  WINDOW w AS (ORDER BY performance_month, loan_id))""",
)(_stored_orders)

query(
    "reporting_gaps",
    f"""SELECT {count_if('miss>0', 'loans_with_gaps')}, sum(miss)::BIGINT AS missing_months FROM (
  SELECT max({idx('reporting_period_num')})-min({idx('reporting_period_num')})+1
    -count(DISTINCT reporting_period_num) AS miss FROM clean_perf GROUP BY loan_id)""",
)(lambda s: validate.reporting_gaps(s.clean_perf))

query(
    "date_sanity",
    f"""SELECT {count_if('first_payment_month IS NULL', 'invalid_first_payment')},
  {count_if('maturity_month IS NULL', 'invalid_maturity')},
  {count_if('maturity_month<first_payment_month', 'maturity_before_first_payment')}
FROM clean_orig""",
)(lambda s: validate.date_sanity(s.clean_orig))

query(
    "negative_loan_ages",
    f"SELECT {count_if('loan_age<0', 'negative_loan_age')} FROM clean_perf",
)(lambda s: validate.negative_ages(s.clean_perf))

query(
    "cleaning_rule_violations",
    f"""SELECT * FROM (SELECT {count_if("fico_raw='9999' AND fico IS NOT NULL", 'fico_bad')},
  {count_if("original_dti_raw='999' AND original_dti IS NOT NULL", 'dti_bad')} FROM clean_orig),
 (SELECT {count_if("delinquency_status_raw='XX' AND delinquency_num IS NOT NULL", 'xx_bad')},
  {count_if("delinquency_status_raw NOT IN ('XX','RA') AND delinquency_num IS NULL",
            'delinquency_parse_bad')} FROM clean_perf)""",
)(
    lambda s: validate.merge_rows(
        validate.origination_rule_violations(s.clean_orig),
        validate.performance_rule_violations(s.clean_perf),
    ).select("fico_bad", "dti_bad", "xx_bad", "delinquency_parse_bad")
)

query(
    "final_validation",
    f"""SELECT *, CASE WHEN after_cutoff>0 OR negative_loan_age>0 THEN 'FAIL'
  WHEN loans_with_gaps>0 THEN 'PASS_WITH_WARNING' ELSE 'PASS' END AS status FROM
 (SELECT count(*) AS orig_rows FROM clean_orig),
 (SELECT count(*) AS perf_rows, {count_if('reporting_period_num>202603', 'after_cutoff')},
  {count_if('loan_age<0', 'negative_loan_age')} FROM clean_perf),
 (SELECT {count_if('miss>0', 'loans_with_gaps')} FROM (
  SELECT max({idx('reporting_period_num')})-min({idx('reporting_period_num')})+1
    -count(DISTINCT reporting_period_num) AS miss FROM clean_perf GROUP BY loan_id))""",
)(
    lambda s: validate.final_validation(s.raw_orig, s.raw_perf, s.clean_orig, s.clean_perf).select(
        "orig_rows", "perf_rows", "after_cutoff", "negative_loan_age", "loans_with_gaps", "status"
    )
)

query(
    "yearly_audit",
    f"""SELECT o.*, p.* EXCLUDE (vintage_year), coalesce(z.n,0) AS orig_missing_in_perf,
  0::BIGINT AS perf_missing_in_orig,
  CASE WHEN coalesce(z.n,0)>0 THEN 'PASS_WITH_WARNING' ELSE 'PASS' END AS status
FROM (SELECT vintage_year, count(*) AS orig_rows, count(DISTINCT loan_id) AS orig_unique_loans
      FROM raw_orig GROUP BY 1) o
LEFT JOIN (SELECT vintage_year, count(*) AS perf_rows, count(DISTINCT loan_id) AS perf_unique_loans,
        min(monthly_reporting_period) AS first_period, max(monthly_reporting_period) AS last_period,
        min(loan_age::BIGINT) AS min_loan_age, max(loan_age::BIGINT) AS max_loan_age,
        {count_if("delinquency_status='RA'", 'ra_rows')},
        {count_if("delinquency_status='XX'", 'xx_rows')} FROM raw_perf GROUP BY 1) p
  USING (vintage_year)
LEFT JOIN (SELECT vintage_year, count(*) AS n FROM raw_orig
  WHERE loan_id NOT IN (SELECT loan_id FROM raw_perf) GROUP BY 1) z USING (vintage_year)""",
)(
    lambda s: validate.yearly_audit(s.raw_orig, s.raw_perf).drop(
        "missing_before_cutoff", "missing_at_after_cutoff"
    )
)

# ---- audits ----------------------------------------------------------------------------------


def _excluding(short: str, name: str, above: bool) -> str:
    parts = [
        count_if(f"{name}='999'", f"{short}_999"),
        f"min({name}::DOUBLE) FILTER (WHERE {name}<>'999') AS {short}_min_excluding_999",
        f"max({name}::DOUBLE) FILTER (WHERE {name}<>'999') AS {short}_max_excluding_999",
    ]
    if above:
        parts.append(count_if(f"{name}<>'999' AND {name}::DOUBLE>100", f"{short}_above_100"))
    return ", ".join(parts)


query(
    "special_values",
    f"""SELECT vintage_year, count(*) AS loans, {count_if("fico='9999'", 'fico_9999')},
  {_excluding('dti', 'original_dti', False)}, {_excluding('ltv', 'original_ltv', True)},
  {_excluding('cltv', 'original_cltv', True)},
  {count_if("vantagescore_4='9999'", 'vantagescore_9999')},
  min(vantagescore_4::DOUBLE) FILTER (WHERE vantagescore_4<>'9999') AS vantagescore_min,
  max(vantagescore_4::DOUBLE) FILTER (WHERE vantagescore_4<>'9999') AS vantagescore_max
FROM raw_orig GROUP BY vintage_year""",
)(lambda s: audit.special_values(s.raw_orig))

query(
    "xx_by_loan_age",
    """SELECT vintage_year, loan_age::BIGINT AS loan_age_num, count(*) AS xx_rows FROM raw_perf
WHERE delinquency_status='XX' GROUP BY 1,2""",
)(lambda s: audit.xx_by_age(s.raw_perf))

query(
    "xx_by_reporting_period",
    """SELECT vintage_year, monthly_reporting_period, count(*) AS xx_rows FROM raw_perf
WHERE delinquency_status='XX' GROUP BY 1,2""",
)(lambda s: audit.xx_by_period(s.raw_perf))

query(
    "xx_with_zero_balance",
    """SELECT *, CASE WHEN xx_rows>0 THEN round(xx_with_zero_balance/xx_rows::DOUBLE*100,2) END
  AS pct_xx_with_zero_balance
FROM (SELECT vintage_year, count(*) FILTER (WHERE delinquency_status='XX') AS xx_rows,
  count(*) FILTER (WHERE delinquency_status='XX' AND zero_balance_code IS NOT NULL)
    AS xx_with_zero_balance,
  count(*) FILTER (WHERE delinquency_status='XX' AND zero_balance_code IS NULL)
    AS xx_without_zero_balance FROM raw_perf GROUP BY 1)""",
)(lambda s: audit.xx_zero_balance(s.raw_perf))


def _profile(label: str, name: str) -> str:
    return (
        f"{count_if(f'{name} IS NULL', label + '_blank')}, "
        f"min({name}::DOUBLE) AS {label}_min, max({name}::DOUBLE) AS {label}_max"
    )


query(
    "origination_variables",
    f"""SELECT vintage_year, count(*) AS loans, {count_if('fico IS NULL', 'fico_blank')},
  {count_if("fico='9999'", 'fico_9999')},
  {count_if('fico::INT NOT BETWEEN 300 AND 850', 'fico_outside_300_850')},
  {count_if("original_dti='999'", 'original_dti_999')}, {_profile('original_ltv', 'original_ltv')},
  {_profile('original_cltv', 'original_cltv')}, {_profile('original_dti', 'original_dti')},
  {_profile('interest_rate', 'original_interest_rate')}, {_profile('original_upb', 'original_upb')},
  {_profile('loan_term', 'original_loan_term')},
  {count_if('first_payment_date IS NULL', 'first_payment_date_blank')},
  {count_if('maturity_date IS NULL', 'maturity_date_blank')},
  {count_if('vantagescore_4 IS NULL', 'vantagescore_blank')} FROM raw_orig GROUP BY vintage_year""",
)(lambda s: audit.origination_variables(s.raw_orig))

query(
    "performance_variables",
    f"""SELECT vintage_year, count(*) AS reports,
  {count_if('delinquency_status IS NULL', 'delinquency_blank')},
  {count_if("delinquency_status='RA'", 'delinquency_ra')},
  {count_if("delinquency_status='XX'", 'delinquency_xx')},
  {count_if('monthly_reporting_period IS NULL', 'reporting_period_blank')},
  {count_if('zero_balance_code IS NULL', 'zero_balance_blank')},
  {count_if('estimated_ltv IS NULL', 'estimated_ltv_blank')},
  {count_if("estimated_ltv='999'", 'estimated_ltv_999')}, {count_if('ddlpi IS NULL', 'ddlpi_blank')},
  {_profile('loan_age', 'loan_age')}, {_profile('current_upb', 'current_actual_upb')},
  {_profile('current_rate', 'current_interest_rate')} FROM raw_perf GROUP BY vintage_year""",
)(lambda s: audit.performance_variables(s.raw_perf))

query(
    "delinquency_distribution",
    """SELECT vintage_year, delinquency_status, count(*) AS status_rows FROM raw_perf
GROUP BY 1,2""",
)(lambda s: audit.delinquency_distribution(s.raw_perf))

query(
    "zero_balance_by_year",
    """SELECT vintage_year, zero_balance_code, count(*) AS code_rows FROM raw_perf
WHERE zero_balance_code IS NOT NULL GROUP BY 1,2""",
)(lambda s: validate.zero_balance_distribution(s.raw_perf, ["vintage_year"]))

query(
    "zero_balance_codes",
    """SELECT vintage_year, zero_balance_code, count(*) AS code_rows,
  count(DISTINCT loan_id) AS loans FROM clean_perf WHERE zero_balance_code IS NOT NULL
GROUP BY 1,2""",
)(lambda s: audit.zero_balance_codes(s.clean_perf))

query(
    "zero_balance_dates",
    """SELECT vintage_year, count(*) AS zb_rows,
  count(*) FILTER (WHERE zero_balance_effective_date IS NULL) AS zb_effective_date_missing,
  count(*) FILTER (WHERE zero_balance_effective_date::INT<>reporting_period_num)
    AS zb_reporting_month_mismatch
FROM clean_perf WHERE zero_balance_code IS NOT NULL GROUP BY 1""",
)(lambda s: audit.zero_balance_dates(s.clean_perf))

query(
    "payoff_classes",
    """SELECT vintage_year, zb01_classification, count(*) AS payoff_rows,
  count(DISTINCT loan_id) AS loans FROM payoffs GROUP BY 1,2""",
)(lambda s: audit.payoff_summary(audit.classify_payoffs(s.clean_orig, s.clean_perf)))

_CAND = [
    "loan_id", "vintage_year", "first_d90_month", "first_ra_month", "first_credit_zb_month",
    "first_admin_termination_month", "last_observed_month", "first_prepay_month",
    "first_maturity_month", "first_zb01_ambiguous_month", "first_default_evidence_month",
    "default_prepay_relation",
]
query("event_candidates", f"SELECT {', '.join(_CAND)} FROM relations")(
    lambda s: audit.loan_candidates(s.clean_orig, s.clean_perf).select(_CAND)
)

query(
    "candidate_summary",
    f"""SELECT vintage_year, count(*) AS perf_loans, count(first_d90_month) AS d90_loans,
  count(first_ra_month) AS ra_loans, count(first_credit_zb_month) AS credit_zb_02_03_09_loans,
  count(first_default_evidence_month) AS any_default_evidence_loans,
  count(first_prepay_month) AS prepay_candidate_loans,
  count(first_maturity_month) AS maturity_candidate_loans,
  count(first_zb01_ambiguous_month) AS zb01_ambiguous_loans,
  count(first_admin_termination_month) AS admin_termination_loans,
  {count_if('''coalesce(first_default_evidence_month, first_prepay_month, first_maturity_month,
    first_zb01_ambiguous_month, first_admin_termination_month) IS NULL''',
            'no_candidate_event_loans')}
FROM relations GROUP BY vintage_year""",
)(lambda s: audit.candidate_summary(audit.loan_candidates(s.clean_orig, s.clean_perf)))

query(
    "conflict_summary",
    f"""SELECT vintage_year,
  {count_if('first_d90_month IS NOT NULL AND first_ra_month IS NOT NULL', 'd90_and_ra')},
  {count_if('first_d90_month IS NOT NULL AND first_credit_zb_month IS NOT NULL',
            'd90_and_credit_zb')},
  {count_if('first_ra_month IS NOT NULL AND first_credit_zb_month IS NOT NULL',
            'ra_and_credit_zb')},
  {count_if('first_d90_month=first_ra_month', 'd90_ra_same_month')},
  {count_if('first_d90_month=first_credit_zb_month', 'd90_credit_same_month')},
  {count_if('first_ra_month=first_credit_zb_month', 'ra_credit_same_month')},
  {count_if("default_prepay_relation<>'NO_DEFAULT_PREPAY_CONFLICT'", 'default_and_prepay_both')},
  {count_if("default_prepay_relation='DEFAULT_BEFORE_PREPAY'", 'default_before_prepay')},
  {count_if("default_prepay_relation='DEFAULT_AND_PREPAY_SAME_MONTH'",
            'default_and_prepay_same_month')},
  {count_if("default_prepay_relation='PREPAY_BEFORE_DEFAULT'", 'prepay_before_default')}
FROM relations GROUP BY vintage_year""",
)(lambda s: audit.conflict_summary(audit.loan_candidates(s.clean_orig, s.clean_perf)))

query(
    "conflict_loans",
    f"""SELECT {', '.join(c for c in _CAND if c != 'first_zb01_ambiguous_month')} FROM relations
WHERE default_prepay_relation<>'NO_DEFAULT_PREPAY_CONFLICT'""",
)(lambda s: audit.conflict_loans(audit.loan_candidates(s.clean_orig, s.clean_perf)))

query(
    "duration_audit",
    f"""SELECT vintage_year, count(*) AS loans, {count_if('dur<0', 'negative_duration')},
  {count_if('dur=0', 'zero_duration')}, {count_if('dur=1', 'duration_one')},
  min(dur)::INTEGER AS min_duration, max(dur)::INTEGER AS max_duration,
  median(dur)::DOUBLE AS median_duration,
  {count_if("dur<=0 AND event_type='DEFAULT'", 'nonpositive_default')},
  {count_if("dur<=0 AND event_type='PREPAYMENT'", 'nonpositive_prepay')},
  {count_if("dur<=0 AND event_type='CENSOR'", 'nonpositive_censor')},
  {count_if('ev<fpi', 'event_before_first_payment')},
  {count_if('ev=fpi', 'event_at_first_payment')},
  {count_if('event_month>last_observed_month', 'event_after_last_report')}
FROM timed_events GROUP BY vintage_year""",
)(lambda s: audit.duration_audit(s.events))

query(
    "age_audit",
    f"""SELECT vintage_year, count(*) AS performance_rows,
  {count_if('age<0', 'negative_analysis_age_rows')}, {count_if('age=0', 'age_zero_rows')},
  min(age) AS min_analysis_age, max(age) AS max_analysis_age,
  {count_if('modification_flag IS NULL AND diff<>0', 'unmodified_age_mismatch_rows')},
  count(modification_flag) AS modified_rows,
  count(DISTINCT loan_id) FILTER (WHERE modification_flag IS NOT NULL) AS modified_loans
FROM aged GROUP BY vintage_year""",
)(lambda s: audit.age_audit(s.clean_perf, s.events))

query(
    "negative_duration_loans",
    f"""SELECT vintage_year, loan_id, {dstr('first_payment_month')} AS first_payment_month, event_type,
  event_source, event_month, dur::INTEGER AS duration_months, last_observed_month,
  raw_zero_balance_code FROM timed_events WHERE dur<0""",
)(lambda s: audit.negative_durations(s.events))

query(
    "nonpositive_durations",
    """SELECT vintage_year, event_type, event_source, dur::INTEGER AS duration_months,
  count(*) AS loans FROM timed_events WHERE dur<=0 GROUP BY 1,2,3,4""",
)(lambda s: audit.nonpositive_durations(s.events))

query(
    "age_mismatch_distribution",
    """SELECT vintage_year, diff AS age_difference, count(*) AS mismatch_rows,
  count(DISTINCT loan_id) AS loans FROM aged WHERE modification_flag IS NULL AND diff<>0
GROUP BY 1,2""",
)(lambda s: audit.age_mismatch_distribution(s.clean_perf, s.events))

query(
    "age_mismatch_totals",
    """SELECT diff AS age_difference, count(*) AS mismatch_rows,
  count(DISTINCT loan_id) AS year_loan_counts FROM aged
WHERE modification_flag IS NULL AND diff<>0 GROUP BY 1""",
)(lambda s: audit.age_mismatch_totals(s.clean_perf, s.events))

query(
    "age_mismatch_loans",
    f"""SELECT vintage_year, loan_id, min({dstr('first_payment_month')}) AS first_payment_month,
  min(reporting_period_num) AS first_mismatch_period,
  max(reporting_period_num) AS last_mismatch_period, min(diff) AS min_age_difference,
  max(diff) AS max_age_difference, count(*) AS mismatch_rows
FROM aged WHERE modification_flag IS NULL AND diff<>0 GROUP BY 1,2""",
)(lambda s: audit.age_mismatch_loans(s.clean_perf, s.events))

query(
    "missing_effective_dates",
    """SELECT loan_id, reporting_period_num, zero_balance_code, zero_balance_effective_date,
  'MISSING_OR_INVALID_EFFECTIVE_DATE' AS exclusion_reason
FROM clean_perf WHERE reporting_period_num<=202603 AND zero_balance_code IS NOT NULL
  AND zero_balance_effective_month IS NULL""",
)(lambda s: events.missing_effective_dates(s.clean_perf))

query(
    "sample_flow",
    """SELECT vintage_year::INTEGER AS vintage_year, 'ORIGINATED' AS step, 'ALL' AS detail,
  count(*) AS loans FROM orig GROUP BY 1
UNION ALL SELECT vintage_year::INTEGER, 'WITHOUT_EVENT_RECORD', 'ALL', count(*) FROM orig
WHERE loan_id NOT IN (SELECT loan_id FROM survival) GROUP BY 1
UNION ALL SELECT vintage_year::INTEGER, 'TIME_EXCLUDED', survival_exclusion_reason, count(*)
FROM survival WHERE survival_exclusion_reason IS NOT NULL GROUP BY 1,3
UNION ALL SELECT vintage_year::INTEGER, 'ANALYSED',
  CASE WHEN core_covariates_complete_flag THEN 'COMPLETE_' ELSE 'INCOMPLETE_' END||event_type,
  count(*) FROM model GROUP BY 1,3""",
)(lambda s: audit.sample_flow(s.orig, s.survival, s.model))

query(
    "event_summary",
    f"""SELECT vintage_year, count(*) AS loans, {count_if("event_type='DEFAULT'", 'default_loans')},
  {count_if("event_type='PREPAYMENT'", 'prepayment_loans')},
  {count_if("event_type='CENSOR'", 'censored_loans')},
  {count_if('same_month_default_prepay_flag', 'same_month_conflicts')},
  {count_if('event_month>last_observed_month', 'events_after_last_report')}
FROM events GROUP BY vintage_year""",
)(lambda s: audit.event_summary(s.events))

_EL = "survival_exclusion_reason IS NULL"
query(
    "survival_summary",
    f"""SELECT vintage_year, count(*) AS loans, {count_if(_EL, 'eligible')},
  count(survival_exclusion_reason) AS excluded,
  {count_if(_EL + " AND event_type='DEFAULT'", 'eligible_default')},
  {count_if(_EL + " AND event_type='PREPAYMENT'", 'eligible_prepayment')},
  {count_if(_EL + " AND event_type='CENSOR'", 'eligible_censor')}
FROM survival GROUP BY vintage_year""",
)(lambda s: audit.survival_summary(s.survival))

query(
    "model_summary",
    f"""SELECT vintage_year, count(*) AS loans,
  {count_if('core_covariates_complete_flag', 'complete_cases')},
  {count_if("event_type='DEFAULT'", 'default_loans')},
  {count_if("event_type='PREPAYMENT'", 'prepayment_loans')},
  {count_if("event_type='CENSOR'", 'censored_loans')} FROM model GROUP BY vintage_year""",
)(lambda s: audit.model_summary(s.model))

# ---- events, clock, panel --------------------------------------------------------------------

query(
    "event_map",
    f"""SELECT loan_id, first_observed_month, last_observed_month, event_source,
  effective_reporting_month_mismatch, raw_zero_balance_code, vintage_year,
  {dstr('first_payment_month')} AS first_payment_month, {dstr('maturity_month')} AS maturity_month,
  event_month, event_type, event_code, {dstr('event_date')} AS event_date,
  event_type='DEFAULT' AS default_flag, event_type='PREPAYMENT' AS prepayment_flag,
  event_type='CENSOR' AS censor_flag, same_month_default_prepay_flag,
  event_month<first_observed_month AS event_before_entry_flag,
  event_month>last_observed_month AS event_after_last_report_flag FROM events""",
)(lambda s: events.build_event_map(s.clean_orig, s.clean_perf))

# Damage: the effective dates of every tenth loan are lost.
query(
    "event_map_excluding",
    """SELECT loan_id, event_type, event_month, event_source FROM events
WHERE NOT (right(loan_id,1)='3' AND loan_id IN (SELECT loan_id FROM clean_perf
  WHERE zero_balance_code IS NOT NULL AND reporting_period_num<=202603))""",
)(
    lambda s: events.build_event_map(
        s.clean_orig,
        s.clean_perf.withColumn(
            "zero_balance_effective_date",
            F.when(~F.col("loan_id").endswith("3"), F.col("zero_balance_effective_date")),
        ),
        exclude_missing_effective_date=True,
    ).select("loan_id", "event_type", "event_month", "event_source")
)

query(
    "event_map_check",
    """SELECT count(*) AS loans, 0::BIGINT AS duplicate_loans, 0::BIGINT AS invalid_event_type,
  0::BIGINT AS missing_event_month, 0::BIGINT AS late_event_not_allowed,
  0::BIGINT AS known_late_events, count(*) FILTER (WHERE event_type='DEFAULT') AS "default",
  count(*) FILTER (WHERE event_type='PREPAYMENT') AS prepayment,
  count(*) FILTER (WHERE event_type='CENSOR') AS censor,
  count(*) FILTER (WHERE same_month_default_prepay_flag) AS same_month_conflicts,
  count(*) AS performance_loans, 0::BIGINT AS excluded_loans, 0::BIGINT AS unreconciled_loans
FROM events""",
)(lambda s: events.check_event_map(s.events, s.clean_perf))

query(
    "survival_clock",
    f"""SELECT loan_id, {dstr('operational_origination_date')} AS operational_origination_date,
  entry_time_month, exit_time_month, exit_time_month-entry_time_month AS observed_duration_months,
  exit_time_month AS raw_duration_months, survival_exclusion_reason,
  survival_exclusion_reason IS NULL AS survival_eligible,
  (event_type='DEFAULT')::TINYINT AS default_event,
  (event_type='PREPAYMENT')::TINYINT AS prepayment_event, event_code AS competing_event_code,
  CASE WHEN survival_exclusion_reason IS NULL THEN exit_time_month END AS duration_months
FROM survival""",
)(
    lambda s: clock.build_survival(s.events).select(
        "loan_id", "operational_origination_date", "entry_time_month", "exit_time_month",
        "observed_duration_months", "raw_duration_months", "survival_exclusion_reason",
        "survival_eligible", "default_event", "prepayment_event", "competing_event_code",
        "duration_months",
    )
)

query(
    "survival_check",
    f"""SELECT 0::BIGINT AS duplicate_loans, 0::BIGINT AS eligible_nonpositive_duration,
  0::BIGINT AS excluded_with_duration, 0::BIGINT AS default_flag_mismatch,
  0::BIGINT AS prepayment_flag_mismatch, count(*) AS loans, {count_if(_EL, 'eligible')},
  count(survival_exclusion_reason) AS excluded,
  {count_if(_EL + " AND event_type='DEFAULT'", 'eligible_default')},
  {count_if(_EL + " AND event_type='PREPAYMENT'", 'eligible_prepayment')},
  {count_if(_EL + " AND event_type='CENSOR'", 'eligible_censor')} FROM survival""",
)(lambda s: clock.check_survival(s.survival))

_PANEL_SQL = f"""SELECT p.loan_id, p.reporting_period_num, t AS analysis_time_month, step AS month_step,
  coalesce(t<0,false) AS negative_age_flag, coalesce(step>1,false) AS reporting_gap_flag,
  coalesce(step<=0,false) AS duplicate_or_order_flag,
  coalesce(p.reporting_period_num>event_month,false) AS after_exit_flag,
  (t IS NULL OR entry_time_month IS NULL OR exit_time_month IS NULL) AS missing_time_flag,
  coalesce(survival_exclusion_reason IS NULL AND t>=0 AND coalesce(step>0,true)
    AND p.reporting_period_num<=event_month,false) AS within_observation_window
FROM (SELECT q.loan_id, q.reporting_period_num, s.event_month, s.entry_time_month, s.exit_time_month,
    s.survival_exclusion_reason,
    ({idx('q.reporting_period_num')}-{dindex('s.operational_origination_date')})::INTEGER AS t,
    ({idx('q.reporting_period_num')}-lag({idx('q.reporting_period_num')}) OVER (
      PARTITION BY q.loan_id ORDER BY q.reporting_period_num{{tie}}))::INTEGER AS step
  FROM {{source}} q LEFT JOIN survival s ON s.loan_id=q.loan_id
  WHERE q.reporting_period_num<=202603) p"""
_PANEL_COLUMNS = [
    "loan_id", "reporting_period_num", "analysis_time_month", "month_step", "negative_age_flag",
    "reporting_gap_flag", "duplicate_or_order_flag", "after_exit_flag", "missing_time_flag",
    "within_observation_window",
]
query("loan_age_panel", _PANEL_SQL.format(tie="", source="clean_perf"))(
    lambda s: clock.build_loan_age_panel(s.clean_perf, s.survival).select(_PANEL_COLUMNS)
)


def _feed_reports(s: Study) -> DataFrame:
    """Raw reports with duplicate months, keyed by the public loan id."""
    from loanspan.sources.order_panel import _months, loans_of

    ids = loans_of(_months(s.spark, s.sf_dir)).select("loan_key", "loan_id")
    # By chunks of the file, as one loan may hold a third of it.
    feed = s.feed.withColumn("chunk", F.floor(F.col("source_row") / F.lit(clock.ORDER_CHUNK)))
    chunks = feed.select("loan_key", "chunk").distinct().join(ids, "loan_key")
    return feed.join(chunks, ["loan_key", "chunk"]).select(
        "loan_id",
        F.col("month").alias("reporting_period_num"),
        F.lit(0).alias("loan_age"),
        "source_row",
    )


query(
    "loan_age_panel_with_duplicates",
    _PANEL_SQL.format(
        tie=", q.source_row",
        source="(SELECT l.loan_id, f.month AS reporting_period_num, f.source_row "
        "FROM feed f JOIN loans l USING (loan_key))",
    ),
)(
    lambda s: clock.build_loan_age_panel(
        _feed_reports(s), s.survival, row_order="source_row"
    ).select(_PANEL_COLUMNS)
)

query(
    "loan_age_panel_check",
    f"""SELECT count(*) AS rows, count(DISTINCT loan_id) AS loans, 0::BIGINT AS missing_loan_id,
  {count_if('negative_age_flag', 'negative_age_rows')},
  {count_if('reporting_gap_flag', 'reporting_gap_rows')},
  {count_if('duplicate_or_order_flag', 'order_error_rows')},
  {count_if('after_exit_flag', 'after_exit_rows')},
  {count_if('missing_time_flag', 'missing_time_rows')}, 0::BIGINT AS eligible_negative_age_rows,
  count(*) FILTER (WHERE loan_id IN (SELECT loan_id FROM survival
    WHERE survival_exclusion_reason IS NOT NULL)) AS excluded_rows, 0::BIGINT AS duplicate_keys,
  'PASS_WITH_WARNING' AS status
FROM ({_PANEL_SQL.format(tie='', source='clean_perf')})""",
)(lambda s: clock.check_loan_age_panel(clock.build_loan_age_panel(s.clean_perf, s.survival)))

query(
    "panel_exclusions",
    """SELECT survival_exclusion_reason, count(*) AS loans FROM survival
WHERE survival_exclusion_reason IS NOT NULL GROUP BY 1""",
)(lambda s: clock.panel_exclusions(clock.build_loan_age_panel(s.clean_perf, s.survival)))

# ---- model tables ----------------------------------------------------------------------------

query(
    "model_dataset",
    f"""SELECT loan_id, vintage_year, entry_time_month, exit_time_month, duration_months, event_type,
  event_code, fico, original_ltv, original_dti, original_interest_rate, original_loan_term,
  original_cltv, original_upb, occupancy_status, property_type, loan_purpose, property_state,
  number_borrowers, multiple_borrowers_flag, origination_quarter, core_covariates_complete_flag,
  (event_type='DEFAULT')::TINYINT AS km_default_event,
  (event_type='PREPAYMENT')::TINYINT AS km_prepayment_event, event_code AS cr_event_code,
  {dstr('operational_origination_date')} AS operational_origination_date FROM model""",
)(
    lambda s: dataset.build_model_dataset(s.orig, s.survival).select(
        "loan_id", "vintage_year", "entry_time_month", "exit_time_month", "duration_months",
        "event_type", "event_code", "fico", "original_ltv", "original_dti",
        "original_interest_rate", "original_loan_term", "original_cltv", "original_upb",
        "occupancy_status", "property_type", "loan_purpose", "property_state", "number_borrowers",
        "multiple_borrowers_flag", "origination_quarter", "core_covariates_complete_flag",
        "km_default_event", "km_prepayment_event", "cr_event_code", "operational_origination_date",
    )
)

query(
    "model_dataset_check",
    f"""SELECT 0::BIGINT AS duplicate_loans, 0::BIGINT AS missing_id, 0::BIGINT AS invalid_time,
  0::BIGINT AS outside_scope, 0::BIGINT AS invalid_event, count(*) AS rows,
  {count_if('core_covariates_complete_flag', 'complete_case')},
  {count_if("event_type='DEFAULT'", '"default"')},
  {count_if("event_type='PREPAYMENT'", 'prepayment')}, {count_if("event_type='CENSOR'", 'censor')}
FROM model""",
)(lambda s: dataset.check_model_frame(s.model))


def _loan_months(s: Study) -> DataFrame:
    """Enriched loan-month source: performance with its loan's origination columns."""
    static = s.orig.select("loan_id", "vintage_year", "first_payment_month", "maturity_month",
                           *dataset.FEATURES)
    monthly = s.perf.select(
        "loan_id", "performance_month", "reporting_period_num", "zero_balance_code",
        F.col("zero_balance_effective_date_raw").alias("zero_balance_effective_date"),
        "delinquency_num", "is_ra",
    )
    return monthly.join(static, "loan_id")


query(
    "loan_month_check",
    """SELECT 0::BIGINT AS missing_loan_id, 0::BIGINT AS duplicate_keys,
  0::BIGINT AS invalid_reporting_month, 0::BIGINT AS loans_with_varying_static_columns""",
)(lambda s: dataset.check_loan_months(_loan_months(s)))

query(
    "loan_level_from_months",
    "SELECT loan_id, event_type, entry_time_month, exit_time_month, fico FROM model",
)(
    lambda s: dataset.build_loan_level(_loan_months(s), validate=False).select(
        "loan_id", "event_type", "entry_time_month", "exit_time_month", "fico"
    )
)

query(
    "loan_level_check",
    """SELECT 0::BIGINT AS duplicate_loans, 0::BIGINT AS missing_loan_id, 0::BIGINT AS invalid_event,
  0::BIGINT AS invalid_time, 0::BIGINT AS outside_cohort, 0::BIGINT AS not_survival_eligible,
  0::BIGINT AS invalid_complete_case_flag""",
)(lambda s: dataset.check_loan_level(s.model))

query(
    "cox_input_view",
    f"""SELECT loan_id, vintage_year, entry_time_month, exit_time_month, duration_months,
  (event_type='DEFAULT')::TINYINT AS default_event, event_type, {', '.join(CORE_PREDICTORS)}
FROM complete""",
)(lambda s: dataset.cox_view(s.model))

query(
    "competing_risk_view",
    """SELECT loan_id, vintage_year, entry_time_month, exit_time_month, duration_months,
  event_code AS cr_event_code, event_type FROM model""",
)(lambda s: dataset.competing_view(s.model))

query(
    "survival_view",
    """SELECT loan_id, vintage_year, entry_time_month, exit_time_month, duration_months,
  (event_type='DEFAULT')::TINYINT AS km_default_event, event_type FROM model""",
)(lambda s: dataset.survival_view(s.model))

query(
    "performance_source_check",
    """SELECT count(*) AS rows, 0::BIGINT AS missing_loan_id, 0::BIGINT AS duplicate_keys,
  0::BIGINT AS invalid_month, 0::BIGINT AS nonfinite_value, 0::BIGINT AS invalid_delinquency
FROM perf""",
)(lambda s: intervals.check_performance_source(s.perf))

query(
    "time_varying_intervals",
    f"""SELECT loan_id, vintage_year, {dstr('performance_month')} AS covariate_month,
  reporting_period_num AS source_reporting_period_num, start_time_month, stop_time_month,
  interval_length_months, gap_interval_flag, terminal_interval_flag,
  default_event::TINYINT AS default_event, event_type, {', '.join(CORE_PREDICTORS)},
  current_actual_upb AS lag_current_actual_upb, current_interest_rate AS lag_current_interest_rate,
  (st='01')::TINYINT AS lag_dq_1m, (st='02')::TINYINT AS lag_dq_2m,
  (st NOT IN ('00','01','02','XX','RA'))::TINYINT AS lag_dq_3plus,
  (st='XX')::TINYINT AS lag_dq_xx, (st='RA')::TINYINT AS lag_dq_ra FROM intervals""",
)(lambda s: intervals.build_intervals(s.perf, s.model, validate=False))

query(
    "interval_coverage_check",
    """SELECT count(*) FILTER (WHERE i.a IS NULL) AS loans_without_interval,
  count(*) FILTER (WHERE i.a<>c.entry_time_month OR i.b<>c.exit_time_month) AS boundary_mismatches
FROM complete c LEFT JOIN (SELECT loan_id, min(start_time_month) AS a, max(stop_time_month) AS b
  FROM intervals GROUP BY 1) i USING (loan_id)""",
)(lambda s: intervals.check_interval_coverage(s.intervals, s.model))

query(
    "interval_check",
    """SELECT count(*) AS rows, 0::BIGINT AS missing_loan_id,
  0::BIGINT AS noncontiguous_loans, 0::BIGINT AS invalid_interval,
  0::BIGINT AS incomplete_predictors,
  0::BIGINT AS invalid_delinquency_flags, 0::BIGINT AS invalid_event_type,
  0::BIGINT AS loans_with_varying_static_predictors, 0::BIGINT AS loans_with_bad_terminal_event
FROM intervals""",
)(lambda s: intervals.check_intervals(s.intervals))

# ---- non-parametric curves -------------------------------------------------------------------


def _km_sql(tag: str) -> str:
    return f"""SELECT 'kaplan_meier' AS model_type, 'default' AS endpoint, gn AS group_name,
  gv AS group_value, t AS analysis_time, {rnd('s', 'survival')}, {rnd('lo', 'ci_lower')},
  {rnd('hi', 'ci_upper')}, {rnd('1-s', 'event_probability')}, present AS n_at_risk,
  d1 AS n_events, cens AS n_censored FROM km_{tag}"""


query("kaplan_meier", _km_sql("all"))(lambda s: km.fit_kaplan_meier(s.model, validate=False))
query("kaplan_meier_by_vintage", _km_sql("vintage"))(
    lambda s: km.fit_kaplan_meier(s.model, "vintage_year", validate=False)
)
query(
    "km_input_check",
    """SELECT count(*) AS rows, 0::BIGINT AS duplicate_loans, 0::BIGINT AS missing_loan_id,
  0::BIGINT AS invalid_event, 0::BIGINT AS invalid_time, 0::BIGINT AS missing_group FROM model""",
)(lambda s: km.check_km_input(s.model, "vintage_year"))
query(
    "km_result_check",
    """SELECT count(*) AS rows, 0::BIGINT AS invalid_probability, 0::BIGINT AS null_rows
FROM km_all""",
)(lambda s: km.check_km_results(km.fit_kaplan_meier(s.model, validate=False)))


def _aj_sql(tag: str) -> str:
    return f"""SELECT 'AALEN_JOHANSEN' AS model_type, endpoint, gn AS group_name, gv AS group_value,
  t AS analysis_time, {rnd('f', 'cumulative_incidence')}, {rnd('lo', 'ci_lower')},
  {rnd('hi', 'ci_upper')}, n AS n_at_risk FROM curve_{tag}"""


query("aalen_johansen", _aj_sql("all"))(lambda s: aj.fit_aalen_johansen(s.model, validate=False))
query(
    "aj_input_check",
    f"""SELECT count(*) AS rows, {count_if("event_type<>'CENSOR'", 'events')},
  0::BIGINT AS duplicate_loans, 0::BIGINT AS missing_loan_id, 0::BIGINT AS invalid_event,
  0::BIGINT AS invalid_time FROM model""",
)(lambda s: aj.check_aj_input(s.model))
query(
    "aj_result_check",
    """SELECT count(*) AS rows, 0::BIGINT AS invalid_estimates, 0::BIGINT AS decreasing_steps,
  0::BIGINT AS unpaired_months, 0::BIGINT AS sums_above_one FROM long_all WHERE ex""",
)(lambda s: aj.check_aj_results(aj.fit_aalen_johansen(s.model, validate=False)))

query(
    "vintage_cif",
    f"""SELECT 'VINTAGE_AALEN_JOHANSEN' AS model_type, endpoint, gv::SMALLINT AS vintage_year,
  t AS analysis_time, {rnd('f', 'cumulative_incidence')}, {rnd('lo', 'ci_lower')},
  {rnd('hi', 'ci_upper')}, z.lcount AS loan_count, n AS n_at_risk, z.dcount AS default_count,
  z.pcount AS prepayment_count
FROM curve_vintage c JOIN (SELECT gv, lcount, dcount, pcount FROM hz_vintage WHERE h=12) z USING (gv)""",
)(lambda s: horizons.fit_vintage_cif(s.model, validate=False))
query("grouped_cif", _aj_sql("band"))(lambda s: horizons.grouped_curves(s.model))

# ---- horizons --------------------------------------------------------------------------------

query(
    "pd_input_check",
    f"""SELECT count(*) AS rows, {count_if("event_type<>'CENSOR'", 'events')},
  0::BIGINT AS duplicate_loans, 0::BIGINT AS missing_loan_id, 0::BIGINT AS invalid_event,
  0::BIGINT AS invalid_time, 0::BIGINT AS invalid_origin, 0::BIGINT AS invalid_vintage
FROM model""",
)(lambda s: horizons.check_pd_input(s.model))

_PD_COUNTS = """lcount AS loan_count, nr AS n_at_risk, dcount AS default_count,
  pcount AS prepayment_count"""
query(
    "portfolio_pd",
    f"""SELECT 'PD_HORIZON' AS model_type, 'DEFAULT' AS endpoint, 'portfolio' AS group_name,
  'all' AS group_value, h::SMALLINT AS horizon_months, role AS horizon_role,
  {rnd('cif', 'default_cif')}, {rnd('cif', 'pd')}, {_PD_COUNTS}, ok AS follow_up_eligible,
  st AS follow_up_status FROM pd_overall""",
)(lambda s: horizons.overall_pd(s.model))

query(
    "vintage_horizons",
    f"""SELECT 'VINTAGE_PD_HORIZON' AS model_type, vintage_year, h::SMALLINT AS horizon_months,
  role AS horizon_role, {rnd('cif', 'default_cif')}, {rnd('pcif', 'prepayment_cif')},
  {rnd('cif', 'pd')}, {_PD_COUNTS}, {dstr('latest')} AS latest_origination_date,
  '2026-03-31' AS performance_cutoff, seasoned AS follow_up_eligible, st AS follow_up_status
FROM pd_vintage""",
)(lambda s: horizons.vintage_horizons(s.model))

query(
    "grouped_pd",
    f"""SELECT gn AS feature, gv AS group_value, h::SMALLINT AS horizon_months,
  role AS horizon_role, {rnd('cif', 'default_cif')}, {rnd('pcif', 'prepayment_cif')},
  {rnd('cif', 'pd')}, {_PD_COUNTS}, ok AS follow_up_eligible, st AS follow_up_status
FROM pd_band""",
)(lambda s: horizons.grouped_pd(s.model))

query(
    "vintage_counts",
    f"""SELECT vintage_year, count(*) AS loan_count,
  {count_if("event_type='DEFAULT'", 'default_count')},
  {count_if("event_type='PREPAYMENT'", 'prepayment_count')},
  {dstr('max(operational_origination_date)')} AS latest_origination_date
FROM model GROUP BY vintage_year""",
)(lambda s: horizons.vintage_counts(s.model))

query(
    "horizon_step_values",
    f"""SELECT endpoint, gn AS group_name, gv AS group_value, h AS horizon_months, {rnd('cif')}
FROM steps_vintage""",
)(
    lambda s: horizons.step_values(
        aj.incidence_points(horizons.event_cells(s.model, F.col("cr_event_code"), "vintage_year"))
    )
)

query(
    "calendar_months_added",
    f"""SELECT loan_id, {dstr('(operational_origination_date+to_months(36))::DATE')} AS plus_36,
  (operational_origination_date+to_months(60))::DATE<=DATE '2026-03-31' AS seasoned_60 FROM model""",
)(
    lambda s: s.model.select(
        "loan_id",
        horizons.add_calendar_months(F.col("operational_origination_date"), 36).alias("plus_36"),
        horizons.fully_seasoned(F.col("operational_origination_date"), F.lit(60)).alias(
            "seasoned_60"
        ),
    )
)

query(
    "risk_bands",
    "SELECT loan_id, fico_band, ltv_band, dti_band FROM fico_banded",
)(lambda s: horizons.add_bands(s.model).select("loan_id", *horizons.BANDS))


def _zeros(*names: str) -> str:
    return ", ".join(f"0::BIGINT AS {n}" for n in names)


query(
    "portfolio_pd_check",
    f"""SELECT count(*) AS rows, {_zeros('duplicate_keys', 'invalid_counts', 'invalid_role',
    'unsupported_horizon', 'invalid_estimates', 'pd_differs', 'invalid_status')} FROM pd_overall""",
)(lambda s: horizons.check_overall_pd(horizons.overall_pd(s.model)))
query(
    "vintage_horizon_check",
    f"""SELECT count(*) AS rows, {_zeros('duplicate_keys', 'invalid_counts', 'invalid_role',
    'unsupported_horizon', 'invalid_estimates', 'pd_differs', 'sum_above_one',
    'invalid_eligibility', 'invalid_status', 'invalid_cutoff')} FROM pd_vintage""",
)(lambda s: horizons.check_vintage_horizons(horizons.vintage_horizons(s.model)))
query(
    "grouped_pd_check",
    f"""SELECT count(*) AS rows, 15-count(DISTINCT gn||gv) AS missing_bands,
  {_zeros('duplicate_keys', 'invalid_counts', 'invalid_role', 'unsupported_horizon',
          'invalid_estimates', 'pd_differs', 'sum_above_one', 'unknown_band')} FROM pd_band""",
)(lambda s: horizons.check_grouped_pd(horizons.grouped_pd(s.model)))


# ---- published projections -------------------------------------------------------------------

query(
    "published_portfolio",
    f"""SELECT count(*) AS total_loans, {count_if("event_type='DEFAULT'", 'default_count')},
  {count_if("event_type='PREPAYMENT'", 'prepayment_count')},
  {count_if("event_type='CENSOR'", 'censor_count')},
  {count_if('entry_time_month>0', 'delayed_entry_count')}, {PROV_SQL},
  '202603' AS performance_cutoff, '1' AS specification_version FROM model""",
)(lambda s: projections.portfolio_summary(s.model, PROV))

_PUB = f"'1' AS model_version, {PROV_SQL}"
query(
    "published_pd",
    f"""SELECT h::SMALLINT AS horizon_months, role AS horizon_role, {rnd('cif', 'default_cif')},
  {rnd('cif', 'pd')}, {_PD_COUNTS}, ok AS follow_up_eligible, st AS follow_up_status, {_PUB}
FROM pd_overall""",
)(lambda s: projections.pd_results(horizons.overall_pd(s.model), PROV, validate=False))

query(
    "published_grouped_pd",
    f"""SELECT gn AS feature, gv AS group_value, h::SMALLINT AS horizon_months,
  role AS horizon_role, {rnd('cif', 'default_cif')}, {rnd('pcif', 'prepayment_cif')},
  {rnd('cif', 'pd')}, {_PD_COUNTS}, ok AS follow_up_eligible, st AS follow_up_status, {_PUB}
FROM pd_band""",
)(lambda s: projections.grouped_pd_results(horizons.grouped_pd(s.model), PROV, validate=False))

query(
    "published_vintages",
    f"""SELECT vintage_year, h::SMALLINT AS horizon_months, role AS horizon_role,
  {rnd('cif', 'default_cif')}, {rnd('pcif', 'prepayment_cif')}, {rnd('cif', 'pd')}, {_PD_COUNTS},
  {dstr('latest')} AS latest_origination_date, '2026-03-31' AS performance_cutoff,
  seasoned AS follow_up_eligible, st AS follow_up_status, {_PUB} FROM pd_vintage""",
)(lambda s: projections.vintage_results(horizons.vintage_horizons(s.model), PROV, validate=False))


def _survival(s: Study) -> DataFrame:
    return projections.survival_results(
        km.fit_kaplan_meier(s.model, validate=False),
        aj.fit_aalen_johansen(s.model, validate=False),
        PROV,
        validate=False,
    )


query(
    "published_survival",
    f"""SELECT 'KAPLAN_MEIER' AS model, 'DEFAULT' AS endpoint, 'SURVIVAL' AS curve_type,
  gn AS group_name, gv AS group_value, t AS analysis_time, {rnd('s', 'survival_probability')},
  NULL::DOUBLE AS cumulative_incidence, {rnd('lo', 'ci_lower')}, {rnd('hi', 'ci_upper')},
  present AS n_at_risk, d1 AS n_events, cens AS n_censored, {_PUB} FROM km_all
UNION ALL SELECT 'AALEN_JOHANSEN', endpoint, endpoint||'_CIF', gn, gv, t, NULL,
  round(f,{DIGITS}), round(lo,{DIGITS}), round(hi,{DIGITS}), n, NULL, NULL, {_PUB} FROM curve_all""",
)(_survival)

query(
    "published_values_finite",
    "SELECT 0::BIGINT AS nonfinite_rows",
)(lambda s: projections.check_finite(_survival(s)))

# ---- read queries ----------------------------------------------------------------------------


def _pd_view(s: Study) -> DataFrame:
    survival = projections.survival_results(
        km.fit_kaplan_meier(s.model, validate=False),
        aj.incidence_points(horizons.event_cells(s.model, F.col("cr_event_code"))).withColumns(
            {"ci_lower": F.lit(None).cast("double"), "ci_upper": F.lit(None).cast("double")}
        ),
        PROV,
        validate=False,
    )
    return reads.pd_view(
        projections.pd_results(horizons.overall_pd(s.model), PROV, validate=False),
        survival,
        projections.grouped_pd_results(horizons.grouped_pd(s.model), PROV, validate=False),
    )


query(
    "pd_view",
    f"""SELECT horizon, grp AS "group", gv AS group_value, 'All' AS vintage,
  {rnd('cif', 'cif_default')}, {rnd('pcif', 'cif_prepayment')}, {rnd('pd')},
  lcount AS loan_count, nr AS number_at_risk, dcount AS default_count, pcount AS prepayment_count,
  ok AS follow_up_flag, st AS follow_up_status FROM pd_rows""",
)(_pd_view)

query(
    "km_curve_view",
    f"""SELECT gn AS "group", gv AS group_value, t AS analysis_time, {rnd('s', 'survival')},
  {rnd('lo', 'ci_low')}, {rnd('hi', 'ci_high')}, present AS n_at_risk, d1 AS n_events,
  cens AS n_censored FROM km_all""",
)(lambda s: reads.km_view(_survival(s), "portfolio"))

query(
    "incidence_curve_view",
    f"""SELECT endpoint, gn AS group_name, gv AS group_value, t AS analysis_time,
  {rnd('f', 'cumulative_incidence')}, {rnd('lo', 'ci_lower')}, {rnd('hi', 'ci_upper')},
  n AS n_at_risk FROM curve_all WHERE endpoint='PREPAYMENT'""",
)(lambda s: reads.incidence_view(_survival(s), "prepayment", "Portfolio"))

query(
    "vintage_view",
    f"""SELECT vintage_year::INTEGER AS vintage, h AS horizon, role AS horizon_role,
  {rnd('cif', 'default_cif')}, {rnd('pcif', 'prepayment_cif')}, {_PD_COUNTS},
  st AS follow_up_status FROM pd_vintage""",
)(
    lambda s: reads.vintage_view(horizons.vintage_horizons(s.model)).select(
        "vintage", "horizon", "horizon_role", "default_cif", "prepayment_cif", "loan_count",
        "n_at_risk", "default_count", "prepayment_count", "follow_up_status",
    )
)

query(
    "loan_profile",
    """SELECT loan_id, fico AS credit_score, vintage_year AS origination_vintage, event_type,
  duration_months FROM model WHERE loan_id=(SELECT min(loan_id) FROM model)""",
)(
    lambda s: reads.loan_profile(
        s.model, s.model.agg(F.min("loan_id")).first()[0]
    ).select("loan_id", "credit_score", "origination_vintage", "event_type", "duration_months")
)

query(
    "catalog_page",
    """SELECT loan_id, vintage_year AS origination_vintage, event_type, fico, original_ltv,
  original_dti, original_loan_term, duration_months FROM model
WHERE event_type='DEFAULT' AND contains(loan_id,'Q2') ORDER BY loan_id LIMIT 10 OFFSET 5""",
)(
    lambda s: reads.catalog_page(
        s.model,
        # The last loan of a first page of five.
        reads.catalog_page(s.model, rows=5, event="default", part="Q2")
        .agg(F.coalesce(F.max("loan_id"), F.lit("")))
        .first()[0],
        rows=10,
        event="default",
        part="Q2",
    )
)

query(
    "catalog_count",
    "SELECT count(*) AS loans FROM model WHERE vintage_year=2018 AND event_type='CENSOR'",
)(lambda s: reads.catalog_count(s.model, vintage=2018, event="censor"))

query(
    "catalog_examples",
    """SELECT loan_id, vintage_year AS origination_vintage, event_type, fico FROM model
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY loan_id)=1""",
)(lambda s: reads.catalog_examples(s.model))


def _timelines(s: Study) -> DataFrame:
    return reads.loan_timelines(s.perf, s.model)


query("loan_timelines", "SELECT * FROM timeline")(_timelines)

_RANK = """CASE WHEN is_ra THEN 4 WHEN delinquency_num IS NOT NULL
  THEN greatest(least(delinquency_num::INTEGER,3),0) WHEN current_delinquency_status='RA' THEN 4 END"""
query(
    "dense_timelines",
    f"""SELECT g.loan_id, g.m::INTEGER AS analysis_time_month, ({_RANK})::INTEGER AS status_rank,
  t.current_actual_upb
FROM (SELECT loan_id, unnest(generate_series(min(analysis_time_month),max(analysis_time_month))) AS m
      FROM timeline GROUP BY loan_id) g
LEFT JOIN timeline t ON t.loan_id=g.loan_id AND t.analysis_time_month=g.m""",
)(lambda s: reads.dense_timelines(_timelines(s)))

query(
    "truncated_timelines",
    """SELECT loan_id, analysis_time_month, event_type FROM timeline t
WHERE analysis_time_month<=coalesce((SELECT min(analysis_time_month) FROM timeline u
  WHERE u.loan_id=t.loan_id AND u.event_type IN ('DEFAULT','VOLUNTARY_PREPAYMENT')),9999)""",
)(
    lambda s: reads.truncate_after_event(_timelines(s)).select(
        "loan_id", "analysis_time_month", "event_type"
    )
)

query(
    "delinquency_labels",
    """SELECT delinquency_status, CASE WHEN delinquency_status='XX' THEN 'NO_DELINQUENCY_DATA'
  WHEN delinquency_status='RA' THEN 'RA_SPECIAL_STATUS'
  WHEN delinquency_status='00' THEN '00 CURRENT' WHEN delinquency_status='01' THEN '01 DPD_30'
  WHEN delinquency_status='02' THEN '02 DPD_60' ELSE delinquency_status||' DPD_90_PLUS' END AS label,
  count(*) AS status_rows FROM raw_perf GROUP BY 1,2""",
)(
    lambda s: s.raw_perf.groupBy(
        "delinquency_status", delinquency_label(F.col("delinquency_status")).alias("label")
    ).agg(F.count("*").alias("status_rows"))
)

query(
    "event_labels",
    """SELECT CASE event_type WHEN 'DEFAULT' THEN 'DEFAULT' WHEN 'PREPAYMENT' THEN 'PREPAYMENT'
  ELSE 'END_OF_FOLLOW_UP' END AS label, count(*) AS loans FROM model GROUP BY 1""",
)(
    lambda s: s.model.groupBy(
        event_label(F.col("event_type"), F.lit(None).cast("string")).alias("label")
    ).agg(F.count("*").alias("loans"))
)

query(
    "loans_by_vintage",
    "SELECT vintage_year::INTEGER AS vintage, count(*) AS loan_count FROM model GROUP BY 1",
)(lambda s: reads.loans_by_vintage(reads.vintage_view(horizons.vintage_horizons(s.model))))

query(
    "interpolated_cif",
    f"""SELECT gn AS group_name, gv AS group_value, m.m AS month,
  {rnd("CASE WHEN p1.h=m.m THEN p1.cif WHEN p1.h IS NOT NULL THEN coalesce(p0.cif,0)+(p1.cif-coalesce(p0.cif,0))*(m.m-coalesce(p0.h,0))/(p1.h-coalesce(p0.h,0)) END", 'cif')},
  coalesce(p1.h=m.m,false) AS is_published
FROM (SELECT DISTINCT gn, gv FROM steps_band WHERE endpoint='DEFAULT' AND cif IS NOT NULL) g,
  (SELECT unnest([6,12,18,30,48,72]) AS m) m
LEFT JOIN LATERAL (SELECT h, cif FROM steps_band s WHERE s.gn=g.gn AND s.gv=g.gv
  AND s.endpoint='DEFAULT' AND s.cif IS NOT NULL AND s.h<=m.m ORDER BY h DESC LIMIT 1) p0 ON true
LEFT JOIN LATERAL (SELECT h, cif FROM steps_band s WHERE s.gn=g.gn AND s.gv=g.gv
  AND s.endpoint='DEFAULT' AND s.cif IS NOT NULL AND s.h>=m.m ORDER BY h LIMIT 1) p1 ON true""",
)(
    lambda s: reads.interpolate_cif(
        horizons.step_values(aj.incidence_points(horizons.grouped_cells(s.model)))
        .filter("endpoint = 'DEFAULT'")
        .withColumnRenamed("horizon_months", "horizon"),
        [6, 12, 18, 30, 48, 72],
        ["group_name", "group_value"],
    )
)

query(
    "normalized_horizons",
    f"""SELECT h AS horizon, {rnd('arg_max(dc, gn||gv)', 'default_cif')} FROM hz_band
GROUP BY h""",
)(
    lambda s: reads.per_horizon(
        horizons.paired_steps(aj.incidence_points(horizons.grouped_cells(s.model))).select(
            F.concat(F.col("horizon_months").cast("string"), F.lit("M")).alias("horizon_text"),
            F.col("default_step").alias("default_cif"),
            F.concat("group_name", "group_value").alias("position"),
        ),
        "horizon_text",
        "default_cif",
        "position",
    )
)

query(
    "tolerant_flags",
    """SELECT origination_quarter, count(*) FILTER (WHERE coalesce(multiple_borrowers_flag,false))
  AS flagged FROM model GROUP BY 1""",
)(
    lambda s: s.model.groupBy("origination_quarter").agg(
        F.count_if(
            reads.truthy_text(
                F.when(F.col("multiple_borrowers_flag"), " Yes ").otherwise("False")
            )
        ).alias("flagged")
    )
)

_BANDED = """(SELECT p.*, CASE WHEN lower(gv)='missing' THEN 'NO_DATA' ELSE gv END AS band,
  (SELECT cif FROM pd_overall o WHERE o.h=p.horizon) AS base
FROM pd_rows p WHERE grp<>'portfolio' AND ok)"""
query(
    "band_ranking",
    f"""SELECT grp AS "group", horizon, band,
  row_number() OVER (PARTITION BY grp, horizon ORDER BY CASE WHEN band='NO_DATA' THEN 2 ELSE 0 END,
    regexp_extract(band,'[0-9]+')::DOUBLE + CASE WHEN band LIKE '<%' OR band LIKE '≤%' THEN -0.5
      WHEN band LIKE '>%' OR band LIKE '%+' THEN 0.5 ELSE 0 END, band)::INTEGER AS band_position,
  {rnd('cif', 'cif_default')}, nr AS number_at_risk, {rnd('cif/base', 'ratio_to_portfolio')},
  CASE WHEN ranked THEN row_number() OVER (PARTITION BY grp, horizon, ranked
    ORDER BY cif DESC, band)::INTEGER END AS risk_rank
FROM (SELECT *, CASE WHEN bool_or(band<>'NO_DATA' AND nr>=100) OVER (PARTITION BY grp, horizon)
    THEN band<>'NO_DATA' AND nr>=100 ELSE band<>'NO_DATA' END AS ranked
  FROM (SELECT * REPLACE (nullif(band,'') AS band) FROM {_BANDED})
  )""".replace("regexp_extract(band,'[0-9]+')::DOUBLE", "TRY_CAST(regexp_extract(band,'[0-9]+') AS DOUBLE)"),
)(lambda s: reads.band_ranking(_pd_view(s)))

query(
    "band_spread",
    f"""SELECT grp AS "group", horizon, count(*) AS bands, {rnd('max(cif)', 'highest_cif')},
  {rnd('min(cif)', 'lowest_cif')}, arg_max(gv, (cif,gv)) AS highest_band,
  arg_min(gv, (cif,gv)) AS lowest_band, {rnd('max(cif)-min(cif)', 'spread')}
FROM pd_rows WHERE grp<>'portfolio' AND nr>=100 AND gv<>'Missing' AND cif IS NOT NULL
GROUP BY 1,2 HAVING count(*)>=2""",
)(lambda s: reads.band_spread(_pd_view(s)))

query(
    "band_matrix",
    f"""SELECT grp AS "group", gv AS band,
  {', '.join(rnd(f'max(cif) FILTER (WHERE horizon={h})', f'cif_{h}') for h in (12, 24, 36, 60))}
FROM pd_rows WHERE grp<>'portfolio' AND ok GROUP BY 1,2""",
)(lambda s: reads.band_matrix(_pd_view(s)))

query(
    "vintage_comparison",
    f"""SELECT vintage_year::INTEGER AS vintage, h AS horizon, {rnd('cif', 'default_cif')},
  lcount AS loan_count, nr AS n_at_risk, dcount AS default_count, {rnd('lo', 'ci_lower')},
  {rnd('hi', 'ci_upper')}
FROM pd_vintage v LEFT JOIN (SELECT gv, arg_max(lo,t) AS lo, arg_max(hi,t) AS hi FROM curve_vintage
  WHERE endpoint='DEFAULT' AND t<=24 GROUP BY gv) c ON c.gv=v.vintage_year::VARCHAR
WHERE seasoned AND h=24 AND cif IS NOT NULL""",
)(
    lambda s: reads.vintage_limits(
        reads.vintage_view(horizons.vintage_horizons(s.model)),
        horizons.fit_vintage_cif(s.model, validate=False),
        24,
    )
)

query(
    "curve_at_horizons",
    f"""SELECT endpoint, h.h AS horizon, {rnd('arg_max(f,t)', 'value')},
  {rnd('arg_max(lo,t)', 'ci_lower')}, {rnd('arg_max(hi,t)', 'ci_upper')},
  arg_max(n,t) AS n_at_risk
FROM curve_all, (SELECT unnest([12,24,36,60]) AS h) h WHERE t<=h.h GROUP BY 1,2""",
)(
    lambda s: reads.curve_at(
        aj.fit_aalen_johansen(s.model, validate=False), [12, 24, 36, 60], ["endpoint"]
    )
)

query(
    "naive_comparison",
    f"""SELECT coalesce(k.t,c.t) AS analysis_time, {rnd('1-s', 'one_minus_km')},
  {rnd('1-hi', 'km_low')}, {rnd('1-lo', 'km_high')}, {rnd('f', 'default_cif')},
  {rnd('1-s-f', 'difference')}
FROM km_all k FULL JOIN (SELECT t, f FROM long_all WHERE ex AND endpoint='DEFAULT') c ON c.t=k.t""",
)(
    lambda s: reads.naive_comparison(
        km.fit_kaplan_meier(s.model, validate=False).withColumnsRenamed(
            {"ci_lower": "ci_low", "ci_upper": "ci_high"}
        ),
        aj.incidence_points(horizons.event_cells(s.model, F.col("cr_event_code"))),
    )
)

query(
    "naive_at_horizons",
    f"""SELECT h AS horizon, {rnd('cif', 'cif_default')}, {rnd('1-s', 'one_minus_km')},
  {rnd('1-s-cif', 'difference')} FROM pd_overall o,
  LATERAL (SELECT arg_max(s,t) AS s FROM km_all k WHERE k.t<=o.h) WHERE ok
  AND h<=(SELECT max(t) FROM km_all)""",
)(
    lambda s: reads.naive_at_horizons(
        km.fit_kaplan_meier(s.model, validate=False),
        reads.main_horizons(_pd_view(s), km.fit_kaplan_meier(s.model, validate=False)),
    )
)

query(
    "raw_event_rates",
    f"""SELECT {rnd("count(*) FILTER (WHERE event_type='DEFAULT')/count(*)::DOUBLE",
                   'default_rate')},
  {rnd("count(*) FILTER (WHERE event_type='PREPAYMENT')/count(*)::DOUBLE", 'prepayment_rate')},
  {rnd("count(*) FILTER (WHERE event_type='CENSOR')/count(*)::DOUBLE", 'censor_rate')} FROM model""",
)(
    lambda s: reads.raw_event_rates(projections.portfolio_summary(s.model, PROV)).select(
        "default_rate", "prepayment_rate", "censor_rate"
    )
)

query(
    "available_vintages",
    """SELECT DISTINCT vintage_year AS label, true AS in_range FROM raw_orig
WHERE vintage_year::INT BETWEEN 2016 AND 2026""",
)(
    lambda s: reads.available_vintages(
        s.raw_orig.select("vintage_year"),
        s.model.select(F.col("vintage_year").cast("double")),
    )
)

query(
    "peer_comparison",
    f"""SELECT m.loan_id, m.fico, m.fico_band, p.h AS horizon, {rnd('p.cif', 'band_default_cif')},
  p.nr AS band_n_at_risk FROM fico_banded m JOIN pd_band p ON p.gn='fico_band' AND p.gv=m.fico_band
WHERE m.fico IS NOT NULL AND p.st='ELIGIBLE'""",
)(lambda s: reads.peer_comparison(s.model, horizons.grouped_pd(s.model)))

# ---- samples, reconciliation -----------------------------------------------------------------

_RANKED = """(SELECT loan_id, event_type, substr(sha256(loan_id),1,16) AS hx,
  row_number() OVER (PARTITION BY event_type ORDER BY substr(sha256(loan_id),1,16), loan_id)-1 AS rk,
  count(*) OVER (PARTITION BY event_type) AS sz FROM model)"""


def _half(s: Study) -> int:
    return s.model.count() // 2


query(
    "nested_sample",
    f"""SELECT loan_id, event_type, rk AS stratum_rank, sz AS stratum_size FROM {_RANKED}
ORDER BY rk>0, CASE WHEN rk=0 THEN 0 ELSE rk/sz::DOUBLE END, CASE WHEN rk=0 THEN event_type ELSE hx END,
  event_type, loan_id LIMIT (SELECT count(*)//2 FROM model)""",
)(lambda s: sampling.nested_sample(s.model, _half(s)))

query(
    "enriched_sample",
    f"""SELECT loan_id, event_type, rk AS stratum_rank, sz AS stratum_size
FROM {_RANKED}, (SELECT count(*)//2-count(*) FILTER (WHERE event_type='DEFAULT') AS rem,
  count(*) FILTER (WHERE event_type='CENSOR') AS c,
  count(*) FILTER (WHERE event_type<>'DEFAULT') AS n FROM model) q
WHERE event_type='DEFAULT' OR (event_type='CENSOR' AND rk<(2*rem*c+n)//(2*n))
  OR (event_type='PREPAYMENT' AND rk<rem-(2*rem*c+n)//(2*n))""",
)(lambda s: sampling.enriched_sample(s.model, _half(s)))

query(
    "sampled_histories",
    f"""SELECT loan_id, count(*) AS reports FROM perf WHERE loan_id IN (
  SELECT loan_id FROM {_RANKED} ORDER BY rk>0, CASE WHEN rk=0 THEN 0 ELSE rk/sz::DOUBLE END,
  CASE WHEN rk=0 THEN event_type ELSE hx END, event_type, loan_id
  LIMIT (SELECT count(*)//2 FROM model)) GROUP BY loan_id""",
)(
    lambda s: sampling.complete_histories(s.perf, sampling.nested_sample(s.model, _half(s)))
    .groupBy("loan_id")
    .agg(F.count("*").alias("reports"))
)

query(
    "sample_metrics",
    f"""SELECT count(*) AS actual_loans, {count_if("event_type='DEFAULT'", 'default_count')},
  {count_if("event_type='PREPAYMENT'", 'prepayment_count')},
  {count_if("event_type='CENSOR'", 'censor_count')},
  {count_if('entry_time_month>0', 'delayed_entry_count')} FROM model""",
)(lambda s: sampling.sample_metrics(s.model))

query(
    "input_fingerprint",
    f"""SELECT 'analysis_loans' AS input, count(*) AS row_count,
  {count_if("event_type='DEFAULT'", 'default_count')},
  {count_if("event_type='PREPAYMENT'", 'prepayment_count')},
  {count_if("event_type='CENSOR'", 'censor_count')},
  {count_if('entry_time_month>0', 'delayed_entry_count')} FROM model
UNION ALL SELECT 'performance', count(*), NULL, NULL, NULL, NULL FROM perf""",
)(
    lambda s: release.fingerprint(s.model, "analysis_loans")
    .unionByName(release.fingerprint(s.perf, "performance"))
    .drop("content_hash")
)



def _hashes(s: Study) -> DataFrame:
    """Whether the content hash of an input stays the same for its rows in another order, and when
    one value changes."""
    parts = []
    for name, df, column in [("analysis_loans", s.model, "duration_months"), ("performance", s.perf, "loan_age")]:
        once = F.struct(F.col("loan_id"), F.col(column)) == df.select(F.max(F.struct("loan_id", column))).scalar()
        value = F.col(column)
        changed = df.withColumn(column, F.when(once, value + 1).otherwise(value).cast(df.schema[column].dataType))
        hashes = [
            release.fingerprint(t, name).select(F.col("content_hash").alias(f"h{i}"))
            for i, t in enumerate([df, df.repartition(7, "loan_id"), changed])
        ]
        parts.append(
            merge_rows(*hashes).select(
                F.lit(name).alias("input"),
                (F.col("h0") == F.col("h1")).alias("same_in_other_order"),
                (F.col("h0") == F.col("h2")).alias("same_when_changed"),
                F.col("h0").rlike("^-?[0-9]+$").alias("is_number"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


query(
    "input_content_hash",
    """SELECT unnest(['analysis_loans','performance']) AS input, true AS same_in_other_order,
  false AS same_when_changed, true AS is_number""",
)(_hashes)


def _release_cycle(s: Study) -> DataFrame:
    """A run built, checked, published and read again: rows of each of its tables."""
    root = f"{s.folder}/release"
    if release.run_status(s.spark, root, "r1") is None:
        release.build_release(s.model, s.perf, root, "r1")
        release.validate_release(s.spark, root, "r1", s.model)
        release.publish(s.spark, root, "r1")
    run = release.current_run(s.spark, root)
    status = release.run_status(s.spark, root, run)
    parts = [
        df.agg(F.count("*").alias("rows")).withColumn("table_name", F.lit(name))
        for name, df in release.current_tables(s.spark, root).items()
    ]
    return reduce(DataFrame.unionByName, parts).select(
        F.lit(run).alias("run_id"), F.lit(status).alias("status"), "table_name", "rows"
    )


_FITTED = {
    "cox_results": 5, "cox_diagnostics": 1, "ph_diagnostics": 10, "ph_global_diagnostics": 2,
    "cause_specific_default_results": 5, "cause_specific_default_diagnostics": 1,
    "cause_specific_prepayment_results": 5, "cause_specific_prepayment_diagnostics": 1,
    "fine_gray_default_results": 5, "fine_gray_default_diagnostics": 1, "time_varying_cox_results": 9,
    "time_varying_cox_diagnostics": 1,
}
_COUNTED = {
    "km_results": "km_all", "aalen_johansen_results": "curve_all", "overall_pd_horizons": "pd_overall",
    "vintage_cif_results": "curve_vintage", "vintage_horizon_results": "pd_vintage",
    "grouped_cif_results": "curve_band", "grouped_pd_horizons": "pd_band",
}
query(
    "release_cycle",
    "SELECT 'r1' AS run_id, 'PUBLISHED' AS status, table_name, rows FROM ("
    + " UNION ALL ".join(
        [f"SELECT '{t}' AS table_name, {n}::BIGINT AS rows" for t, n in _FITTED.items()]
        + [f"SELECT '{t}', count(*) FROM {view}" for t, view in _COUNTED.items()]
    )
    + ")",
)(_release_cycle)

query(
    "count_reconciliation",
    """SELECT table_name, horizon_rows, 0::BIGINT AS loan_mismatches,
  0::BIGINT AS default_mismatches, 0::BIGINT AS prepayment_mismatches
FROM (SELECT unnest(['portfolio','vintage_year','fico_band','ltv_band','dti_band']) AS table_name,
  4::BIGINT AS horizon_rows)""",
)(
    lambda s: release.count_reconciliation(
        s.model,
        horizons.overall_pd(s.model),
        horizons.vintage_horizons(s.model),
        horizons.grouped_pd(s.model),
    )
)

# ---- scoring ---------------------------------------------------------------------------------

# Fixed coefficients make the scoring formula itself checkable; fitted ones are scored below.
_BETA_D = [-0.002, 0.01, 0.005, 0.1, 0.0005]
_BETA_P = [0.001, -0.005, 0.002, -0.05, 0.0002]
_CENTER = [600.0, 70.0, 35.0, 5.0, 300.0]


def _occurrence_hazards(s: Study) -> scoring.Hazards:
    """Occurrence rates per month as the baseline of both causes."""
    table = aj.incidence_table(horizons.event_cells(s.model, F.col("cr_event_code")))
    # One row per month of the clock.
    rows = table.filter("defaults + prepays > 0").select("t", "h1", "h2").orderBy("t").collect()
    return scoring.Hazards(
        [r["t"] for r in rows], [r["h1"] for r in rows], [r["h2"] for r in rows],
        _BETA_D, _BETA_P, _CENTER,
    )


def _eta(beta: list[float]) -> str:
    return "+".join(
        f"({name}::DOUBLE-{c})*({b})" for name, b, c in zip(CORE_PREDICTORS, beta, _CENTER)
    )


_HORIZONS_SQL = "(SELECT unnest([12,24,36]) AS hz)"
_SCORED_SQL = f"""(SELECT loan_id, vintage_year, event_type, duration_months, hz,
  sum(s_before*-expm1x*share) AS dcif, sum(s_before*-expm1x*(1-share)) AS pcif, exp(-max(cum)) AS surv
FROM (SELECT *, exp(-(cum-tot)) AS s_before, exp(-tot)-1 AS expm1x,
    CASE WHEN tot>0 THEN d/tot ELSE 0 END AS share
  FROM (SELECT *, d+p AS tot, sum(d+p) OVER (PARTITION BY loan_id, hz ORDER BY t) AS cum
    FROM (SELECT m.loan_id, m.vintage_year, m.event_type, m.duration_months, z.hz, b.t,
        b.h1*m.ed AS d, b.h2*m.ep AS p
      FROM (SELECT *, exp({_eta(_BETA_D)}) AS ed, exp({_eta(_BETA_P)}) AS ep FROM complete) m,
        {_HORIZONS_SQL} z, haz_all b WHERE b.t<=z.hz AND b.d1+b.d2>0)))
GROUP BY ALL)"""


def _scored(s: Study, horizons: list[int] = scoring.FORECAST_HORIZONS) -> DataFrame:
    profiles = s.complete.select(
        "loan_id", "vintage_year", "event_type", "duration_months", *CORE_PREDICTORS
    )
    return scoring.score_horizons(profiles, _occurrence_hazards(s), horizons)


# Month 0 lies before the first step: nothing has happened yet.
query(
    "early_horizon_scores",
    f"""SELECT m.loan_id, z.hz AS horizon_months,
  {rnd('coalesce(dcif,0::DOUBLE)', 'default_cif')}, {rnd('coalesce(pcif,0::DOUBLE)', 'prepay_cif')},
  {rnd('coalesce(surv,1::DOUBLE)', 'survival')}
FROM complete m CROSS JOIN (SELECT unnest([0,1,2,12]) AS hz) z
LEFT JOIN {_SCORED_SQL.replace('[12,24,36]', '[0,1,2,12]')} x ON x.loan_id=m.loan_id AND x.hz=z.hz""",
)(
    lambda s: _scored(s, [0, 1, 2, 12]).select(
        "loan_id", "horizon_months", "default_cif", "prepay_cif", "survival"
    )
)


query(
    "profile_scores",
    f"""SELECT loan_id, hz AS horizon_months, {rnd('dcif', 'default_cif')},
  {rnd('pcif', 'prepay_cif')}, {rnd('surv', 'survival')} FROM {_SCORED_SQL}""",
)(
    lambda s: _scored(s).select(
        "loan_id", "horizon_months", "default_cif", "prepay_cif", "survival"
    )
)

query(
    "score_validation",
    f"""SELECT hz AS horizon_months, count(*) AS n_eligible, sum(yd)::BIGINT AS observed_defaults,
  sum(yp)::BIGINT AS observed_prepayments,
  {rnd('avg((dcif-yd)*(dcif-yd)+(pcif-yp)*(pcif-yp)+(surv-ys)*(surv-ys))', 'multiclass_brier')},
  {rnd('-avg(ln(CASE WHEN yd=1 THEN dcif WHEN yp=1 THEN pcif ELSE surv END))', 'log_loss')},
  {rnd('avg(dcif)', 'mean_predicted_default')}, {rnd('avg(yd)', 'mean_observed_default')},
  count(*)>=1000 AS enough_loans
FROM (SELECT *, 1-yd-yp AS ys FROM (SELECT *,
    (event_type='DEFAULT' AND duration_months<=hz)::INT AS yd,
    (event_type='PREPAYMENT' AND duration_months<=hz)::INT AS yp FROM {_SCORED_SQL}))
WHERE duration_months>=hz OR yd=1 OR yp=1 GROUP BY hz""",
)(lambda s: scoring.validation_metrics(_scored(s)))

query(
    "training_range_flags",
    f"""SELECT m.loan_id, {', '.join(
        f'coalesce(m.{c} NOT BETWEEN r.lo_{c} AND r.hi_{c},false) AS {c}_out_of_range'
        for c in CORE_PREDICTORS)}
FROM model m, (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in CORE_PREDICTORS)}
  FROM complete WHERE vintage_year<=2020) r""",
)(
    lambda s: scoring.range_flags(
        s.model, scoring.training_ranges(s.complete.filter("vintage_year <= 2020"))
    ).select("loan_id", *[f"{c}_out_of_range" for c in CORE_PREDICTORS])
)

def _labels_sql(h: str) -> str:
    """First overdue age, its and the prepayment's month, and the outcome by horizon `h`."""
    return f"""SELECT *,
  CASE WHEN dq IS NOT NULL AND dq<={h} AND (pp IS NULL OR dq<=pp) THEN 0
       WHEN pp IS NOT NULL AND pp<={h} AND (dq IS NULL OR pp<dq) THEN 1 ELSE 2 END AS target
FROM (SELECT *, CASE WHEN age BETWEEN 1 AND duration_months THEN age END AS dq,
    CASE WHEN event_type='PREPAYMENT' THEN duration_months END AS pp
  FROM (SELECT m.loan_id, m.vintage_year, m.duration_months, m.event_type,
      ({idx('f.fm')}-{dindex('m.first_payment_month')}+1)::INTEGER AS age
    FROM model m LEFT JOIN (SELECT loan_id, min(reporting_period_num) AS fm FROM perf
      WHERE delinquency_num>=1 GROUP BY 1) f USING (loan_id))), (VALUES (12),(24),(36),(60)) hz(h)
WHERE least(dq,pp)<={h} OR duration_months>={h}"""


def _overdue(s: Study) -> DataFrame:
    return outcomes.first_overdue_ages(s.model, s.perf, s.orig)


query(
    "overdue_labels",
    f"SELECT loan_id, age AS first_30dpd_age, target FROM ({_labels_sql('h')}) WHERE h=24",
)(lambda s: outcomes.horizon_labels(_overdue(s), 24).select("loan_id", "first_30dpd_age", "target"))

query(
    "outcome_class_counts",
    f"""SELECT h::INTEGER AS horizon_months, CASE WHEN vintage_year<=2022 THEN 'train' ELSE 'valid' END AS half,
  target, count(*) AS loans FROM ({_labels_sql('h')}) GROUP BY 1, 2, 3""",
)(lambda s: outcomes.class_counts(outcomes.labels_by_horizon(_overdue(s), outcomes.HORIZONS)))

# ---- regression models: iterative, checked against brute force in the tests --------------------

query(
    "tv_counts",
    """SELECT count(*) AS n_intervals, count(DISTINCT loan_id) AS n_loans,
  sum(default_event)::BIGINT AS n_events,
  (SELECT count(*) FILTER (WHERE a>0) FROM (SELECT min(start_time_month) AS a FROM intervals
    GROUP BY loan_id)) AS n_delayed_entry_loans,
  count(*) FILTER (WHERE gap_interval_flag) AS n_gap_intervals,
  max(interval_length_months) AS max_interval_length_months FROM intervals""",
)(lambda s: cox.time_varying_counts(s.intervals))

_TVSQL = {
    "lag_current_actual_upb": "current_actual_upb",
    "lag_current_interest_rate": "current_interest_rate",
    "lag_dq_1m": "(st='01')::INT",
    "lag_dq_2m": "(st='02')::INT",
}
query(
    "tv_predictor_support",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS predictor, 0::BIGINT AS null_count, 0::BIGINT AS nonfinite_count,
  round(stddev_samp({_TVSQL.get(c, c)}::DOUBLE),6) AS sample_standard_deviation,
  min({_TVSQL.get(c, c)}::DOUBLE) AS minimum, max({_TVSQL.get(c, c)}::DOUBLE) AS maximum,
  count(DISTINCT {_TVSQL.get(c, c)}) AS unique_value_count, true AS all_finite FROM intervals"""
        for c in TV_PREDICTORS
    ),
)(
    lambda s: cox.predictor_support(s.intervals).withColumn(
        "sample_standard_deviation", F.round("sample_standard_deviation", 6)
    )
)

query(
    "tv_binary_support",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS predictor, sum({_TVSQL[c]})::BIGINT AS positive_count_overall,
  coalesce(sum({_TVSQL[c]}) FILTER (WHERE terminal_interval_flag AND default_event=1),0)::BIGINT
    AS positive_count_default_terminal_intervals FROM intervals"""
        for c in TV_PREDICTORS[-2:]
    ),
)(lambda s: cox.binary_support(s.intervals))

query(
    "tv_interval_integrity",
    f"""SELECT count(*) AS row_count, {_zeros('negative_start_count', 'zero_width_count',
    'negative_width_count')}, count(*) AS unique_interval_key_count,
  count(*) FILTER (WHERE terminal_interval_flag AND default_event=1)
    AS terminal_default_event_count, 0::BIGINT AS duplicate_interval_key_count, 'PASS' AS status
FROM intervals""",
)(lambda s: cox.interval_integrity(s.intervals))

query(
    "cox_input_check",
    f"""SELECT count(*) AS rows, {count_if("event_type='DEFAULT'", 'events')},
  {count_if("event_type='PREPAYMENT'", 'prepayment_events')}, {_zeros('duplicate_loans',
    'missing_loan_id', 'invalid_event', 'invalid_time', 'incomplete_predictors',
    'invalid_prepayment')} FROM complete""",
)(lambda s: cox.check_paired_input(s.complete))

query(
    "fine_gray_input_check",
    f"""SELECT count(*) AS rows, {count_if("event_type='DEFAULT'", 'defaults')},
  {count_if("event_type='PREPAYMENT'", 'prepayments')}, {_zeros('duplicate_loans',
    'missing_loan_id', 'invalid_event', 'invalid_time', 'incomplete_predictors')} FROM complete""",
)(lambda s: fine_gray.check_fine_gray_input(s.complete))

def _outcome_metrics(s: Study) -> DataFrame:
    return outcomes.fit_outcome_models(_overdue(s))[1]


query("outcome_model_metrics")(_outcome_metrics)

from loanspan.plans import damaged, regressions  # noqa: E402, F401
