"""Audit tables: special values, variables, event conflicts, durations, sample flow.

Every table covers all vintages in one grouped pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.functions import months as M
from loanspan.functions.codes import true


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name)) == "")


def special_values(orig: DataFrame) -> DataFrame:
    """Code counts, and ranges without the codes, per vintage of the raw origination table."""
    aggs = [F.count("*").alias("loans"), F.count_if(F.col("fico") == "9999").alias("fico_9999")]
    for short, name in [("dti", "original_dti"), ("ltv", "original_ltv"), ("cltv", "original_cltv")]:
        known = F.col(name) != "999"
        value = F.when(known, _number(name))
        aggs += [
            F.count_if(F.col(name) == "999").alias(f"{short}_999"),
            F.min(value).alias(f"{short}_min_excluding_999"),
            F.max(value).alias(f"{short}_max_excluding_999"),
        ]
        if short != "dti":
            aggs.append(F.count_if(known & (_number(name) > 100)).alias(f"{short}_above_100"))
    score = F.when(F.col("vantagescore_4") != "9999", _number("vantagescore_4"))
    aggs += [
        F.count_if(F.col("vantagescore_4") == "9999").alias("vantagescore_9999"),
        F.min(score).alias("vantagescore_min"),
        F.max(score).alias("vantagescore_max"),
    ]
    return orig.groupBy("vintage_year").agg(*aggs)


def xx_by_age(perf: DataFrame) -> DataFrame:
    return (
        perf.filter(F.col("delinquency_status") == "XX")
        .groupBy("vintage_year", F.col("loan_age").try_cast("bigint").alias("loan_age_num"))
        .agg(F.count("*").alias("xx_rows"))
    )


def xx_by_period(perf: DataFrame) -> DataFrame:
    return (
        perf.filter(F.col("delinquency_status") == "XX")
        .groupBy("vintage_year", "monthly_reporting_period")
        .agg(F.count("*").alias("xx_rows"))
    )


def xx_zero_balance(perf: DataFrame) -> DataFrame:
    """XX rows with and without a termination code; every vintage has a row."""
    xx = F.col("delinquency_status") == "XX"
    code = F.col("zero_balance_code").isNotNull()
    return (
        perf.groupBy("vintage_year")
        .agg(
            F.count_if(xx).alias("xx_rows"),
            F.count_if(xx & code).alias("xx_with_zero_balance"),
            F.count_if(xx & ~code).alias("xx_without_zero_balance"),
        )
        .withColumn(
            "pct_xx_with_zero_balance",
            F.when(
                F.col("xx_rows") > 0,
                F.round(F.col("xx_with_zero_balance") / F.col("xx_rows") * 100, 2),
            ),
        )
    )


def origination_variables(orig: DataFrame) -> DataFrame:
    """Blank counts, codes, out-of-range scores and value ranges per vintage."""
    score = _number("fico")
    aggs = [
        F.count("*").alias("loans"),
        F.count_if(_blank("fico")).alias("fico_blank"),
        F.count_if(F.col("fico") == "9999").alias("fico_9999"),
        F.count_if(score.isNotNull() & ~score.between(300, 850)).alias("fico_outside_300_850"),
        F.count_if(F.col("original_dti") == "999").alias("original_dti_999"),
    ]
    ranged = {
        "original_ltv": "original_ltv",
        "original_cltv": "original_cltv",
        "original_dti": "original_dti",
        "interest_rate": "original_interest_rate",
        "original_upb": "original_upb",
        "loan_term": "original_loan_term",
    }
    for label, name in ranged.items():
        aggs += [
            F.count_if(_blank(name)).alias(f"{label}_blank"),
            F.min(_number(name)).alias(f"{label}_min"),
            F.max(_number(name)).alias(f"{label}_max"),
        ]
    for label, name in {
        "first_payment_date": "first_payment_date",
        "maturity_date": "maturity_date",
        "vantagescore": "vantagescore_4",
    }.items():
        aggs.append(F.count_if(_blank(name)).alias(f"{label}_blank"))
    return orig.groupBy("vintage_year").agg(*aggs)


def performance_variables(perf: DataFrame) -> DataFrame:
    status = F.col("delinquency_status")
    aggs = [
        F.count("*").alias("reports"),
        F.count_if(_blank("delinquency_status")).alias("delinquency_blank"),
        F.count_if(status == "RA").alias("delinquency_ra"),
        F.count_if(status == "XX").alias("delinquency_xx"),
        F.count_if(_blank("monthly_reporting_period")).alias("reporting_period_blank"),
        F.count_if(_blank("zero_balance_code")).alias("zero_balance_blank"),
        F.count_if(_blank("estimated_ltv")).alias("estimated_ltv_blank"),
        F.count_if(F.col("estimated_ltv") == "999").alias("estimated_ltv_999"),
        F.count_if(_blank("ddlpi")).alias("ddlpi_blank"),
    ]
    for label, name in {
        "loan_age": "loan_age",
        "current_upb": "current_actual_upb",
        "current_rate": "current_interest_rate",
    }.items():
        aggs += [
            F.count_if(_blank(name)).alias(f"{label}_blank"),
            F.min(_number(name)).alias(f"{label}_min"),
            F.max(_number(name)).alias(f"{label}_max"),
        ]
    return perf.groupBy("vintage_year").agg(*aggs)


def delinquency_distribution(perf: DataFrame) -> DataFrame:
    return perf.groupBy("vintage_year", "delinquency_status").agg(
        F.count("*").alias("status_rows")
    )


def zero_balance_month() -> Column:
    """Effective month of a termination, else its reporting month."""
    return F.coalesce(
        F.col("zero_balance_effective_date").try_cast("int"), F.col("reporting_period_num")
    )


def zero_balance_codes(perf: DataFrame) -> DataFrame:
    """Rows and loans per vintage and termination code."""
    return (
        perf.filter(F.col("zero_balance_code").isNotNull())
        .groupBy("vintage_year", "zero_balance_code")
        .agg(F.count("*").alias("code_rows"), F.count_distinct("loan_id").alias("loans"))
    )


def zero_balance_dates(perf: DataFrame) -> DataFrame:
    """Terminations with missing effective dates or dates other than their report."""
    text = F.col("zero_balance_effective_date")
    return (
        perf.filter(F.col("zero_balance_code").isNotNull())
        .groupBy("vintage_year")
        .agg(
            F.count("*").alias("zb_rows"),
            F.count_if(text.isNull()).alias("zb_effective_date_missing"),
            F.count_if(text.try_cast("int") != F.col("reporting_period_num")).alias(
                "zb_reporting_month_mismatch"
            ),
        )
    )


def classify_payoffs(orig: DataFrame, perf: DataFrame) -> DataFrame:
    """Each code-01 termination as prepaid, matured or ambiguous."""
    remaining = F.col("remaining_months_maturity")
    effective, maturity = F.col("zero_balance_effective_month"), F.col("maturity_month")
    rows = perf.filter(F.col("zero_balance_code") == "01").select(
        "loan_id",
        "vintage_year",
        zero_balance_month().alias("zb_event_month"),
        "zero_balance_effective_month",
        "remaining_months_maturity",
    )
    return rows.join(orig.select("loan_id", "maturity_month"), "loan_id", "left").select(
        "loan_id",
        "vintage_year",
        "zb_event_month",
        F.when(remaining > 0, "PREPAY_REMAINING_MATURITY")
        .when(remaining <= 0, "MATURED_REMAINING_MATURITY")
        .when(effective < maturity, "PREPAY_FALLBACK_MATURITY_DATE")
        .when(effective >= maturity, "MATURED_FALLBACK_MATURITY_DATE")
        .otherwise("AMBIGUOUS")
        .alias("zb01_classification"),
    )


def payoff_summary(payoffs: DataFrame) -> DataFrame:
    return payoffs.groupBy("vintage_year", "zb01_classification").agg(
        F.count("*").alias("payoff_rows"), F.count_distinct("loan_id").alias("loans")
    )


def loan_candidates(orig: DataFrame, perf: DataFrame) -> DataFrame:
    """First month of every kind of event evidence per loan, and how default and prepayment relate.

    One aggregate over the monthly rows. A payoff without remaining months is classified by the
    loan's maturity, which the reports do not hold: the months of those payoffs, one for each calendar
    month at most, wait in a set until the loan's row meets its origination.
    """
    month, code = F.col("reporting_period_num"), F.col("zero_balance_code")
    remaining, event_month = F.col("remaining_months_maturity"), zero_balance_month()
    payoff, dated = code == "01", F.col("zero_balance_effective_month").isNotNull()

    def first(cond, value):
        return F.min(F.when(cond, value))

    evidence = perf.groupBy("loan_id", "vintage_year").agg(
        first(F.col("delinquency_num") >= 3, month).alias("first_d90_month"),
        first(F.col("is_ra"), month).alias("first_ra_month"),
        first(code.isin("02", "03", "09"), event_month).alias("first_credit_zb_month"),
        first(code.isin("15", "16", "96"), event_month).alias("first_admin_termination_month"),
        F.max(month).alias("last_observed_month"),
        first(payoff & (remaining > 0), event_month).alias("_prepaid"),
        first(payoff & (remaining <= 0), event_month).alias("_matured"),
        first(payoff & remaining.isNull() & ~dated, event_month).alias("_undated"),
        F.collect_set(F.when(payoff & remaining.isNull() & dated, event_month)).alias("_open"),
    )
    maturity = F.col("_maturity")

    def first_open(keep):
        return F.array_min(F.filter("_open", lambda m: F.coalesce(keep(m), F.lit(False))))

    payoffs = {
        "first_prepay_month": F.least("_prepaid", first_open(lambda m: m < maturity)),
        "first_maturity_month": F.least("_matured", first_open(lambda m: m >= maturity)),
        "first_zb01_ambiguous_month": F.least("_undated", first_open(lambda m: maturity.isNull())),
    }
    matures = orig.select("loan_id", M.date_to_yyyymm(F.col("maturity_month")).alias("_maturity"))
    found = evidence.join(matures, "loan_id", "left").withColumns(payoffs)
    found = found.drop("_prepaid", "_matured", "_undated", "_open", "_maturity")
    default = F.least("first_d90_month", "first_ra_month", "first_credit_zb_month")
    prepay = F.col("first_prepay_month")
    evidence_month = F.col("first_default_evidence_month")
    return (
        found.withColumn("first_default_evidence_month", default)
        .withColumn(
            "default_prepay_relation",
            F.when(evidence_month < prepay, "DEFAULT_BEFORE_PREPAY")
            .when(evidence_month == prepay, "DEFAULT_AND_PREPAY_SAME_MONTH")
            .when(prepay < evidence_month, "PREPAY_BEFORE_DEFAULT")
            .otherwise("NO_DEFAULT_PREPAY_CONFLICT"),
        )
    )


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Loans per kind of evidence and vintage."""

    def has(name):
        return F.col(name).isNotNull()

    nothing = ~(
        has("first_default_evidence_month")
        | has("first_prepay_month")
        | has("first_maturity_month")
        | has("first_zb01_ambiguous_month")
        | has("first_admin_termination_month")
    )
    return candidates.groupBy("vintage_year").agg(
        F.count("*").alias("perf_loans"),
        F.count_if(has("first_d90_month")).alias("d90_loans"),
        F.count_if(has("first_ra_month")).alias("ra_loans"),
        F.count_if(has("first_credit_zb_month")).alias("credit_zb_02_03_09_loans"),
        F.count_if(has("first_default_evidence_month")).alias("any_default_evidence_loans"),
        F.count_if(has("first_prepay_month")).alias("prepay_candidate_loans"),
        F.count_if(has("first_maturity_month")).alias("maturity_candidate_loans"),
        F.count_if(has("first_zb01_ambiguous_month")).alias("zb01_ambiguous_loans"),
        F.count_if(has("first_admin_termination_month")).alias("admin_termination_loans"),
        F.count_if(nothing).alias("no_candidate_event_loans"),
    )


def conflict_summary(candidates: DataFrame) -> DataFrame:
    """Overlaps between kinds of evidence per vintage."""
    d90, ra, zb = (
        F.col("first_d90_month"), F.col("first_ra_month"), F.col("first_credit_zb_month")
    )
    relation = F.col("default_prepay_relation")
    return candidates.groupBy("vintage_year").agg(
        F.count_if(d90.isNotNull() & ra.isNotNull()).alias("d90_and_ra"),
        F.count_if(d90.isNotNull() & zb.isNotNull()).alias("d90_and_credit_zb"),
        F.count_if(ra.isNotNull() & zb.isNotNull()).alias("ra_and_credit_zb"),
        F.count_if(d90 == ra).alias("d90_ra_same_month"),
        F.count_if(d90 == zb).alias("d90_credit_same_month"),
        F.count_if(ra == zb).alias("ra_credit_same_month"),
        F.count_if(relation != "NO_DEFAULT_PREPAY_CONFLICT").alias("default_and_prepay_both"),
        F.count_if(relation == "DEFAULT_BEFORE_PREPAY").alias("default_before_prepay"),
        F.count_if(relation == "DEFAULT_AND_PREPAY_SAME_MONTH").alias(
            "default_and_prepay_same_month"
        ),
        F.count_if(relation == "PREPAY_BEFORE_DEFAULT").alias("prepay_before_default"),
    )


def conflict_loans(candidates: DataFrame) -> DataFrame:
    return candidates.filter(
        F.col("default_prepay_relation") != "NO_DEFAULT_PREPAY_CONFLICT"
    ).select(
        "vintage_year",
        "loan_id",
        "first_d90_month",
        "first_ra_month",
        "first_credit_zb_month",
        "first_default_evidence_month",
        "first_prepay_month",
        "first_maturity_month",
        "first_admin_termination_month",
        "last_observed_month",
        "default_prepay_relation",
    )


def _with_duration(events: DataFrame) -> DataFrame:
    origin = M.date_month_index(F.add_months("first_payment_month", -1))
    return events.withColumns(
        {
            "event_index": M.month_index(F.col("event_month")),
            "duration_months": M.month_index(F.col("event_month")) - origin,
        }
    )


def duration_audit(events: DataFrame) -> DataFrame:
    """Duration ranges and edge cases of the event map per vintage.

    The exact median runs over a map of distinct durations, bounded by the number of months.
    """
    d = F.col("duration_months")
    payment = M.date_month_index(F.col("first_payment_month"))
    kinds = {"default": "DEFAULT", "prepay": "PREPAYMENT", "censor": "CENSOR"}
    return (
        _with_duration(events)
        .groupBy("vintage_year")
        .agg(
            F.count("*").alias("loans"),
            F.count_if(d < 0).alias("negative_duration"),
            F.count_if(d == 0).alias("zero_duration"),
            F.count_if(d == 1).alias("duration_one"),
            F.min(d).alias("min_duration"),
            F.max(d).alias("max_duration"),
            F.median(d).alias("median_duration"),
            *[
                F.count_if((d <= 0) & (F.col("event_type") == kind)).alias(f"nonpositive_{name}")
                for name, kind in kinds.items()
            ],
            F.count_if(F.col("event_index") < payment).alias("event_before_first_payment"),
            F.count_if(F.col("event_index") == payment).alias("event_at_first_payment"),
            F.count_if(F.col("event_month") > F.col("last_observed_month")).alias(
                "event_after_last_report"
            ),
        )
    )


def _aged(perf: DataFrame, events: DataFrame) -> DataFrame:
    origins = events.select("loan_id", "first_payment_month")
    origin = M.date_month_index(F.add_months("first_payment_month", -1))
    age = M.month_index(F.col("reporting_period_num")) - origin
    return perf.join(origins, "loan_id").withColumns(
        {
            "analysis_age_months": age.cast("int"),
            "age_difference": (F.col("loan_age").cast("int") - age).cast("int"),
        }
    )


def age_audit(perf: DataFrame, events: DataFrame) -> DataFrame:
    """Monthly analysis ages against reported ages per vintage."""
    age, modified = F.col("analysis_age_months"), F.col("modification_flag").isNotNull()
    return (
        _aged(perf, events)
        .groupBy("vintage_year")
        .agg(
            F.count("*").alias("performance_rows"),
            F.count_if(age < 0).alias("negative_analysis_age_rows"),
            F.count_if(age == 0).alias("age_zero_rows"),
            F.min(age).alias("min_analysis_age"),
            F.max(age).alias("max_analysis_age"),
            F.count_if(~modified & (F.col("age_difference") != 0)).alias(
                "unmodified_age_mismatch_rows"
            ),
            F.count_if(modified).alias("modified_rows"),
            F.count_distinct(F.when(modified, F.col("loan_id"))).alias("modified_loans"),
        )
    )


def negative_durations(events: DataFrame) -> DataFrame:
    """Listing of loans whose event precedes their origin."""
    return (
        _with_duration(events)
        .filter(F.col("duration_months") < 0)
        .select(
            "vintage_year",
            "loan_id",
            "first_payment_month",
            "event_type",
            "event_source",
            "event_month",
            "duration_months",
            "last_observed_month",
            "raw_zero_balance_code",
        )
    )


def nonpositive_durations(events: DataFrame) -> DataFrame:
    return (
        _with_duration(events)
        .filter(F.col("duration_months") <= 0)
        .groupBy("vintage_year", "event_type", "event_source", "duration_months")
        .agg(F.count("*").alias("loans"))
    )


def _mismatches(perf: DataFrame, events: DataFrame) -> DataFrame:
    return _aged(perf, events).filter(
        F.col("modification_flag").isNull() & true(F.col("age_difference") != 0)
    )


def age_mismatch_distribution(perf: DataFrame, events: DataFrame) -> DataFrame:
    return (
        _mismatches(perf, events)
        .groupBy("vintage_year", "age_difference")
        .agg(F.count("*").alias("mismatch_rows"), F.count_distinct("loan_id").alias("loans"))
    )


def age_mismatch_totals(perf: DataFrame, events: DataFrame) -> DataFrame:
    """The distribution over all vintages; loans are summed per vintage."""
    return (
        age_mismatch_distribution(perf, events)
        .groupBy("age_difference")
        .agg(
            F.sum("mismatch_rows").alias("mismatch_rows"), F.sum("loans").alias("year_loan_counts")
        )
    )


def age_mismatch_loans(perf: DataFrame, events: DataFrame) -> DataFrame:
    """First and last mismatching report and the range of differences per loan."""
    return (
        _mismatches(perf, events)
        .groupBy("vintage_year", "loan_id")
        .agg(
            F.min("first_payment_month").alias("first_payment_month"),
            F.min("reporting_period_num").alias("first_mismatch_period"),
            F.max("reporting_period_num").alias("last_mismatch_period"),
            F.min("age_difference").alias("min_age_difference"),
            F.max("age_difference").alias("max_age_difference"),
            F.count("*").alias("mismatch_rows"),
        )
    )


def sample_flow(orig: DataFrame, survival: DataFrame, model: DataFrame) -> DataFrame:
    """From originated to complete-case loans per vintage, in long format.

    Steps: originated, without event record, excluded by reason, analysed by event and completeness.
    """
    def step(df, name, detail):
        return df.groupBy("vintage_year", detail.alias("detail")).agg(
            F.count("*").alias("loans")
        ).withColumn("step", F.lit(name))

    blank = F.lit("ALL")
    tag = F.col("vintage_year").cast("int")
    origination = orig.select("loan_id", tag.alias("vintage_year"))
    survivors = survival.select(
        "loan_id", tag.alias("vintage_year"), "survival_eligible", "survival_exclusion_reason"
    )
    analysed = model.select(
        tag.alias("vintage_year"), "core_covariates_complete_flag", "event_type"
    )
    complete = F.when(F.col("core_covariates_complete_flag"), "COMPLETE").otherwise("INCOMPLETE")
    parts = [
        step(origination, "ORIGINATED", blank),
        step(origination.join(survivors.select("loan_id"), "loan_id", "left_anti"),
             "WITHOUT_EVENT_RECORD", blank),
        step(survivors.filter(~true(F.col("survival_eligible"))), "TIME_EXCLUDED",
             F.col("survival_exclusion_reason")),
        step(analysed, "ANALYSED", F.concat_ws("_", complete, F.col("event_type"))),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.select("vintage_year", "step", "detail", "loans")


def event_summary(events: DataFrame) -> DataFrame:
    """Events per vintage."""
    kind = F.col("event_type")
    return events.groupBy("vintage_year").agg(
        F.count("*").alias("loans"),
        F.count_if(kind == "DEFAULT").alias("default_loans"),
        F.count_if(kind == "PREPAYMENT").alias("prepayment_loans"),
        F.count_if(kind == "CENSOR").alias("censored_loans"),
        F.count_if("same_month_default_prepay_flag").alias("same_month_conflicts"),
        F.count_if("event_after_last_report_flag").alias("events_after_last_report"),
    )


def survival_summary(survival: DataFrame) -> DataFrame:
    """Eligible and excluded loans per vintage."""
    eligible, kind = F.col("survival_eligible"), F.col("event_type")
    return survival.groupBy("vintage_year").agg(
        F.count("*").alias("loans"),
        F.count_if(eligible).alias("eligible"),
        F.count_if(~eligible).alias("excluded"),
        F.count_if(eligible & (kind == "DEFAULT")).alias("eligible_default"),
        F.count_if(eligible & (kind == "PREPAYMENT")).alias("eligible_prepayment"),
        F.count_if(eligible & (kind == "CENSOR")).alias("eligible_censor"),
    )


def model_summary(model: DataFrame) -> DataFrame:
    """Analysed and complete-case loans per vintage."""
    kind = F.col("event_type")
    return model.groupBy("vintage_year").agg(
        F.count("*").alias("loans"),
        F.count_if("core_covariates_complete_flag").alias("complete_cases"),
        F.count_if(kind == "DEFAULT").alias("default_loans"),
        F.count_if(kind == "PREPAYMENT").alias("prepayment_loans"),
        F.count_if(kind == "CENSOR").alias("censored_loans"),
    )
