"""Structural validation of the raw and cleaned tables, one pass per table for all vintages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanspan.contracts import CUTOFF, CUTOFF_DATE, ContractError, merge_rows, require_columns
from loanspan.functions import months as M
from loanspan.functions.codes import any_of, true


def table_size(df: DataFrame, key: str = "loan_id") -> DataFrame:
    return df.agg(
        F.count("*").alias("table_rows"), F.count_distinct(key).alias("unique_loans")
    )


def observation_range(perf: DataFrame) -> DataFrame:
    """First and last reporting period and loan age of a raw performance table."""
    age = F.col("loan_age").try_cast("bigint")
    return perf.agg(
        F.min("monthly_reporting_period").alias("first_period"),
        F.max("monthly_reporting_period").alias("last_period"),
        F.min(age).alias("min_loan_age"),
        F.max(age).alias("max_loan_age"),
    )


def ids_missing_from(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """Number of distinct loan ids of `left` absent from `right`.

    Both sides are reduced to their ids before the join, on the map side first.
    """
    ids = left.select("loan_id").distinct()
    return ids.join(right.select("loan_id").distinct(), "loan_id", "left_anti").agg(
        F.count("loan_id").alias(name)
    )


def loans_without_performance(orig: DataFrame, perf: DataFrame) -> DataFrame:
    """Listing of originated loans that never report."""
    return orig.join(perf.select("loan_id").distinct(), "loan_id", "left_anti").select(
        "loan_id",
        "first_payment_date",
        "maturity_date",
        "fico",
        "original_ltv",
        "original_dti",
        "original_upb",
        "original_interest_rate",
        "original_loan_term",
        "vintage_year",
    )


def missing_performance_split(orig: DataFrame, perf: DataFrame) -> DataFrame:
    """Loans without performance by first payment relative to the last reporting period."""
    last = perf.agg(F.max(F.col("monthly_reporting_period").try_cast("int")).alias("last_period"))
    first = F.col("first_payment_date").try_cast("int")
    silent = loans_without_performance(orig, perf).withColumn("first_payment", first)
    # The cutoff is one value: carry it in as a scalar subquery, not a join.
    cutoff = last.scalar()
    return silent.agg(
        F.count("*").alias("orig_missing_in_perf"),
        F.count_if(F.col("first_payment").isNull()).alias("invalid_first_payment"),
        F.count_if(F.col("first_payment") < cutoff).alias("first_payment_before_cutoff"),
        F.count_if(F.col("first_payment") >= cutoff).alias("first_payment_at_or_after_cutoff"),
    )


def vintage_tags(df: DataFrame) -> DataFrame:
    """Distinct vintage tags with their row counts."""
    return df.groupBy("vintage_year").agg(F.count("*").alias("tag_rows"))


def vintage_consistency(orig: DataFrame, perf: DataFrame) -> DataFrame:
    """Loans whose tag differs between tables or within one."""
    tags = orig.select("loan_id", F.col("vintage_year").alias("tag")).unionByName(
        perf.select("loan_id", F.col("vintage_year").alias("tag"))
    )
    return (
        tags.groupBy("loan_id")
        .agg(F.min("tag").alias("lo"), F.max("tag").alias("hi"))
        .agg(F.count_if(F.col("lo") != F.col("hi")).alias("inconsistent_loans"))
    )


def special_status_counts(perf: DataFrame) -> DataFrame:
    status = F.col("delinquency_status")
    return perf.agg(
        F.count_if(status == "RA").alias("ra_rows"), F.count_if(status == "XX").alias("xx_rows")
    )


def zero_balance_distribution(perf: DataFrame, by: list[str] | None = None) -> DataFrame:
    return (
        perf.filter(F.col("zero_balance_code").isNotNull())
        .groupBy(*(by or []), "zero_balance_code")
        .agg(F.count("*").alias("code_rows"))
    )


def duplicate_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number of key values that occur more than once."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("copies"))
        .agg(F.count_if(F.col("copies") > 1).alias(name))
    )


def period_problems(perf: DataFrame, period: Column, cutoff: int = CUTOFF) -> DataFrame:
    """Reporting periods that are no month, and rows after the cutoff."""
    return perf.agg(*_period_counts(period, cutoff))


def _period_counts(period: Column, cutoff: int) -> list[Column]:
    month = period % 100
    return [
        F.count_if(period.isNull() | (month < 1) | (month > 12)).alias("invalid_period"),
        F.count_if(period > cutoff).alias("after_cutoff"),
    ]


ORDER_CHUNK = 1 << 20


def order_violations(
    rows: DataFrame, period: str, source_row: str = "source_row", chunk: int = ORDER_CHUNK
) -> DataFrame:
    """Rows whose period is before the previous row of the same loan, in file order.

    A loan's rows are compared inside chunks of the file; the first row of a chunk is compared with
    the last row of the loan's previous chunk. So a loan that fills a third of the file is spread
    over many tasks.
    """
    p = F.col(period)
    placed = rows.select(
        "loan_id", p.alias("p"), F.col(source_row).alias("r"),
        F.floor(F.col(source_row) / F.lit(chunk)).alias("c"),
    )
    inside = Window.partitionBy("loan_id", "c").orderBy("r")
    within = placed.withColumn("previous", F.lag("p").over(inside)).agg(
        F.count_if(F.col("p") < F.col("previous")).alias("inside")
    )
    ends = placed.groupBy("loan_id", "c").agg(
        F.min_by("p", "r").alias("first_p"), F.max_by("p", "r").alias("last_p")
    )
    across = ends.withColumn(
        "previous", F.lag("last_p").over(Window.partitionBy("loan_id").orderBy("c"))
    ).agg(F.count_if(F.col("first_p") < F.col("previous")).alias("across"))
    return merge_rows(within, across).select(
        (F.col("inside") + F.col("across")).alias("order_violations")
    )


def _file_pieces(keys: list[str]):
    """mapInPandas body: each stretch of a file's rows with its first and last key and disorder."""
    import pandas as pd

    def descents(frame) -> int:
        before, after = frame[keys].shift(1).iloc[1:], frame[keys].iloc[1:]
        lower, equal = np.zeros(len(after), bool), np.ones(len(after), bool)
        for k in keys:
            a, b = before[k].to_numpy(), after[k].to_numpy()
            lower |= equal & (b < a)
            equal &= a == b
        return int(lower.sum())

    def run(batches):
        for batch in batches:
            for file, frame in batch.groupby("file", sort=False):
                ends = frame.iloc[[0, -1]]
                row = {"file": [file], "start": [ends["row"].iloc[0]], "rows": [len(frame)]}
                row["inside"] = [descents(frame)]
                for k in keys:
                    row[f"first_{k}"], row[f"last_{k}"] = [ends[k].iloc[0]], [ends[k].iloc[1]]
                yield pd.DataFrame(row)

    return run


def stored_order(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Rows of a stored Parquet table and how many come before their predecessor by `keys`.

    Rows stand in order of file name and place in the file. Every Arrow batch of a scan is compared
    in place and reports its first and last key; batches are compared along each file, files along
    the table, so no row is sorted or exchanged. Rows with a NULL key are left out: the key check
    counts them.
    """
    stored = spark.read.parquet(path)
    table = stored.select(
        *keys, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    ).dropna(subset=keys)
    kinds = {k: stored.schema[k].dataType.simpleString() for k in keys}
    edges = ", ".join(f"first_{k} {kind}, last_{k} {kind}" for k, kind in kinds.items())
    pieces = table.mapInPandas(
        _file_pieces(keys), f"file string, start bigint, rows bigint, inside bigint, {edges}"
    )
    first, last = (F.struct(*[F.col(f"{end}_{k}").alias(k) for k in keys]) for end in ("first", "last"))
    ordered = pieces.select("file", "start", "rows", "inside", first.alias("first"), last.alias("last"))
    along = Window.partitionBy("file").orderBy("start")
    files = (
        ordered.withColumn("before", F.lag("last").over(along))
        .groupBy("file")
        .agg(
            F.sum("rows").alias("rows"),
            (F.sum("inside") + F.count_if(F.col("first") < F.col("before"))).alias("inside"),
            F.min_by("first", "start").alias("first"),
            F.max_by("last", "start").alias("last"),
        )
    )
    # One row for each file.
    across = files.withColumn("before", F.lag("last").over(Window.orderBy("file")))
    return across.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("table_rows"),
        (F.coalesce(F.sum("inside"), F.lit(0)) + F.count_if(F.col("first") < F.col("before"))).alias(
            "order_violations"
        ),
    )


def reporting_gaps(perf: DataFrame, period: str = "reporting_period_num") -> DataFrame:
    """Loans with missing months between their first and last report, and how many months."""
    p = F.col(period)
    index = M.month_index(p)
    per_loan = (
        perf.filter(true((p % 100).between(1, 12)))
        .groupBy("loan_id")
        .agg(
            (F.max(index) - F.min(index) + 1 - F.count_distinct(index)).alias("missing_months")
        )
    )
    return per_loan.agg(
        F.count_if(F.col("missing_months") > 0).alias("loans_with_gaps"),
        F.coalesce(F.sum("missing_months"), F.lit(0)).alias("missing_months"),
    )


def date_sanity(orig: DataFrame) -> DataFrame:
    return orig.agg(*_date_counts())


def _date_counts() -> list[Column]:
    first, maturity = F.col("first_payment_month"), F.col("maturity_month")
    return [
        F.count_if(first.isNull()).alias("invalid_first_payment"),
        F.count_if(maturity.isNull()).alias("invalid_maturity"),
        F.count_if(maturity < first).alias("maturity_before_first_payment"),
    ]


def negative_ages(perf: DataFrame) -> DataFrame:
    return perf.agg(_negative_age_count())


def _negative_age_count() -> Column:
    return F.count_if(F.col("loan_age") < 0).alias("negative_loan_age")


def origination_rule_violations(clean: DataFrame) -> DataFrame:
    """Special codes that are still values after cleaning."""
    return clean.agg(*_origination_rule_counts())


def _origination_rule_counts() -> list[Column]:
    def bad(raw, code, value):
        return F.count_if((F.col(raw) == code) & F.col(value).isNotNull())

    legacy = F.col("legacy_number_borrowers_encoding_flag") & (
        F.col("number_borrowers_raw") == "2"
    )
    return [
        bad("fico_raw", "9999", "fico").alias("fico_bad"),
        bad("original_dti_raw", "999", "original_dti").alias("dti_bad"),
        bad("original_ltv_raw", "999", "original_ltv").alias("ltv_bad"),
        bad("original_cltv_raw", "999", "original_cltv").alias("cltv_bad"),
        F.count_if(legacy & F.col("number_borrowers").isNotNull()).alias("borrower_legacy_bad"),
    ]


def performance_rule_violations(clean: DataFrame) -> DataFrame:
    return clean.agg(*_performance_rule_counts())


def _performance_rule_counts() -> list[Column]:
    raw, number = F.col("delinquency_status_raw"), F.col("delinquency_num")
    return [
        F.count_if((raw == "XX") & number.isNotNull()).alias("xx_bad"),
        F.count_if((raw == "RA") & number.isNotNull()).alias("ra_bad"),
        F.count_if(
            (F.col("estimated_ltv_raw") == "999") & F.col("estimated_ltv").isNotNull()
        ).alias("eltv_bad"),
        F.count_if(raw.isNotNull() & ~raw.isin("XX", "RA") & number.isNull()).alias(
            "delinquency_parse_bad"
        ),
    ]


def clean_reconciliation(
    raw_orig: DataFrame, raw_perf: DataFrame, orig: DataFrame, perf: DataFrame
) -> DataFrame:
    """Row counts before and after cleaning, and code counts against flag counts."""
    pairs = {
        "fico": ("fico_raw", "9999", "fico_not_available_flag"),
        "dti": ("original_dti_raw", "999", "dti_not_available_flag"),
        "ltv": ("original_ltv_raw", "999", "ltv_not_available_flag"),
        "cltv": ("original_cltv_raw", "999", "cltv_not_available_flag"),
        "borrowers": ("number_borrowers_raw", "99", "number_borrowers_not_available_flag"),
    }
    legacy = F.col("legacy_number_borrowers_encoding_flag") & (
        F.col("number_borrowers_raw") == "2"
    )
    cleaned = orig.agg(
        F.count("*").alias("orig_rows"),
        *[F.count_if(F.col(raw) == code).alias(f"{n}_codes") for n, (raw, code, _) in pairs.items()],
        *[F.count_if(flag).alias(f"{n}_flags") for n, (_, _, flag) in pairs.items()],
        F.count_if(legacy).alias("legacy_multiple_borrower_rows"),
        F.count_if(legacy & F.col("number_borrowers").isNotNull()).alias("legacy_exact_counts"),
    )
    monthly = perf.agg(
        F.count("*").alias("perf_rows"),
        F.count_if(F.col("delinquency_status_raw") == "XX").alias("xx_codes"),
        F.count_if("is_xx").alias("xx_flags"),
        F.count_if(F.col("delinquency_status_raw") == "RA").alias("ra_codes"),
        F.count_if("is_ra").alias("ra_flags"),
        F.count_if(F.col("estimated_ltv_raw") == "999").alias("eltv_codes"),
        F.count_if("estimated_ltv_not_available_flag").alias("eltv_flags"),
    )
    raw = merge_rows(
        raw_orig.agg(F.count("*").alias("raw_orig_rows")),
        raw_perf.agg(F.count("*").alias("raw_perf_rows")),
    )
    names = [*pairs, "xx", "ra", "eltv"]
    mismatch = any_of(
        [F.col(f"{n}_codes") != F.col(f"{n}_flags") for n in names]
        + [
            F.col("raw_orig_rows") != F.col("orig_rows"),
            F.col("raw_perf_rows") != F.col("perf_rows"),
            F.col("legacy_exact_counts") != 0,
        ]
    )
    return merge_rows(cleaned, monthly, raw).withColumn(
        "status", F.when(mismatch, "FAIL").otherwise("PASS")
    )


def key_check(df: DataFrame, keys: list[str], parent: DataFrame | None = None) -> DataFrame:
    """Rows, NULL and repeated keys, NULLs per column, review-flag sums, orphans, late months."""
    require_columns(df, keys, "Standardized table")
    flags = [c for c in df.columns if c.startswith("qc_")]
    stats = df.agg(
        F.count("*").alias("table_rows"),
        F.count_if(any_of(F.col(k).isNull() for k in keys)).alias("missing_keys"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns if c not in flags],
        *[F.count_if(c).alias(f"flag_{c}") for c in flags],
    )
    frames = [stats, duplicate_keys(df, keys, "repeated_keys")]
    if parent is not None:
        frames.append(ids_missing_from(df, parent, "orphan_loans"))
        frames.append(
            df.agg(
                F.count_if(F.col("performance_month") > F.lit(CUTOFF_DATE).cast("date")).alias(
                    "months_after_cutoff"
                )
            )
        )
    return merge_rows(*frames)


def decide(failed: Column, warned: Column) -> Column:
    return F.when(true(failed), "FAIL").when(true(warned), "PASS_WITH_WARNING").otherwise("PASS")


def _id_checks(raw_orig: DataFrame, raw_perf: DataFrame, period: Column) -> DataFrame:
    """Row counts, repeated keys, ids on one side only, and reporting gaps of the raw tables."""
    index = F.when(true((period % 100).between(1, 12)), M.month_index(period))
    months = raw_perf.groupBy("loan_id", "monthly_reporting_period").agg(
        F.count("*").alias("copies"), F.first(index).alias("month")
    )
    reports = months.groupBy("loan_id").agg(
        F.sum("copies").alias("reports"),
        F.count_if(F.col("copies") > 1).alias("repeated"),
        (F.max("month") - F.min("month") + 1 - F.count("month")).alias("missing"),
    )
    loans = raw_orig.groupBy("loan_id").agg(F.count("*").alias("originated"))
    both = loans.join(reports, "loan_id", "full")
    zero = F.lit(0)
    return both.agg(
        F.coalesce(F.sum("originated"), zero).alias("raw_orig_rows"),
        F.coalesce(F.sum("reports"), zero).alias("raw_perf_rows"),
        F.count_if(F.col("originated") > 1).alias("duplicate_loans"),
        F.coalesce(F.sum("repeated"), zero).alias("duplicate_loan_months"),
        F.count_if(F.col("originated").isNull()).alias("perf_ids_not_in_orig"),
        F.count_if(F.col("reports").isNull()).alias("orig_ids_without_perf"),
        F.count_if(F.col("missing") > 0).alias("loans_with_gaps"),
        F.coalesce(F.sum("missing"), zero).alias("missing_months"),
    )


def final_validation(
    raw_orig: DataFrame,
    raw_perf: DataFrame,
    orig: DataFrame,
    perf: DataFrame,
    order_rows: DataFrame | None = None,
) -> DataFrame:
    """All structural checks in one row, with the overall decision.

    Each cleaned table is read once for its row rules. Raw reports are counted per loan and month,
    then per loan, and one full join with the originated ids gives the id checks.
    `order_rows` (loan_id, reporting_period_num, source_row) adds the file-order check.
    """
    period = F.col("reporting_period_num").try_cast("int")
    raw_period = F.col("monthly_reporting_period").try_cast("int")
    frames = [
        orig.agg(
            F.count("*").alias("orig_rows"), *_date_counts(), *_origination_rule_counts()
        ),
        perf.agg(
            F.count("*").alias("perf_rows"),
            *_period_counts(period, CUTOFF),
            _negative_age_count(),
            *_performance_rule_counts(),
        ),
        _id_checks(raw_orig, raw_perf, raw_period),
    ]
    if order_rows is not None:
        frames.append(order_violations(order_rows, "reporting_period_num"))
    row = merge_rows(*frames)
    cleaning = [
        "fico_bad", "dti_bad", "ltv_bad", "cltv_bad", "borrower_legacy_bad",
        "xx_bad", "ra_bad", "eltv_bad", "delinquency_parse_bad",
    ]
    critical = cleaning + [
        "duplicate_loans", "duplicate_loan_months", "perf_ids_not_in_orig", "invalid_period",
        "after_cutoff", "invalid_first_payment", "invalid_maturity",
        "maturity_before_first_payment", "negative_loan_age",
    ]
    if order_rows is not None:
        critical.append("order_violations")
    failed = any_of(
        [F.col(c) > 0 for c in critical]
        + [
            F.col("raw_orig_rows") != F.col("orig_rows"),
            F.col("raw_perf_rows") != F.col("perf_rows"),
        ]
    )
    warned = (F.col("orig_ids_without_perf") > 0) | (F.col("loans_with_gaps") > 0)
    return row.withColumn("status", decide(failed, warned))


def yearly_audit(orig: DataFrame, perf: DataFrame) -> DataFrame:
    """One row per vintage of the raw tables: sizes, id coverage, ranges, special codes, status."""
    first = F.col("first_payment_date").try_cast("int")
    age = F.col("loan_age").try_cast("bigint")
    status = F.col("delinquency_status")
    loans = perf.groupBy("loan_id").agg(F.count("*").alias("reports"))
    sizes = orig.groupBy("vintage_year").agg(
        F.count("*").alias("orig_rows"), F.count_distinct("loan_id").alias("orig_unique_loans")
    )
    monthly = perf.groupBy("vintage_year").agg(
        F.count("*").alias("perf_rows"),
        F.count_distinct("loan_id").alias("perf_unique_loans"),
        F.min("monthly_reporting_period").alias("first_period"),
        F.max("monthly_reporting_period").alias("last_period"),
        F.min(age).alias("min_loan_age"),
        F.max(age).alias("max_loan_age"),
        F.count_if(status == "RA").alias("ra_rows"),
        F.count_if(status == "XX").alias("xx_rows"),
    )
    # The cutoff of a vintage is its own last reporting period.
    silent = (
        orig.join(loans, "loan_id", "left_anti")
        .select("vintage_year", first.alias("first_payment"))
        .join(monthly.select("vintage_year", "last_period"), "vintage_year", "left")
        .groupBy("vintage_year")
        .agg(
            F.count("*").alias("orig_missing_in_perf"),
            F.count_if(F.col("first_payment") < F.col("last_period").cast("int")).alias(
                "missing_before_cutoff"
            ),
            F.count_if(F.col("first_payment") >= F.col("last_period").cast("int")).alias(
                "missing_at_after_cutoff"
            ),
        )
    )
    orphans = (
        perf.select("vintage_year", "loan_id")
        .distinct()
        .join(orig.select("loan_id").distinct(), "loan_id", "left_anti")
        .groupBy("vintage_year")
        .agg(F.count("loan_id").alias("perf_missing_in_orig"))
    )
    counts = ["perf_rows", "perf_unique_loans", "ra_rows", "xx_rows", "orig_missing_in_perf",
              "missing_before_cutoff", "missing_at_after_cutoff", "perf_missing_in_orig"]
    return (
        sizes.join(monthly, "vintage_year", "left")
        .join(silent, "vintage_year", "left")
        .join(orphans, "vintage_year", "left")
        .fillna(0, counts)
        .withColumn(
            "status",
            decide(
                (F.col("perf_missing_in_orig") > 0)
                | (F.col("orig_rows") != F.col("orig_unique_loans")),
                F.col("orig_missing_in_perf") > 0,
            ),
        )
    )


def require_pass(decision: DataFrame) -> dict:
    row = decision.first().asDict()
    if row["status"] == "FAIL":
        raise ContractError(f"Validation failed: {row}.")
    return row
