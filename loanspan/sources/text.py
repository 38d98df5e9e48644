"""Header-less pipe-delimited text, read with declared all-string schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanspan.contracts import (
    ORIGINATION_FIELDS,
    ORIGINATION_KEEP,
    PERFORMANCE_FIELDS,
    PERFORMANCE_KEEP,
    ContractError,
    all_strings,
)
from loanspan.functions import months as M
from loanspan.functions.codes import any_of, blank_to_null
from loanspan.functions.guards import enforce

#: Splits of text files whose line offsets travel to the lines.
MAX_SPLITS = 200_000

# Field positions and names of the typed reader.
TYPED_ORIGINATION = {
    0: "credit_score",
    1: "first_payment_date",
    3: "maturity_date",
    9: "original_dti",
    10: "original_upb",
    11: "original_ltv",
    12: "original_interest_rate",
    19: "loan_id",
    21: "original_loan_term",
}
TYPED_PERFORMANCE = {
    0: "loan_id",
    1: "performance_month",
    2: "current_actual_upb",
    3: "current_delinquency_status",
    4: "source_loan_age",
    7: "modification_flag",
    8: "zero_balance_code",
    9: "zero_balance_effective_date",
    10: "current_interest_rate",
}
TYPED_DATES = {
    "first_payment_date",
    "maturity_date",
    "performance_month",
    "zero_balance_effective_date",
}
TYPED_NUMBERS = {
    "credit_score",
    "original_dti",
    "original_upb",
    "original_ltv",
    "original_interest_rate",
    "original_loan_term",
    "current_actual_upb",
    "source_loan_age",
    "current_interest_rate",
}


def kind_fields(kind: str) -> tuple[list[str], list[str]]:
    """All field names and the kept ones of `origination` or `performance` text."""
    if kind == "origination":
        return ORIGINATION_FIELDS, ORIGINATION_KEEP
    if kind == "performance":
        return PERFORMANCE_FIELDS, PERFORMANCE_KEEP
    raise ContractError(f"Unknown text kind: {kind!r}.")


def scan_text(spark: SparkSession, paths, kind: str, vintage_year: int) -> DataFrame:
    """Kept columns of pipe text as strings, tagged with the vintage year.

    A row with too few or too many fields fails the query.
    """
    fields, keep = kind_fields(kind)
    return (
        spark.read.schema(all_strings(fields))
        .option("sep", "|")
        .option("mode", "FAILFAST")
        # With pruned parsing a row of the wrong length would pass unnoticed.
        .option("columnPruning", "false")
        .option("enforceSchema", "true")
        # A quote is an ordinary character in these files.
        .option("quote", "\u0000")
        .csv(paths)
        .select(*keep)
        .withColumn("vintage_year", F.lit(str(vintage_year)))
    )


def _with_fields(lines: DataFrame, line) -> DataFrame:
    """`lines` with `_parts`, the fields of a pipe-delimited line.

    The one-element explode keeps Spark from writing the split into every expression that uses it.
    """
    return lines.withColumn("_parts", F.explode(F.array(F.split(line, r"\|", -1))))


def _right_count(count: int) -> tuple[Column, Column]:
    found = F.size("_parts").cast("string")
    return F.size("_parts") == count, F.concat(F.lit(f"expected {count} fields, found "), found)


def split_lines(lines: DataFrame, kind: str) -> DataFrame:
    """Split a `value` column of pipe-delimited lines into the kept columns, strictly."""
    fields, keep = kind_fields(kind)
    rest = [name for name in lines.columns if name != "value"]
    split = _with_fields(lines, F.col("value"))
    return enforce(split, *_right_count(len(fields))).select(
        *[
            F.when(F.col("_parts")[fields.index(name)] != "", F.col("_parts")[fields.index(name)])
            .alias(name)
            for name in keep
        ],
        *rest,
    )


def numbered_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines with the name of their file and their 1-based line number in it.

    Spark cuts large files into splits, so the number is the count of lines in the earlier splits
    plus the position inside the own split. Only one row per split is aggregated; the lines are
    never sorted, gathered or exchanged: the table of splits travels to them while it has at most
    `MAX_SPLITS` rows. File splits are the same in both scans, so a lost executor changes nothing.
    """
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("scan_id"),
    )
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    counted = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("scan_id"),
    )
    splits = (
        counted.groupBy("path", "block")
        .agg(F.min("scan_id").alias("first_id"), F.count("*").alias("lines"))
        .select(
            "path",
            "block",
            (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first_id") + 1).alias("shift"),
        )
    )
    found = splits.limit(MAX_SPLITS + 1).toArrow()
    if found.num_rows <= MAX_SPLITS:
        splits = F.broadcast(spark.createDataFrame(found))
    return lines.join(splits, ["path", "block"]).select(
        "value",
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        (F.col("scan_id") + F.col("shift")).alias("source_row"),
    )


def scan_typed_text(spark: SparkSession, paths, kind: str) -> DataFrame:
    """Typed columns by position from text files, with `<col>_raw`, source file and row.

    Text is trimmed and blanks become NULL; a NULL loan id, a bad month or a bad number fails the
    query, as does a line with the wrong number of fields.
    """
    fields, _ = kind_fields(kind)
    spec = TYPED_ORIGINATION if kind == "origination" else TYPED_PERFORMANCE
    line = F.when(
        F.col("source_row") == 1, F.regexp_replace("value", "^\\uFEFF", "")
    ).otherwise(F.col("value"))
    source = enforce(
        _with_fields(numbered_lines(spark, paths), line), *_right_count(len(fields))
    )
    columns, checks = [], []
    for position, name in spec.items():
        raw = F.col("_parts")[position]
        value = blank_to_null(raw)
        missing = F.col(f"_row.{name}").isNull()
        if name in TYPED_DATES or name in TYPED_NUMBERS:
            dated = name in TYPED_DATES
            typed = M.yyyymm_to_date(value) if dated else value.try_cast("double")
            columns += [typed.alias(name), raw.alias(f"{name}_raw")]
            text = F.trim(F.col(f"_row.{name}_raw"))
            label = f"{name} is {'not a YYYYMM month' if dated else 'not numeric'}: "
            checks.append((missing & (text != ""), F.concat(F.lit(label), text)))
        else:
            columns.append(value.alias(name))
            if name == "loan_id":
                checks.append((missing, F.lit("loan_id is missing")))
    # Checked as they are, not written again into one very long expression.
    typed = source.select(
        F.explode(F.array(F.struct(*columns, "source_file", "source_row"))).alias("_row")
    )
    message = F.coalesce(*[F.when(bad, said) for bad, said in checks])
    return enforce(typed, ~any_of(bad for bad, _ in checks), message).select("_row.*")
