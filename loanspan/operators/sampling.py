"""Deterministic nested loan samples.

Loans are ordered inside their event stratum by the first 16 hex digits of SHA-256 of the loan id.
Ranks inside a stratum come from counts per hash prefix plus a row number inside the prefix, so the
stratum holding most loans is never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanspan.contracts import EVENT_TYPES, ContractError, require_columns

PREFIX_DIGITS = 3
FRACTION_SLICES = 1 << 14


def sample_hash(column: str = "loan_id"):
    """Hash text whose order equals the order of the 64-bit number it spells."""
    return F.substring(F.sha2(F.col(column), 256), 1, 16)


def ranked(frame: DataFrame) -> DataFrame:
    """Zero-based `stratum_rank` by (hash, loan_id) and `stratum_size` per event type."""
    hashed = frame.select("loan_id", "event_type", sample_hash().alias("sample_hash")).withColumn(
        "prefix", F.substring("sample_hash", 1, PREFIX_DIGITS)
    )
    counts = hashed.groupBy("event_type", "prefix").agg(F.count("*").alias("n"))
    stratum = Window.partitionBy("event_type")
    earlier = stratum.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    # At most 16^digits rows per stratum.
    offsets = counts.select(
        "event_type",
        "prefix",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
        F.sum("n").over(stratum).alias("stratum_size"),
    )
    inside = Window.partitionBy("event_type", "prefix").orderBy("sample_hash", "loan_id")
    return (
        hashed.withColumn("rank", F.row_number().over(inside))
        .join(offsets, ["event_type", "prefix"])
        .select(
            "loan_id",
            "event_type",
            "sample_hash",
            (F.col("offset") + F.col("rank") - 1).alias("stratum_rank"),
            "stratum_size",
        )
    )


def _strata(frame: DataFrame) -> dict[str, int]:
    require_columns(frame, ["loan_id", "event_type"], "Sample source")
    rows = frame.groupBy("event_type").agg(F.count("*").alias("n")).limit(10).collect()
    counts = {r["event_type"]: r["n"] for r in rows}
    if set(counts) != set(EVENT_TYPES):
        raise ContractError("The sample source must contain all event types and no other.")
    return counts


def _size(requested, low: int, high: int) -> int:
    if isinstance(requested, bool) or not isinstance(requested, int):
        raise ContractError("requested_loans must be an integer.")
    if not low <= requested <= high:
        raise ContractError(f"requested_loans must be between {low} and {high}.")
    return requested


def nested_sample(frame: DataFrame, requested_loans: int) -> DataFrame:
    """Sample ids with every event present; a smaller sample is a prefix of a larger one.

    The first loan of each stratum comes first, then loans by rank over stratum size. The order is
    cut by counting loans per slice of that fraction: whole slices below the cut are a filter, and
    only the slice the cut falls into is sorted.
    """
    counts = _strata(frame)
    _size(requested_loans, len(counts), sum(counts.values()))
    rows = ranked(frame)
    columns = ["loan_id", "event_type", "stratum_rank", "stratum_size"]
    fraction = F.col("stratum_rank") / F.col("stratum_size")
    rest = rows.filter(F.col("stratum_rank") > 0).withColumn(
        "slice", F.floor(fraction * FRACTION_SLICES).cast("int")
    )
    sizes = rest.groupBy("slice").agg(F.count("*").alias("n")).orderBy("slice").collect()
    left, cut = requested_loans - len(counts), FRACTION_SLICES
    for row in sizes:
        if row["n"] > left:
            cut = row["slice"]
            break
        left -= row["n"]
    chosen = [
        rows.filter(F.col("stratum_rank") == 0),
        rest.filter(F.col("slice") < cut),
        rest.filter(F.col("slice") == cut)
        .orderBy(fraction, "sample_hash", "event_type", "loan_id")
        .limit(left),
    ]
    return (
        chosen[0]
        .select(columns)
        .unionByName(chosen[1].select(columns))
        .unionByName(chosen[2].select(columns))
    )


def enriched_sample(frame: DataFrame, requested_loans: int) -> DataFrame:
    """All defaults plus a nested proportional prefix of the other strata.

    Of the first k non-default places, floor((2 k c + n) / (2 n)) are censored loans, with c of the
    n non-default loans censored. The closed form gives each stratum its quota, so membership is a
    filter on the rank.
    """
    counts = _strata(frame)
    default, censor = counts["DEFAULT"], counts["CENSOR"]
    others = censor + counts["PREPAYMENT"]
    _size(requested_loans, default + 2, default + others)
    remaining = requested_loans - default
    censored = (2 * remaining * censor + others) // (2 * others)
    quota = (
        F.when(F.col("event_type") == "DEFAULT", default)
        .when(F.col("event_type") == "CENSOR", censored)
        .otherwise(remaining - censored)
    )
    return (
        ranked(frame)
        .filter(F.col("stratum_rank") < quota)
        .select("loan_id", "event_type", "stratum_rank", "stratum_size")
    )


def complete_histories(performance: DataFrame, sampled: DataFrame) -> DataFrame:
    """Every monthly row of the sampled loans."""
    return performance.join(sampled.select("loan_id"), "loan_id", "left_semi")


def sample_metrics(frame: DataFrame) -> DataFrame:
    """Loans, events and delayed entries of a sample."""
    kind = F.col("event_type")
    return frame.agg(
        F.count("*").alias("actual_loans"),
        F.count_if(kind == "DEFAULT").alias("default_count"),
        F.count_if(kind == "PREPAYMENT").alias("prepayment_count"),
        F.count_if(kind == "CENSOR").alias("censor_count"),
        F.count_if(F.col("entry_time_month") > 0).alias("delayed_entry_count"),
    )
