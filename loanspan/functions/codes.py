"""Special-code handling and NULL-safe predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.functions.guards import enforce


def blank_to_null(col: Column) -> Column:
    """Trim text and turn an empty result into NULL."""
    return F.nullif(F.trim(col), F.lit(""))


def numeric_without_code(col: Column, code: str, dtype: str) -> Column:
    """Lenient numeric value of raw text; the not-available code becomes NULL."""
    return F.when(col == code, F.lit(None).cast(dtype)).otherwise(col.try_cast(dtype))


def coded_numeric(col: Column, code: str, dtype: str) -> Column:
    """Numeric value of raw text; blank, the missing code and text that is no number are NULL."""
    text = F.trim(col)
    return F.when(text.isin("", code), F.lit(None).cast(dtype)).otherwise(text.try_cast(dtype))


def require_numeric(df: DataFrame, col: Column, code: str, dtype: str, label: str) -> DataFrame:
    """The rows of `df`; text that is neither blank, the missing code nor a number fails."""
    text = F.trim(col)
    return enforce(
        df,
        text.isNull() | text.isin("", code) | text.try_cast(dtype).isNotNull(),
        F.concat(F.lit(f"{label} is not numeric: "), text),
    )


def true(cond: Column) -> Column:
    """Boolean with NULL read as False."""
    return F.coalesce(cond, F.lit(False))


def is_finite(col: Column) -> Column:
    """Non-NULL, not NaN and not infinite; never NULL."""
    value = col.cast("double")
    return true(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))


def all_of(conds) -> Column:
    return reduce(lambda a, b: a & b, conds)


def any_of(conds) -> Column:
    return reduce(lambda a, b: a | b, conds)


def truthy_text(col: Column) -> Column:
    """Read flag text such as 'True', ' yes ' or '1'; anything else is False."""
    return true(F.lower(F.trim(col.cast("string"))).isin("true", "1", "yes", "y"))


def delinquency_label(col: Column) -> Column:
    """Plain-language delinquency status of a raw status code."""
    code = F.upper(F.trim(col))
    number = F.floor(code.try_cast("double")).cast("int")
    padded = F.when(F.length(code) < 2, F.lpad(code, 2, "0")).otherwise(code)
    return (
        F.when(code.isNull() | code.isin("", "XX", "NAN", "NONE"), F.lit("NO_DELINQUENCY_DATA"))
        .when(code == "RA", F.lit("RA_SPECIAL_STATUS"))
        .when(number.isNull(), F.concat(code, F.lit(" SOURCE_CODE")))
        .when(number <= 0, F.concat(padded, F.lit(" CURRENT")))
        .when(number == 1, F.concat(padded, F.lit(" DPD_30")))
        .when(number == 2, F.concat(padded, F.lit(" DPD_60")))
        .otherwise(F.concat(padded, F.lit(" DPD_90_PLUS")))
    )


def event_label(profile_event: Column, timeline_event: Column) -> Column:
    """Final-event label; the loan-level event is the authority, the timeline the fallback."""
    value = F.upper(F.coalesce(blank_to_null(profile_event), blank_to_null(timeline_event)))
    return (
        F.when(value == "DEFAULT", F.lit("DEFAULT"))
        .when(value.isin("PREPAYMENT", "VOLUNTARY_PREPAYMENT"), F.lit("PREPAYMENT"))
        .when(value.isin("CENSOR", "CENSORED", "RIGHT_CENSOR"), F.lit("END_OF_FOLLOW_UP"))
        .otherwise(F.lit("UNKNOWN"))
    )
