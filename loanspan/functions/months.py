"""Calendar-month arithmetic on YYYYMM integers, YYYYMM text and first-of-month dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.functions.guards import enforce


#: Six digits that name a month.
_MONTH_TEXT = r"\A[1-9][0-9]{3}(0[1-9]|1[0-2])\z"


def yyyymm_to_date(col: Column) -> Column:
    """YYYYMM text to the first day of that month; NULL when it is not a month.

    The text is looked at three times only: a filter evaluates it anew each time, and a method of
    more than 8,000 bytes is not compiled to machine code.
    """
    year, month = F.substring(col, 1, 4).cast("int"), F.substring(col, 5, 2).cast("int")
    return F.when(col.rlike(_MONTH_TEXT), F.make_date(year, month, F.lit(1)))


def require_months(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The rows of `df`; a non-NULL value of the labelled columns that is no month fails."""
    for label, col in columns.items():
        df = enforce(
            df,
            col.isNull() | col.rlike(_MONTH_TEXT),
            F.concat(F.lit(f"{label} is not a YYYYMM month: "), col),
        )
    return df


def is_month(num: Column) -> Column:
    """True when a YYYYMM integer names a month; never NULL."""
    return F.coalesce((num % 100).between(1, 12) & num.between(100001, 999912), F.lit(False))


def month_index(num: Column) -> Column:
    """Continuous month number of a YYYYMM integer."""
    num = num.cast("int")
    return (F.floor(num / F.lit(100)) * 12 + num % 100).cast("int")


def date_month_index(date: Column) -> Column:
    """Continuous month number of a date."""
    return F.year(date) * 12 + F.month(date)


def date_to_yyyymm(date: Column) -> Column:
    return (F.year(date) * 100 + F.month(date)).cast("int")


def yyyymm_to_first_day(num: Column) -> Column:
    """First day of the month named by a valid YYYYMM integer."""
    return F.make_date(F.floor(num / F.lit(100)).cast("int"), (num % 100).cast("int"), F.lit(1))


def index_to_yyyymm(index: Column) -> Column:
    """Inverse of `month_index`."""
    zero = index - 1
    return (F.floor(zero / F.lit(12)) * 100 + zero % 12 + 1).cast("int")


def index_to_first_day(index: Column) -> Column:
    zero = index - 1
    return F.make_date(F.floor(zero / F.lit(12)).cast("int"), (zero % 12 + 1).cast("int"), F.lit(1))
