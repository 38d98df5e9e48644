"""Checks that column pruning cannot remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enforce(df: DataFrame, ok: Column, message: Column, keep: Column | None = None) -> DataFrame:
    """The rows of `df`, or those to `keep`; the first row that is not `ok` fails the query.

    The check is a filter. A check inside a projected column is skipped whenever that column is
    not read, in a count for example; a filter is always evaluated. A condition on the checked
    columns belongs in `keep`: as a filter of its own Spark may evaluate it first, or fold it with
    a constant to an empty table that is never checked.
    """
    fails = F.raise_error(F.coalesce(message, F.lit("NULL"))).cast("boolean")
    kept = F.lit(True) if keep is None else keep
    return df.filter(F.when(F.coalesce(ok, F.lit(False)), kept).otherwise(fails))
