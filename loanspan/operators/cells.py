"""Counts per (group, entry, exit, cause), the only thing the non-parametric estimators need.

With whole-month clocks the loan table collapses in one map-side combined aggregate to at most a
few tens of thousands of rows per group, whatever its size or skew. Everything after that runs on
month tables whose windows are bounded by the number of months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["group_name", "group_value"]


def group_columns(group_col: str | None) -> list[Column]:
    if group_col is None:
        return [F.lit("portfolio").alias("group_name"), F.lit("all").alias("group_value")]
    return [
        F.lit(group_col).alias("group_name"),
        F.col(group_col).cast("string").alias("group_value"),
    ]


def event_cells(frame: DataFrame, code: Column, group_col: str | None = None) -> DataFrame:
    """Number of loans `n` per group, entry month, exit month and cause code."""
    return (
        frame.select(
            *group_columns(group_col),
            F.col("entry_time_month").alias("entry"),
            F.col("exit_time_month").alias("exit"),
            code.cast("int").alias("code"),
        )
        .groupBy(*GROUP, "entry", "exit", "code")
        .agg(F.count("*").alias("n"))
    )


def band_cells(frame: DataFrame, code: Column, features: list[str]) -> DataFrame:
    """Cells of several band columns at once.

    Loans are first counted over all bands together; only those counts are repeated per feature.
    """
    joint = frame.groupBy(
        *features,
        F.col("entry_time_month").alias("entry"),
        F.col("exit_time_month").alias("exit"),
        code.cast("int").alias("code"),
    ).agg(F.count("*").alias("n"))
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("group_name"),
                    F.col(name).cast("string").alias("group_value"),
                )
                for name in features
            ]
        )
    )
    return (
        joint.select(pairs.alias("g"), "entry", "exit", "code", "n")
        .groupBy(
            F.col("g.group_name").alias("group_name"),
            F.col("g.group_value").alias("group_value"),
            "entry",
            "exit",
            "code",
        )
        .agg(F.sum("n").alias("n"))
    )


def up_to(keys=GROUP, order="t"):
    """Window over a group's months up to and including the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys=GROUP, order="t"):
    """Window over a group's months before the current one."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def month_table(cells: DataFrame) -> DataFrame:
    """Dense monthly grid per group from the first entry to the last exit.

    `at_risk` counts entry < t <= exit, the denominator of every hazard here; `present` counts
    entry <= t <= exit, the number reported beside Kaplan-Meier estimates.
    """
    zero = F.lit(0).cast("long")
    n, code = F.col("n"), F.col("code")

    def move(t, entered, left):
        count = {name: zero for name in ["entered", "defaults", "prepays", "censored"]}
        if entered:
            count["entered"] = n
        if left:
            count["defaults"] = F.when(code == 1, n).otherwise(zero)
            count["prepays"] = F.when(code == 2, n).otherwise(zero)
            count["censored"] = F.when(code == 0, n).otherwise(zero)
        return F.struct(F.col(t).alias("t"), *[v.alias(k) for k, v in count.items()])

    moves = (
        cells.select(
            *GROUP, F.explode(F.array(move("entry", True, False), move("exit", False, True))).alias("m")
        )
        .select(*GROUP, "m.*")
        .groupBy(*GROUP, "t")
        .agg(*[F.sum(c).alias(c) for c in ["entered", "defaults", "prepays", "censored"]])
    )
    grid = (
        cells.groupBy(*GROUP)
        .agg(F.min("entry").alias("lo"), F.max("exit").alias("hi"))
        .select(*GROUP, F.explode(F.sequence("lo", "hi")).alias("t"))
    )
    names = ["entered", "defaults", "prepays", "censored"]
    left = F.col("defaults") + F.col("prepays") + F.col("censored")
    entered_before = F.coalesce(F.sum("entered").over(before()), zero)
    left_before = F.coalesce(F.sum(left).over(before()), zero)
    return (
        grid.join(moves, [*GROUP, "t"], "left")
        .fillna(0, names)
        .withColumn("at_risk", entered_before - left_before)
        .withColumn("present", F.col("at_risk") + F.col("entered"))
    )
