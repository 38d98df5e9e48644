"""Harrell's concordance of a risk score with exit months, without comparing loans pairwise.

Loans with equal (score, month, event) are counted together first, so copies of one profile are one
row. The counts are range-partitioned by score; a partition goes through them by batch, keeping one
counter per exit month for the scores it has passed, and reports its totals. Pairs across partitions
follow from those totals.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanspan.contracts import ContractError, merge_rows
from loanspan.functions.durable import durable

MAX_MONTHS = 5_000
#: Loans compared directly.
BLOCK = 512


class PassedCounts:
    """Loans in order of score, and how many of the first ones outlast a given event.

    A loan's key is twice its exit month, plus one if it is censored: an event of month t is
    comparable with exactly the loans of keys above 2 t. Every `BLOCK` loans a row of a matrix holds the
    number passed so far above each key; what is left of a block is compared directly. A question
    thus costs one look-up and one block, whatever the number of distinct scores.
    """

    def __init__(self, passed: np.ndarray, key: np.ndarray, count: np.ndarray):
        self.key, self.count = key, count
        self.blocks = len(key) // BLOCK + 1
        inside = np.zeros((self.blocks + 1, len(passed)))
        np.add.at(inside, (np.arange(len(key)) // BLOCK + 1, key), count)
        inside[0] = passed
        self.total = inside.sum(0)
        before = np.cumsum(inside[:-1], axis=0)
        self.above = np.cumsum(before[:, ::-1], axis=1)[:, ::-1] - before

    def outlasting(self, place: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Number of loans above `key` among those passed and the first `place` of these."""
        block = place // BLOCK
        found = self.above[block, key]
        for b in np.unique(block):
            asked = np.flatnonzero(block == b)
            start = b * BLOCK
            row = np.arange(start, min(start + BLOCK, len(self.key)))
            counted = (row < place[asked, None]) & (self.key[row] > key[asked, None])
            found[asked] += counted @ self.count[row]
        return found


def _scan_sorted(max_month: int):
    """mapInArrow body over rows sorted by score: pair counts inside the partition, then totals."""
    from pyspark import TaskContext

    def scan(batches):
        passed, sums, held = np.zeros(2 * max_month + 2), np.zeros(2), None

        def close(rows):
            nonlocal passed
            score, key, count = rows
            counts = PassedCounts(passed, key, count)
            event = np.flatnonzero(key % 2 == 0)
            # Loans of lower scores stand before the first row of the event's score.
            first = np.searchsorted(score, score[event], "left")
            last = np.searchsorted(score, score[event], "right")
            lower = counts.outlasting(first, key[event])
            sums[0] += count[event] @ lower
            sums[1] += count[event] @ (counts.outlasting(last, key[event]) - lower)
            passed = counts.total

        for batch in batches:
            column = lambda name, batch=batch: batch[name].to_numpy(zero_copy_only=False)
            now = [column("score"), 2 * column("month") + (column("event") == 0), column("n")]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            # The last score may go on in the next batch; it has two rows for each month at most.
            cut = int(np.searchsorted(now[0], now[0][-1], "left")) if len(now[0]) else 0
            if cut:
                close([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is None or not len(held[0]):
            return
        close(held)
        key = np.flatnonzero(passed)
        rows = {
            "part": np.full(len(key) + 1, TaskContext.get().partitionId(), np.int32),
            "month": np.append(key // 2, -1).astype(np.int32),
            "event": np.append(1 - key % 2, -1).astype(np.int32),
            "n": np.append(passed[key], 0.0),
            "concordant": np.append(np.zeros(len(key)), sums[0]),
            "tied": np.append(np.zeros(len(key)), sums[1]),
        }
        yield pa.RecordBatch.from_pydict(rows)

    return scan


def concordance_counts(
    frame: DataFrame, score: Column, month: Column, event: Column, last: int | None = None
) -> dict:
    """Concordant, tied and comparable pairs.

    An event is comparable with every later exit and with censored exits of its own month. A higher
    score means an earlier event is expected. `last` is the last exit month, if it is known.
    """
    rows = frame.select(
        score.cast("double").alias("score"),
        month.cast("int").alias("month"),
        event.cast("int").alias("event"),
    )
    if last is None:
        last = rows.agg(F.max("month")).first()[0]
    if last is None or last > MAX_MONTHS:
        raise ContractError("Concordance needs a non-empty month clock.")
    counted = rows.groupBy("score", "month", "event").agg(F.count("*").cast("double").alias("n"))
    parts = (
        counted.repartitionByRange("score")
        .sortWithinPartitions("score")
        .mapInArrow(
            _scan_sorted(last),
            "part int, month int, event int, n double, concordant double, tied double",
        )
    )
    # Range boundaries are sampled per run: write the totals once so all sums see the same ones.
    with durable(parts) as written:
        return _combine(written, last).first().asDict()


def _combine(parts: DataFrame, last: int) -> DataFrame:
    """Add the pairs whose lower score lies in an earlier partition, from month totals alone."""
    month, event, n = F.col("month"), F.col("event"), F.col("n")
    counts = (
        parts.filter(month >= 0)
        .groupBy("part", "month")
        .agg(
            F.sum("n").alias("exits"),
            F.sum(F.when(event == 0, n).otherwise(0.0)).alias("censored"),
            F.sum(F.when(event == 1, n).otherwise(0.0)).alias("events"),
        )
    )
    every_month = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("month")
    dense = (
        counts.select("part")
        .distinct()
        .select("part", every_month)
        .join(counts, ["part", "month"], "left")
        .fillna(0.0, ["exits", "censored", "events"])
    )
    after = (
        Window.partitionBy("part")
        .orderBy(F.desc("month"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lower = Window.partitionBy("month").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    partners = dense.withColumn(
        "partners", F.coalesce(F.sum("exits").over(after), zero) + F.col("censored")
    )
    across = partners.withColumn("below", F.coalesce(F.sum("partners").over(lower), zero)).agg(
        F.sum(F.col("events") * F.col("below")).alias("across")
    )
    total = (
        partners.groupBy("month")
        .agg(F.sum("events").alias("events"), F.sum("partners").alias("partners"))
        .agg(F.sum(F.col("events") * F.col("partners")).alias("comparable"))
    )
    inside = parts.filter(month < 0).agg(
        F.sum("concordant").alias("concordant"), F.sum("tied").alias("tied")
    )
    return merge_rows(inside, across, total).select(
        (F.col("concordant") + F.col("across")).alias("concordant"), "tied", "comparable"
    )


def concordance_index(
    frame: DataFrame, score: Column, month: Column, event: Column, last: int | None = None
) -> float:
    row = concordance_counts(frame, score, month, event, last)
    if not row["comparable"]:
        raise ContractError("No comparable pairs for concordance.")
    return (row["concordant"] + 0.5 * row["tied"]) / row["comparable"]
