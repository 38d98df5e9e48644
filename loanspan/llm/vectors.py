"""Whole-number vectors laid out in lanes by length, and queries streamed past each lane.

A lane is one stretch of all rows in order of length, about `LANE_ROWS` of them. A search holds one
lane in a task at a time while the queries pass it in Arrow batches, so that queries are copied
once for each lane, rows are never copied, and no task holds more than a lane and a block of
queries. Rows of equal length, however many, are spread over lanes by a salt.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.llm.common import written

#: Rows of a lane.
LANE_ROWS = 1 << 16
#: Rows of a lane at least, as long as there are fewer lanes than shuffle partitions.
LANE_LEAST = 1 << 11
#: Largest size of a component; larger ones count as this.
LARGEST = (1 << 26) - 1
#: Rows of the sample that gives searches their first bounds, and components of such a row.
SEEDS = 1024
SEED_COMPONENTS = 4096
#: Below this product of lengths, sums of products are exact in floating point.
EXACT = float(1 << 53)

VECTORS = "row bigint, vec_id bigint, label int, v array<int>, length double"


def scaled(vector: Column) -> Column:
    """floor(256 * x) of each component x as double; null if one is missing or not finite."""
    x_of = lambda x: x.cast("double")
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x_of(x)) & (F.abs(x_of(x)) != float("inf"))
    )
    whole = F.transform(
        vector,
        lambda x: F.greatest(F.least(F.floor(256 * x_of(x)), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"),
    )
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def laid_out(vectors: DataFrame) -> DataFrame:
    """(lane, row, vec_id, label, v, length) of `vectors` (vec_id, label, v), written once.

    Rows without vec_id or vector are left out. `row` tells rows apart that share their id. Lanes
    hold falling lengths.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("vec_id is not null and v is not null").select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        "v",
        F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)).alias("length"),
    )
    n = vectors.count()
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / LANE_LEAST))
    lanes = max(1, wanted, math.ceil(n / LANE_ROWS))
    return written(
        rows.repartitionByRange(lanes, F.desc("length"), F.xxhash64("row"))
        .sortWithinPartitions(F.desc("length"))
        .select(F.spark_partition_id().alias("lane"), "*")
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as floats; shorter rows end in zeros."""
    counts = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(counts.max(initial=0))
    if len(flat) == width * len(counts):
        return flat.reshape(len(counts), width)
    out = np.zeros((len(counts), width))
    out[np.arange(width) < counts[:, None]] = flat
    return out


def stacked(parts: list[np.ndarray]) -> np.ndarray:
    """Matrices one below the other, all as wide as the widest."""
    width = max(p.shape[1] for p in parts)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of the rows of `a` with those of `b`; missing components are zero.

    `bound` is the largest product of two lengths.
    """
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if bound < EXACT:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


class Rows:
    """Columns of some vectors."""

    def __init__(self, parts: list[pa.RecordBatch]):
        take = lambda name, kind: np.concatenate(
            [p[name].to_numpy(zero_copy_only=False).astype(kind) for p in parts]
        )
        self.row, self.vec_id = take("row", np.int64), take("vec_id", np.int64)
        self.length = take("length", np.float64)
        self.label = np.concatenate([p["label"].fill_null(0).to_numpy(zero_copy_only=False) for p in parts])
        self.v = stacked([matrix(p["v"]) for p in parts])
        self.parts = parts

    def __len__(self):
        return len(self.row)

    def column(self, name: str) -> list:
        return [x for p in self.parts for x in p[name].to_pylist()]


def seeds(rows: DataFrame) -> dict[str, np.ndarray] | None:
    """A bounded sample of the rows, `SEEDS` at most.

    Scores with sampled rows are true scores, so the k-th of them bounds a query's k-th score from
    below. The sample speeds a search up and decides nothing.
    """
    table = (
        rows.filter(F.size("v") <= SEED_COMPONENTS)
        .orderBy(F.xxhash64("row"), "row")
        .limit(SEEDS)
        .select("row", "vec_id", "label", "v", "length")
        .toArrow()
    )
    if not table.num_rows:
        return None
    found = Rows(table.combine_chunks().to_batches())
    return {k: getattr(found, k) for k in ("row", "label", "length", "v")}


def past_lanes(
    rows: DataFrame,
    queries: DataFrame,
    block: str,
    search: Callable[[Rows, Rows], Iterator[pa.RecordBatch]],
    schema: str,
    reach: Column | None = None,
) -> DataFrame:
    """What `search(lane, queries)` yields for every lane and every block of queries.

    `queries` has the columns of rows and any further ones; those that share the number in column
    `block` come together, in order of `place`. A query whose least useful length `reach` is above
    a lane's longest row does not visit that lane.
    """
    lengths = rows.groupBy("lane").agg(F.max("length").alias("longest"))
    count = (rows.agg(F.max("lane")).first()[0] or 0) + 1
    visits = queries.drop("lane").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    if reach is not None:
        visits = visits.join(lengths, "lane").filter(F.col("longest") >= reach).drop("longest")
    mine = [c for c in visits.columns if c not in rows.columns]
    names = [*rows.columns, *mine, "visits"]
    held = rows.select(
        *rows.columns, *[F.lit(None).cast(visits.schema[c].dataType).alias(c) for c in mine], F.lit(0).alias("visits")
    )
    both = (
        held.unionByName(visits.withColumn("visits", F.lit(1)).select(*names))
        .repartition(count, "lane")
        .sortWithinPartitions("lane", "visits", block, "place", F.desc("length"))
    )

    def run(batches):
        lane, held, kept, waiting, key = None, None, [], [], None

        def searched():
            nonlocal held, waiting
            if waiting and (held or kept):
                held = held or Rows(kept)
                kept.clear()
                yield from search(held, Rows(waiting))
            waiting = []

        for batch in batches:
            marks = np.stack(
                [batch[c].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lane", "visits", block)], 1
            )
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(marks)], strict=True):
                if stop == start:
                    continue
                now, part = tuple(marks[start]), batch.slice(start, stop - start)
                if now != key:
                    yield from searched()
                if now[0] != lane:
                    lane, held = now[0], None
                    kept.clear()
                (waiting if now[1] else kept).append(part)
                key = now
        yield from searched()

    return both.mapInArrow(run, schema)
