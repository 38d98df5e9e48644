"""Exact top-k inner products by norm buckets.

Vectors lie in order of length, cut into buckets of similar length. A query's k-th score so far,
divided by its length and by the longest length of a bucket, is the bucket's local threshold: the
cosine a row there needs. Above 1 the bucket and all later ones are left out. Else each bucket and query
gets the cheaper of two prunings:

* coordinates: a row that reaches the cosine lies, in each coordinate, in a range around the
  query's. The query's largest coordinates are looked up in sorted lists of the bucket, and rows in
  all their ranges are verified;
* length: rows long enough to reach the score at all are verified, those of all such queries in
  one product.

Verified products are exact whole numbers, so nothing is lost or approximate. First thresholds come
from a bounded sample of rows. The work is queries by rows at worst, in blocks; every step is
spread over lanes of rows (`vectors.py`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanspan.llm import vectors

#: Highest scores returned for each query.
K = 5
#: Rows of a bucket at most, and its shortest length against its longest.
BUCKET_ROWS = 4096
BUCKET_RATIO = 0.9
#: Queries that pass a lane together.
QUERY_ROWS = 512
#: Coordinates of a query that are looked up, and the least local threshold for it: below, the
#: ranges hold nearly all rows.
FOCUS = 4
COORDINATE_COSINE = 0.7
#: Share of a bucket that coordinates must leave at most to be preferred.
COORDINATE_SHARE = 0.05
#: Slack of bounds, against rounding.
SLACK = 1e-9

FOUND = "row bigint, query_id bigint, vec_id bigint, score bigint"


class Bucket:
    """Rows of similar length, in order of falling length."""

    def __init__(self, rows: vectors.Rows, start: int, stop: int):
        part = slice(start, stop)
        self.v, self.length = rows.v[part], rows.length[part]
        self.vec_id, self.row = rows.vec_id[part], rows.row[part]
        self.longest = float(self.length[0])
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._unit = None

    def sorted_by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of unit coordinate `f` in order, and their rows."""
        if f not in self._sorted:
            if self._unit is None:
                self._unit = self.v / np.maximum(self.length, 1e-300)[:, None]
            order = np.argsort(self._unit[:, f])
            self._sorted[f] = self._unit[order, f], order
        return self._sorted[f]

    def in_ranges(self, unit: np.ndarray, cosine: float) -> np.ndarray | None:
        """Rows whose coordinates allow `cosine` with `unit`; None if that are too many."""
        width = min(len(unit), self.v.shape[1])
        around, best = np.arccos(min(cosine, 1.0)), None
        ranges = []
        for f in np.argsort(-np.abs(unit[:width]))[:FOCUS]:
            angle = np.arccos(np.clip(unit[f], -1, 1))
            low = np.cos(min(np.pi, angle + around)) - SLACK
            high = np.cos(max(0.0, angle - around)) + SLACK
            values, order = self.sorted_by(int(f))
            start, stop = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            ranges.append((int(f), low, high))
            if best is None or stop - start < len(best):
                best = order[start:stop]
        if best is None or len(best) > COORDINATE_SHARE * len(self.v):
            return None
        for f, low, high in ranges:
            x = self._unit[best, f]
            best = best[(x >= low) & (x <= high)]
        return best


def buckets(rows: vectors.Rows) -> list[Bucket]:
    """Stretches of `rows` of at most `BUCKET_ROWS` rows and of similar length."""
    found, start = [], 0
    while start < len(rows):
        shortest = BUCKET_RATIO * rows.length[start]
        stop = start + int(np.searchsorted(-rows.length[start : start + BUCKET_ROWS], -shortest, "right"))
        found.append(Bucket(rows, start, max(stop, start + 1)))
        start = found[-1].row.size + start
    return found


class Best:
    """Highest scores of each of some queries, ties to the smaller id."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.query = np.zeros(0, np.int64)
        self.score, self.vec_id = np.zeros(0), np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, vec_id: np.ndarray) -> None:
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, score])
        vec_id = np.concatenate([self.vec_id, vec_id])
        order = np.lexsort((vec_id, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.k]
        self.query, self.score, self.vec_id = query[place < self.k], score[kept], vec_id[kept]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        at = self.query[last]
        self.least[at] = np.maximum(self.least[at], self.score[last])


def searcher(k: int):
    """Top `k` of a lane for a block of queries."""
    made: list = [None, None]

    def search(lane: vectors.Rows, queries: vectors.Rows):
        if made[0] is not lane:
            made[:] = lane, buckets(lane)
        best = Best(np.array(queries.column("least"), np.float64), k)
        unit = queries.v / np.maximum(queries.length, 1e-300)[:, None]
        for bucket in made[1]:
            _search(bucket, queries, unit, best)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(queries.row[best.query]),
                pa.array(queries.vec_id[best.query]),
                pa.array(best.vec_id),
                pa.array(best.score.astype(np.int64)),
            ],
            names=["row", "query_id", "vec_id", "score"],
        )

    return search


def _search(bucket: Bucket, queries: vectors.Rows, unit: np.ndarray, best: Best) -> None:
    reach = queries.length * bucket.longest
    cosine = np.where(best.least > 0, best.least / np.maximum(reach, 1e-300), -np.inf)
    open_ = np.flatnonzero(cosine <= 1 + SLACK)
    bound = float(reach.max(initial=0))
    by_length = []
    for q in open_:
        rows = bucket.in_ranges(unit[q], cosine[q] - SLACK) if cosine[q] >= COORDINATE_COSINE else None
        if rows is None:
            by_length.append(q)
            continue
        rows = rows[bucket.row[rows] != queries.row[q]]
        score = vectors.products(queries.v[q : q + 1], bucket.v[rows], bound)[0]
        good = score >= best.least[q]
        best.add(np.full(good.sum(), q), score[good].astype(np.float64), bucket.vec_id[rows[good]])
    if not by_length:
        return
    by_length = np.array(by_length)
    least = best.least[by_length]
    # Rows come by falling length: those that can reach a query's score stand in front.
    needed = np.where(least > 0, least / np.maximum(queries.length[by_length], 1e-300), -np.inf) * (1 - SLACK)
    front = int(np.searchsorted(-bucket.length, -needed.min(), "right"))
    score = vectors.products(queries.v[by_length], bucket.v[:front], bound).astype(np.float64)
    score[queries.row[by_length][:, None] == bucket.row[None, :front]] = -np.inf
    if front > best.k:
        least = np.maximum(least, np.partition(score, front - best.k, 1)[:, front - best.k])
    q, r = np.nonzero((score >= least[:, None]) & (score > -np.inf))
    best.add(by_length[q], score[q, r], bucket.vec_id[r])


def _first_bounds(seeds, k: int):
    """`least` of each query: its k-th score among the sampled rows other than itself."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = vectors.Rows([batch])
            least = np.full(len(queries), -np.inf)
            if seeds is not None and len(seeds["row"]) > k:
                bound = float(queries.length.max() * seeds["length"].max())
                score = vectors.products(queries.v, seeds["v"], bound).astype(np.float64)
                score[queries.row[:, None] == seeds["row"][None, :]] = -np.inf
                least = np.partition(score, -k, 1)[:, -k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(least)], names=[*batch.schema.names, "least"]
            )

    return run


def top_products(table: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` highest inner products of each query.

    `table` has vec_id and v, an array of whole numbers; the column `queries` marks the rows that
    are queries. All other rows are a query's candidates; ties go to the smaller vec_id. Rows
    without id or vector take no part. Rows that share an id are rows of their own: each is a
    candidate of the other, and each query among them has its own ranks. Missing components of
    shorter vectors count as zero. Scores are exact while the lengths of two vectors multiply to less
    than 2^53, else rounded to doubles. Other columns are not looked at; an empty table gives an
    empty result.
    """
    marked = table.select("vec_id", F.lit(0).alias("label"), "v")
    rows = vectors.laid_out(marked)
    sample = vectors.seeds(rows)
    chosen = rows.filter(queries)
    # Blocks of about `QUERY_ROWS` queries, by a hash of the row.
    blocks = max(1, -(-chosen.count() // QUERY_ROWS))
    place = F.pmod(F.xxhash64("row"), F.lit(1 << 30))
    asked = (
        chosen.select("row", "vec_id", "label", "v", "length")
        .mapInArrow(_first_bounds(sample, k), f"{vectors.VECTORS}, least double")
        .select("*", place.alias("place"), (place % blocks).alias("block"))
    )
    reach = F.when((F.col("least") > 0) & (F.col("length") > 0), F.col("least") / F.col("length"))
    asked = asked.withColumn("reach", F.coalesce(reach * (1 - SLACK), F.lit(0.0)))
    found = vectors.past_lanes(rows, asked, "block", searcher(k), FOUND, F.col("reach"))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(embeddings: DataFrame) -> DataFrame:
    """The 5 highest scores of every fiftieth vector."""
    table = embeddings.select("vec_id", vectors.scaled(F.col("embedding")).alias("v"))
    return top_products(table, F.col("vec_id") % 50 == 0)


SQL = """
with rows as (
  select row_number() over () as row, vec_id,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), scored as (
  select q.row, q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from rows q join rows c on q.row <> c.row
  where q.vec_id % 50 = 0
), ranked as (
  select query_id, vec_id, score,
    row_number() over (partition by row order by score desc, vec_id)::int as rank
  from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
