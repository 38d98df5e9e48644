"""Hard negatives by score bounds along spanning trees of anchors.

Anchors are dealt into trees of near ones: each goes to its most similar sampled vector, and
stretches of at most `TREE_ANCHORS` in that order get a minimum spanning tree over their distances,
written once. Each tree passes every lane of rows (`vectors.py`). At the root a bucket's scores are
computed. At a child, a row's score is its score at the parent plus or minus the length of the tree's
edge times the row's length; only rows whose interval overlaps what the child still looks for are
scored again, the others hand their interval on.

Two passes: the first looks for the positives, each anchor's highest scores of its own label, the
second for its highest scores of other labels within the window of each positive. What an anchor
looks for narrows as results come in: a row below the last result that counts is not wanted. First
bounds of the positives come from a bounded sample. Scores returned are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanspan.llm import vectors
from loanspan.llm.common import written

#: Positives of an anchor, and negatives of an anchor and positive.
POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's: from, to.
WINDOW = (30, 90)
#: Anchors of a tree and rows of a bucket at most.
TREE_ANCHORS = 256
BUCKET_ROWS = 4096
#: Share of a bucket above which all its rows are scored, in one product.
DENSE = 0.3
#: Slack of bounds, against rounding.
SLACK = 1e-6

POSITIVE = "row bigint, anchor_id bigint, positive_id bigint, score bigint"
NEGATIVE = "row bigint, low double, high double, negative_id bigint, score bigint"


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows of `v`, each behind its parent; parent's place and distance, by order.

    Minimum spanning tree from row 0; the root's parent is -1 and its distance 0.
    """
    n = len(v)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near = np.sqrt(((v - v[0]) ** 2).sum(1))
    source, free = np.zeros(n, np.int64), np.ones(n, bool)
    free[0] = False
    for k in range(1, n):
        i = int(np.argmin(np.where(free, near, np.inf)))
        order[k], parent[k], edge[k], free[i] = i, source[i], near[i], False
        far = np.sqrt(((v - v[i]) ** 2).sum(1))
        closer = far < near
        near, source = np.where(closer, far, near), np.where(closer, k, source)
    return order, parent, edge


def _planted(sample):
    """Anchors in trees: `block` and `place` in it, place of the parent, distance, first bound."""

    def run(batches):
        waiting, tree = [], 0

        def tree_of(batch):
            nonlocal tree
            anchors = vectors.Rows([batch])
            order, parent, edge = spanning_tree(anchors.v)
            least = np.full(len(anchors), -np.inf)
            if sample is not None:
                bound = float(anchors.length.max() * sample["length"].max())
                score = vectors.products(anchors.v, sample["v"], bound).astype(np.float64)
                score[anchors.label[:, None] != sample["label"][None, :]] = -np.inf
                score[anchors.row[:, None] == sample["row"][None, :]] = -np.inf
                if score.shape[1] >= POSITIVES:
                    least = np.partition(score, -POSITIVES, 1)[:, -POSITIVES]
            tree += 1
            batch = batch.take(pa.array(order))
            n = len(order)
            return pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.full(n, tree, np.int64)),
                    pa.array(np.arange(n)),
                    pa.array(parent),
                    pa.array(edge),
                    pa.array(least[order]),
                ],
                names=[*batch.schema.names, "block", "place", "parent", "edge", "least"],
            )

        for batch in batches:
            waiting.append(batch)
            while (size := sum(b.num_rows for b in waiting)) >= TREE_ANCHORS:
                whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                yield tree_of(whole.slice(0, TREE_ANCHORS))
                waiting = [whole.slice(TREE_ANCHORS)] if size > TREE_ANCHORS else []
        if sum(b.num_rows for b in waiting):
            yield tree_of(pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    return run


def _nearest(sample):
    """`near`: the sampled vector of the highest score."""

    def run(batches):
        for batch in batches:
            near = np.zeros(batch.num_rows, np.int64)
            if batch.num_rows and sample is not None:
                anchors = vectors.Rows([batch])
                bound = float(anchors.length.max() * sample["length"].max())
                near = vectors.products(anchors.v, sample["v"], bound).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near)], names=[*batch.schema.names, "near"])

    return run


def planted(rows: DataFrame, anchors: Column) -> DataFrame:
    """The rows that `anchors` marks, in trees; written once, so that both passes see the same."""
    sample = vectors.seeds(rows)
    chosen = rows.filter(anchors).drop("lane")
    parts = max(1, min(-(-chosen.count() // TREE_ANCHORS), 1 << 14))
    trees = (
        chosen.mapInArrow(_nearest(sample), f"{vectors.VECTORS}, near bigint")
        .repartitionByRange(parts, "near", F.xxhash64("row"))
        .sortWithinPartitions("near", "row")
        .drop("near")
        .mapInArrow(
            _planted(sample),
            f"{vectors.VECTORS}, block bigint, place bigint, parent bigint, edge double, least double",
        )
    )
    # Trees are numbered from 1 in each partition.
    number = F.spark_partition_id().cast("bigint") * F.lit(1 << 40) + F.col("block")
    return written(trees.withColumn("block", number))


class Tree:
    """Walks a tree of anchors past buckets of a lane and scores the rows that are wanted."""

    def __init__(self, anchors: vectors.Rows):
        self.anchors = anchors
        self.parent = np.array(anchors.column("parent"))
        self.edge = np.array(anchors.column("edge"))
        #: Place of the last child of each anchor: behind it, its intervals are not needed.
        self.last = np.arange(len(anchors))
        np.maximum.at(self.last, self.parent[1:], np.arange(1, len(anchors)))

    def walk(self, lane: vectors.Rows, wanted, found) -> None:
        """Call `found(place, rows, scores)` with all rows of which `wanted(place, rows, low, high)` says so.

        `wanted` gets a slice of the lane's rows with bounds of their scores and returns a mask.
        """
        a = self.anchors
        bound = float(a.length.max() * lane.length.max(initial=0))
        for start in range(0, len(lane), BUCKET_ROWS):
            part = slice(start, min(start + BUCKET_ROWS, len(lane)))
            v, length, held = lane.v[part], lane.length[part], {}
            for k in range(len(a)):
                if k == 0:
                    low = high = None
                    mask = np.ones(len(v), bool)
                else:
                    low, high = held[self.parent[k]]
                    move = self.edge[k] * length * (1 + SLACK) + SLACK * (self.edge[k] > 0)
                    low, high = low - move, high + move
                    mask = wanted(k, part, low, high)
                share = np.count_nonzero(mask)
                if share > DENSE * len(v):
                    score = vectors.products(a.v[k : k + 1], v, bound)[0].astype(np.float64)
                    low = high = score
                    rows = np.flatnonzero(wanted(k, part, low, high))
                    score = score[rows]
                elif share:
                    rows = np.flatnonzero(mask)
                    score = vectors.products(a.v[k : k + 1], v[rows], bound)[0].astype(np.float64)
                    low[rows] = high[rows] = score
                    good = wanted(k, part, low, high)[rows]
                    rows, score = rows[good], score[good]
                if share and len(rows):
                    found(k, start + rows, score)
                held[k] = low, high
                for done in {k, int(self.parent[k])} - {-1}:
                    if self.last[done] <= k:
                        held.pop(done, None)


def _first(score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return some[np.lexsort((vec_id[some], -score[some]))[:k]]
    return np.lexsort((vec_id, -score))[:k]


def _joined(held: tuple | None, score: np.ndarray, vec_id: np.ndarray, k: int) -> tuple:
    if held is not None:
        score, vec_id = np.concatenate([held[0], score]), np.concatenate([held[1], vec_id])
    best = _first(score, vec_id, k)
    return score[best], vec_id[best]


def _positives(lane: vectors.Rows, anchors: vectors.Rows):
    """Highest scores of the anchors' own labels in a lane."""
    least, best = np.array(anchors.column("least"), np.float64), {}

    def wanted(k, part, low, high):
        return (
            (lane.label[part] == anchors.label[k]) & (lane.row[part] != anchors.row[k]) & (high >= least[k])
        )

    def found(k, rows, score):
        best[k] = _joined(best.get(k), score, lane.vec_id[rows], POSITIVES)
        if len(best[k][0]) == POSITIVES:
            least[k] = max(least[k], best[k][0][-1])

    Tree(anchors).walk(lane, wanted, found)
    rows = [
        (anchors.row[k], anchors.vec_id[k], i, s)
        for k, (score, vec_id) in best.items()
        for s, i in zip(score, vec_id, strict=True)
    ]
    yield _batch(rows, [np.int64] * 4, ["row", "anchor_id", "positive_id", "score"])


def _negatives(lane: vectors.Rows, anchors: vectors.Rows):
    """Highest scores of other labels in a lane, in each window of the anchors."""
    windows = [[(w["low"], w["high"]) for w in ws] for ws in anchors.column("windows")]
    least = [[low for low, _ in ws] for ws in windows]
    best: dict = {}

    def wanted(k, part, low, high):
        mask = np.zeros(len(low), bool)
        for (_, top), bottom in zip(windows[k], least[k], strict=True):
            mask |= (high >= bottom) & (low <= top)
        return mask & (lane.label[part] != anchors.label[k])

    def found(k, rows, score):
        vec_id = lane.vec_id[rows]
        for w, (_, top) in enumerate(windows[k]):
            inside = (score >= least[k][w]) & (score <= top)
            if inside.any():
                held = best[k, w] = _joined(best.get((k, w)), score[inside], vec_id[inside], NEGATIVES)
                if len(held[0]) == NEGATIVES:
                    least[k][w] = max(least[k][w], held[0][-1])

    Tree(anchors).walk(lane, wanted, found)
    rows = [
        (anchors.row[k], *windows[k][w], i, s)
        for (k, w), (score, vec_id) in best.items()
        for s, i in zip(score, vec_id, strict=True)
    ]
    yield _batch(rows, [np.int64, float, float, np.int64, np.int64], ["row", "low", "high", "negative_id", "score"])


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(c, k)) for c, k in zip(columns, kinds, strict=True)], names=names
    )


def hard_negatives(table: DataFrame, anchors: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `table` has vec_id, label and v, an array of whole numbers; `anchors` marks the anchors. An
    anchor's positives are its `POSITIVES` highest other rows of the same label; for each, the
    `NEGATIVES` highest rows of other labels are returned whose score is within `WINDOW` hundredths
    of the positive's. Ties go to the smaller vec_id; a negative positive score has an empty
    window. Rows without id, label or vector take no part. Rows that share an id are rows of their
    own, as anchors and as candidates. Missing components of shorter vectors count as zero. Scores
    are exact while the lengths of two vectors multiply to less than 2^53, else rounded to doubles.
    Other columns are not looked at; an empty table gives an empty result.
    """
    rows = vectors.laid_out(table.filter("label is not null").select("vec_id", "label", "v"))
    trees = planted(rows, anchors)
    found = vectors.past_lanes(rows, trees, "block", _positives, POSITIVE)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id")
    positives = written(
        found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= POSITIVES)
    )
    # Whole scores s with WINDOW[0] * p <= 100 * s <= WINDOW[1] * p, for the positive's score p.
    least, most = WINDOW
    windowed = positives.filter("score >= 0").selectExpr(
        "*",
        f"cast(({least} * score + 99) div 100 as double) as low",
        f"cast({most} * score div 100 as double) as high",
    )
    windowed = windowed.filter("low <= high")
    windows = windowed.groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("windows"))
    # Anchors without a window stay: their children's bounds hang on them.
    asked = trees.join(windows, "row", "left").withColumn(
        "windows", F.coalesce("windows", F.array().cast("array<struct<low:double,high:double>>"))
    )
    negatives = vectors.past_lanes(rows, asked, "block", _negatives, NEGATIVE)
    order = Window.partitionBy("row", "low", "high").orderBy(F.desc("negative_score"), "negative_id")
    ranked = (
        negatives.withColumnRenamed("score", "negative_score")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= NEGATIVES)
    )
    return (
        windowed.withColumnRenamed("score", "positive_score")
        .join(ranked, ["row", "low", "high"])
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )


def query(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has the next label."""
    label = F.col("label")
    table = embeddings.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        vectors.scaled(F.col("embedding")).alias("v"),
    )
    return hard_negatives(table, F.col("vec_id") % 100 == 0)


SQL = """
with rows as (
  select row_number() over () as row, vec_id,
    case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0
), scored as (
  select a.row, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    list_dot_product(a.v, c.v)::bigint as score
  from rows a join rows c on a.row <> c.row
  where a.vec_id % 100 = 0
), positives as (
  select row, anchor_id, vec_id as positive_id, score as positive_score,
    row_number() over (partition by row order by score desc, vec_id) as n
  from scored where same
), ranked as (
  select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id,
    s.score as negative_score,
    row_number() over (partition by p.row, p.n order by s.score desc, s.vec_id)::int as rank
  from positives p join scored s on p.row = s.row and not s.same
    and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
  where p.n <= 5
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score
from ranked where rank <= 10
"""
