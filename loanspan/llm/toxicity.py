"""Toxicity scores from subword-bag embeddings.

Every character 3- to 6-gram of a word, word ends included, has an embedding. A text is the
average of its subwords' embeddings, weighted by the logarithm of their counts and scaled to unit
weight length, under a linear softmax. Embeddings and softmax are trained jointly in numpy, so a
misspelling shares vectors with the words that it resembles.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
NGRAMS = (3, 4, 5, 6)
DIMENSIONS = 8
#: This many labelled documents at most, those with the smallest hash of the id, are learned from.
TRAIN_DOCS = 6000
BATCH = 32
EPOCHS = 6
#: Small samples are seen more often, until this many steps.
MIN_STEPS = 600
RATE = 0.05
DECAY = 3e-4
#: Every fifth labelled text only serves to move the logits, so that the best cut is THRESHOLD.
CALIBRATION = 5
MAX_SHIFT = 2.5
#: A text without evidence scores this at most.
MAX_PRIOR = 0.15
THRESHOLD = 0.3


@cache
def _word_chars() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's subwords, ascending, and their counts."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    inside = _word_chars()[codes]
    codes = np.where(inside, codes, np.uint32(32))
    keep = inside | np.concatenate(([False], inside[:-1])) if len(codes) else inside
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    space = codes == 32
    total = np.zeros(BUCKETS, np.int64)
    h = np.zeros(len(codes), np.uint64)
    done = 0
    for n in NGRAMS:
        while done < n:
            h = (h[: max(len(codes) - done, 0)] + codes[done:] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            done += 1
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1]
        crossing = np.zeros(len(h), bool)
        for i in range(1, n - 1):
            crossing |= space[i : i + len(h)]
        total += np.bincount((h[~crossing] >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found.astype(np.uint16), np.minimum(total[found], 65535).astype(np.uint16)


def _weights(counts: np.ndarray) -> np.ndarray:
    w = np.log1p(counts.astype(np.float32))
    return w / max(float(np.sqrt((w * w).sum())), 1e-12)


@dataclass
class Model:
    """Each bucket's share of the logit (its embedding times the softmax weights), and the bias."""

    logits: np.ndarray
    bias: float

    def score(self, found: tuple[np.ndarray, np.ndarray]) -> float:
        buckets, counts = found
        logit = self.bias + float(self.logits[buckets] @ _weights(counts)) if len(buckets) else self.bias
        return float(1 / (1 + np.exp(-logit)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int]) -> Model:
    """Train on the bags of labelled texts and calibrate; none give a model that scores 0.05."""
    order = np.random.default_rng(5).permutation(len(bags))
    learn, check = order[np.arange(len(bags)) % CALIBRATION > 0], order[::CALIBRATION]
    if not len(learn):
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(0.05 / 0.95)))
    model = _trained([bags[i] for i in learn], np.array([labels[i] for i in learn]))
    model.bias += _shift([model.score(bags[i]) for i in check], [labels[i] for i in check])
    model.bias = min(model.bias, float(np.log(MAX_PRIOR / (1 - MAX_PRIOR))))
    return model


def _shift(scores: list[float], labels: list[int]) -> float:
    """What moves the logit of the cut with the best F1 to that of THRESHOLD."""
    logit = lambda p: float(np.log(p) - np.log1p(-p))
    values, truth = np.clip(np.array(scores), 1e-6, 1 - 1e-6), np.array(labels)
    cuts = np.geomspace(0.03, 0.6, 60)
    hits = np.array([2 * truth[values >= c].sum() / max((values >= c).sum() + truth.sum(), 1) for c in cuts])
    if not hits.any():
        return 0.0
    best = cuts[hits >= hits.max() - 1e-9]
    return float(np.clip(logit(THRESHOLD) - logit(float(np.sqrt(best[0] * best[-1]))), -MAX_SHIFT, MAX_SHIFT))


def _trained(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    random = np.random.default_rng(11)
    vectors = random.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = random.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    rate = min(max(float(y.mean()), 0.01), 0.99)
    bias = np.array([0, np.log(rate / (1 - rate))], np.float32)
    seen = [np.full_like(x, 1e-6) for x in (vectors, weights, bias)]
    per_epoch = -(-len(bags) // BATCH)
    for _ in range(max(EPOCHS, -(-MIN_STEPS // per_epoch))):
        order = random.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            chosen = order[i : i + BATCH]
            n = len(chosen)
            index = np.concatenate([bags[j][0] for j in chosen]).astype(np.int64)
            weight = np.concatenate([_weights(bags[j][1]) for j in chosen])
            row = np.repeat(np.arange(n), [len(bags[j][0]) for j in chosen])
            parts = vectors[index] * weight[:, None]
            hidden = np.stack([np.bincount(row, p, n) for p in parts.T], 1)
            z = hidden @ weights + bias
            error = np.exp(z - z.max(axis=1, keepdims=True))
            error /= error.sum(axis=1, keepdims=True)
            error[np.arange(n), y[chosen]] -= 1
            error /= n
            back = (error @ weights.T)[row] * weight[:, None]
            touched, place = np.unique(index, return_inverse=True)
            gradient = np.stack([np.bincount(place, b, len(touched)) for b in back.T], 1)
            gradient += DECAY * vectors[touched]
            seen[0][touched] += gradient**2
            vectors[touched] -= RATE * gradient / np.sqrt(seen[0][touched])
            for value, grad, sums in ((weights, hidden.T @ error, seen[1]), (bias, error.sum(0), seen[2])):
                sums += grad**2
                value -= RATE * grad / np.sqrt(sums)
    return Model(vectors @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0]))


def held_out(doc_id):
    """Documents whose labels no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _bag_batches(batches):
    for batch in batches:
        bags = [subwords(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([b.tobytes() for b, _ in bags], pa.binary()),
                pa.array([c.tobytes() for _, c in bags], pa.binary()),
            ],
            names=["toxic", "buckets", "counts"],
        )


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of TRAIN_DOCS labelled documents at most that are not held out.

    Bags are counted on executors; only they reach the driver, one for each picked id, at most 256
    KB each and about 12 KB on average. Of several texts of one id, the one with the smallest hash
    is learned from, however many rows have that id. Labels without id or value are left out; of
    several labels the larger counts. No labels, or none of a known document, give a model without
    evidence. Counts of a subword stop at 65,535.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    total = known.count()
    # Enough ids of small hash at any size, then exactly so many.
    place = F.pmod(F.xxhash64("doc_id"), F.lit(10**12))
    enough = place.cast("double") * total < 1e12 * (2 * TRAIN_DOCS + 20)
    picked = known.filter(enough).orderBy(place, "doc_id").limit(TRAIN_DOCS)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("toxic", "text")
        .mapInArrow(_bag_batches, "toxic int, buckets binary, counts binary")
        .toArrow()
        .to_pydict()
    )
    order = sorted(range(len(rows["toxic"])), key=lambda i: (rows["buckets"][i], rows["toxic"][i]))
    part = lambda name, i: np.frombuffer(rows[name][i], np.uint16)
    return fit(
        [(part("buckets", i), part("counts", i)) for i in order], [rows["toxic"][i] for i in order]
    )


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            scores = [model.score(subwords(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of each row of `docs`.

    Null and empty texts, and texts without letters and digits, have the score of no evidence.
    Only the text is looked at; null ids and repeated rows are scored like others.
    """
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        _scorer(model), "doc_id bigint, score double"
    )
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of each document."""
    return scores(docs, train(docs, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )
