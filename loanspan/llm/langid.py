"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of its hashed character 1- to 3-grams. Each language has
several centroids, the clusters of its training vectors, and the nearest one by cosine names the
language. A text further from it than the centroid's radius is rejected. How wide radii are is
learned from texts left out of training, with and without the centroids of their own language.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanspan.llm.common import pieces, replacing, written

DIMENSIONS = 4096
ORDERS = 3
#: At most this many documents of each language and in all, picked by a hash of id and text, are
#: learned from.
TRAIN_DOCS_PER_LANGUAGE = 500
TRAIN_DOCS = 8000
CLUSTERS = 4
ROUNDS = 12
#: A centroid's radius is this quantile of its members' distances, and a share of the way from
#: there to the distance of orthogonal vectors, the slack. The slack is learned, see _slack().
RADIUS_QUANTILE = 0.99
#: Parts of the training texts, each judged by a model of the others; the slack passes at least
#: this share of them.
FOLDS = 3
LEAST_PASSED = 0.99
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def term_counts(text: str | None) -> np.ndarray | None:
    """Counts of the text's hashed n-grams; None if it has no letter.

    Letters are taken in lower case, every run of other characters as one space.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    codes = np.where(letter, codes, np.uint32(32))
    codes = np.concatenate(([32], codes[letter | np.concatenate(([True], letter[:-1]))], [32]))
    counts = np.zeros(DIMENSIONS)
    h = np.zeros(len(codes), np.uint64)
    for n in range(ORDERS):
        part = codes[n:].astype(np.uint64)
        h = (h[: len(part)] + part + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=DIMENSIONS)
    return counts


@dataclass
class Model:
    """idf, centroids (rows), and the language and radius of each centroid."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    radii: np.ndarray

    def predict(self, counts: list[np.ndarray | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine, rejected) of each text."""
        result: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(counts)
        places = [i for i, c in enumerate(counts) if c is not None]
        if not places or not self.languages:
            return result
        cosines = _vectors(np.array([counts[i] for i in places]), self.idf) @ self.centroids.T
        for i, row in zip(places, cosines, strict=True):
            best = int(row.argmax())
            cosine = min(max(float(row[best]), 0.0), 1.0)
            result[i] = (self.languages[best], cosine, 1 - cosine > self.radii[best])
        return result


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts) * idf
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)


def _clusters(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart rows: centroids and each row's centroid."""
    total = vectors.sum(axis=0)
    chosen = [int((vectors @ total).argmax())]
    nearest = vectors @ vectors[chosen[0]]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(ROUNDS):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.array([vectors[own == j].sum(axis=0) for j in range(len(centroids))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    return centroids, (vectors @ centroids.T).argmax(axis=1)


def _edges(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language's vectors, and the quantile of distances of each one's members."""
    centres, own = _clusters(vectors, CLUSTERS)
    used = [j for j in range(len(centres)) if (own == j).any()]
    edges = [np.quantile(1 - vectors[own == j] @ centres[j], RADIUS_QUANTILE) for j in used]
    return centres[used], np.array(edges)


def _needed(vectors: np.ndarray, centroids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The least slack with which each vector passes."""
    cosines = vectors @ centroids.T
    best = cosines.argmax(axis=1)
    distance = 1 - cosines[np.arange(len(best)), best]
    return (distance - edges[best]) / np.maximum(1 - edges[best], 1e-9)


def _slack(known: np.ndarray, foreign: np.ndarray) -> float:
    """The slack that tells best the texts of known languages from those of languages not learned,
    by what each text needs; the middle of the gap, and at least LEAST_PASSED of the known pass."""
    if not len(known):
        return 0.0
    floor = max(float(np.quantile(known, LEAST_PASSED, method="higher")), 0.0)
    if not len(foreign):
        return min(floor, 1.0)
    cuts = np.unique(np.concatenate((known[known > floor], foreign[foreign > floor], [floor])))
    lost = 1 - np.searchsorted(np.sort(known), cuts, side="right") / len(known)
    passed = np.searchsorted(np.sort(foreign), cuts, side="right") / len(foreign)
    best = int((lost + passed).argmin())
    return min(float(cuts[best : best + 2].mean()), 1.0)


def fit(counts: np.ndarray, languages: list[str]) -> Model:
    """Model of labelled term counts, one row for each text."""
    if not languages:
        return Model(np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), [], np.zeros(0))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    labels = np.array(languages)
    # Equal texts are in the same part.
    folds = np.array([crc32(row.tobytes()) % FOLDS for row in counts])
    names, centroids, edges = [], [], []
    parts: list[list[tuple]] = [[] for _ in range(FOLDS)]
    for name in sorted(set(languages)):
        own = labels == name
        vectors = _vectors(counts[own], idf)
        centres, edge = _edges(vectors)
        names += [name] * len(centres)
        centroids.append(centres)
        edges.append(edge)
        for part in range(FOLDS):
            rest = vectors[folds[own] != part]
            if len(rest):
                centres, edge = _edges(rest)
                parts[part].append(([name] * len(centres), centres, edge))
    known, foreign = [np.zeros(0)], [np.zeros(0)]
    for part, found in enumerate(parts):
        if not found:
            continue
        of = np.array([name for owners, _, _ in found for name in owners])
        centres, edge = np.concatenate([c for _, c, _ in found]), np.concatenate([e for _, _, e in found])
        for name in sorted(set(languages)):
            held = counts[(labels == name) & (folds == part)]
            other = of != name
            if not len(held):
                continue
            vectors = _vectors(held, idf)
            if not other.all():
                known.append(_needed(vectors, centres, edge))
            if other.any():
                foreign.append(_needed(vectors, centres[other], edge[other]))
    edge = np.concatenate(edges)
    radii = edge + _slack(np.concatenate(known), np.concatenate(foreign)) * (1 - edge)
    return Model(idf.astype(np.float32), np.concatenate(centroids).astype(np.float32), names, radii)


def _count_batches(batches):
    for batch in pieces(batches):
        found = [term_counts(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([None if c is None else np.minimum(c, 65535).astype(np.uint16).tobytes() for c in found], pa.binary()),
            ],
            names=["lang", "counts"],
        )


def _learnable(rows: pa.Table) -> tuple[np.ndarray, list[str]]:
    """Counts and languages of the rows, the same whatever the order of arrival.

    The driver reads them where Arrow holds them, and then gives that memory back.
    """
    order = pc.sort_indices(rows, [("lang", "ascending"), ("counts", "ascending")])
    counts = np.zeros((rows.num_rows, DIMENSIONS), np.float32)
    found = rows["counts"]
    for place, i in enumerate(order):
        counts[place] = np.frombuffer(found[i.as_py()].as_buffer(), np.uint16)
    languages = rows["lang"].take(order).to_pylist()
    del rows, found, order
    pa.default_memory_pool().release_unused()
    return counts, languages


def held_out(doc_id):
    """Documents that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Model of the documents with lang that are not held out.

    Of each language TRAIN_DOCS_PER_LANGUAGE documents at most are learned from, fewer where that
    makes more than TRAIN_DOCS in all, but one of each language. They are those with the smallest
    hash of id and text, so neither null nor repeated ids change the bound, and repeated rows count
    once. Vectors are counted on executors and only they reach the driver, 8 KB each; counts stop
    at 65,535.
    """
    keyed = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("key")
    )
    sizes = written(keyed.groupBy("lang").agg(F.approx_count_distinct("key").alias("size")))
    languages = sizes.count()
    if not languages:
        return fit(np.zeros((0, DIMENSIONS)), [])
    most = max(1, min(TRAIN_DOCS_PER_LANGUAGE, TRAIN_DOCS // languages))
    # Enough rows of small hash for `most` of every language, then exactly so many.
    place = F.pmod("key", F.lit(10**12))
    enough = place.cast("double") * F.col("size") < 1e12 * (2 * most + 20)
    by_hash = Window.partitionBy("lang").orderBy(place, "key")
    picked = (
        keyed.join(F.broadcast(sizes) if languages <= TRAIN_DOCS else sizes, "lang")
        .filter(enough)
        .dropDuplicates(["lang", "key"])
        .withColumn("place", F.row_number().over(by_hash))
        .filter(F.col("place") <= most)
    )
    return fit(
        *_learnable(
            picked.select("lang", "text")
            .mapInArrow(_count_batches, "lang string, counts binary")
            .filter("counts IS NOT NULL")
            .toArrow()
        )
    )


def _predictor(model: Model):
    def run(batches):
        for batch in pieces(batches):
            texts = batch.column(0).field("text").to_pylist()
            found = model.predict([term_counts(t) for t in texts])
            language, score, rejected = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(language, pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(rejected, pa.bool_()),
                ],
                names=["row", "lang_pred", "score", "rejected"],
            )

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score and rejected, in place of columns of these names.

    A null text or one without letters is `und` with score 0, and rejected. The score is the
    cosine to the nearest centroid. A model that learned nothing says `und` to all. Nothing but
    the text is looked at; null ids and repeated rows pass through.
    """
    row = docs.select(F.struct("*").alias("row"))
    kind = row.schema["row"].dataType.simpleString()
    found = row.mapInArrow(
        _predictor(model), f"row {kind}, lang_pred string, score double, rejected boolean"
    )
    kept = found.select("row.*", *[F.col(c).alias(f"__{c}") for c in ("lang_pred", "score", "rejected")])
    return replacing(
        kept, {c: F.col(f"__{c}") for c in ("lang_pred", "score", "rejected")}
    ).drop("__lang_pred", "__score", "__rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """`docs` without those whose language is rejected; the model is trained on `docs`."""
    # Each text goes to a task once, whatever the columns beside it are called.
    text = "text" if "text" in docs.columns else next(c for c in docs.columns if c.lower() == "text")
    own = {c: "text" if c == text else f"__own_{i}" for i, c in enumerate(docs.columns)}
    frame = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    found = identify(frame, train(docs)).filter("NOT rejected")
    return found.select(*[F.col(n).alias(c) for c, n in own.items()])


def query(docs: DataFrame) -> DataFrame:
    """Language of each document."""
    return identify(docs.select("doc_id", "text"), train(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected"
    )
