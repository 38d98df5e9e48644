"""Top-k search and hard negatives against all pairs."""

import math

import numpy as np
import pyarrow as pa
import pytest

from loanspan.llm import negatives, topk, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, row int, lane string, length string, block int, place int, least int"


def embeddings(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, 3, 4) for r in rows], SCHEMA)


def whole(vector):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(256 * float(np.float32(x))) for x in vector]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=False))


def all_top(rows):
    kept = [(i, w) for i, v, _ in rows if i is not None and (w := whole(v)) is not None]
    found = []
    for n, (i, a) in enumerate(kept):
        if i % 50 == 0:
            best = sorted((-dot(a, b), j) for m, (j, b) in enumerate(kept) if m != n)[:5]
            found += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(found)


def all_negatives(rows):
    kept = [
        (i, w, (y + 1) % 10 if i % 7 == 0 else y)
        for i, v, y in rows
        if i is not None and y is not None and (w := whole(v)) is not None
    ]
    found = []
    for n, (i, a, label) in enumerate(kept):
        if i % 100:
            continue
        scored = [(-dot(a, b), j, y) for m, (j, b, y) in enumerate(kept) if m != n]
        for p, j, _ in sorted(x for x in scored if x[2] == label)[:5]:
            window = sorted(x for x in scored if x[2] != label and -30 * p <= -100 * x[0] <= -90 * p)
            found += [(i, j, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(window[:10])]
    return sorted(found)


def clustered(random, n, dims=16, noise=0.4):
    """Rows of ten clusters; many of one vector, ties, nulls, odd components and lengths."""
    centers = random.normal(size=(10, dims))
    rows = []
    for i in range(n):
        label = int(random.integers(0, 10))
        v = centers[label] + noise * random.normal(size=dims)
        v = (v / np.linalg.norm(v) * random.choice([1.0, 1.0, 0.3, 2.5])).tolist()
        if i % 3 == 0:
            v, label = centers[0].tolist(), 0
        rows.append((i * 10 if i % 2 else i, v, label))
    rows += [
        (50, None, 1), (None, [0.1] * dims, 1), (100, [0.1, None], 1), (200, [float("nan")] * dims, 2),
        (300, [float("inf")] * dims, 2), (400, [0.5] * dims, None), (500, [], 3), (600, [0.0] * dims, 3),
        (700, [1.0] * 3, 4), (700, [1.0] * 3, 4), (800, [-2.0] * dims, 5), (800, [-1.0] * (dims + 3), 5),
        (900, centers[0].tolist(), 6),
    ]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_search_and_negatives_equal_all_pairs(spark, seed):
    rows = clustered(np.random.default_rng(seed), 700)
    table = embeddings(spark, rows)
    assert sorted(map(tuple, topk.query(table).collect())) == all_top(rows)
    assert sorted(map(tuple, negatives.query(table).collect())) == all_negatives(rows)


def test_few_rows(spark):
    for rows in ([], [(0, [1.0, 0.5], 3)], [(0, [1.0, 0.5], 3), (100, [0.2, 0.7], 3), (1, [0.5, 0.5], 4)]):
        table = embeddings(spark, rows)
        assert sorted(map(tuple, topk.query(table).collect())) == all_top(rows)
        assert sorted(map(tuple, negatives.query(table).collect())) == all_negatives(rows)


def test_lanes_split_rows_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LANE_LEAST", 100)
    rows = [(i, [1.0, 0.0], 0) for i in range(2000)]
    table = embeddings(spark, rows).select("vec_id", "label", vectors.scaled("embedding").alias("v"))
    counts = [r["count"] for r in vectors.laid_out(table).groupBy("lane").count().collect()]
    assert len(counts) == 4 and max(counts) < 1000


def rows_of(v, ids=None, **columns):
    n = len(v)
    return vectors.Rows(
        [
            pa.RecordBatch.from_pydict(
                {
                    "row": np.arange(n) if ids is None else ids,
                    "vec_id": np.arange(n) if ids is None else ids,
                    "label": columns.pop("label", np.zeros(n, np.int64)),
                    "length": np.sqrt((v**2).sum(1)),
                    "v": pa.array(v.astype(int).tolist(), pa.list_(pa.int32())),
                    **columns,
                }
            )
        ]
    )


def test_both_prunings_are_exact_and_leave_rows_out(monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 300)
    random = np.random.default_rng(4)
    v = np.floor(256 * random.normal(size=(3000, 12)))
    v[:40] = v[0] + random.integers(-9, 9, (40, 12))
    v = v[np.argsort(-np.sqrt((v**2).sum(1)), kind="stable")]
    looked, multiplied = [], []
    in_ranges, products = topk.Bucket.in_ranges, vectors.products

    def counted_ranges(self, *args):
        rows = in_ranges(self, *args)
        looked.append(rows)
        return rows

    def counted(a, b, bound):
        multiplied.append(len(a) * len(b))
        return products(a, b, bound)

    monkeypatch.setattr(topk.Bucket, "in_ranges", counted_ranges)
    monkeypatch.setattr(vectors, "products", counted)
    lane = rows_of(v)
    near = np.flatnonzero(np.abs(v - v[:1]).max(1) < 1e9)[:200]
    asked = rows_of(v[near], near, least=np.full(len(near), -np.inf))
    (batch,) = topk.searcher(5)(lane, asked)
    got = sorted(zip(*[batch[c].to_pylist() for c in ("query_id", "score", "vec_id")], strict=True))
    expected = []
    for q in near:
        score = v @ v[q]
        best = sorted((-s, i) for i, s in enumerate(score) if i != q)[:5]
        expected += [(q, int(-s), i) for s, i in best]
    assert got == sorted(expected)
    assert any(x is not None for x in looked)
    assert sum(multiplied) < 0.8 * len(near) * len(v)


def test_tree_bounds_hold_and_save_scores():
    random = np.random.default_rng(6)
    centers = 100 * random.normal(size=(4, 20))
    v = np.floor(np.repeat(centers, 300, 0) + 20 * random.normal(size=(1200, 20)))
    some = np.floor(np.repeat(centers, 8, 0) + 6 * random.normal(size=(32, 20)))
    order, parent, edge = negatives.spanning_tree(some)
    assert sorted(order) == list(range(32)) and parent[0] == -1 and (parent[1:] < np.arange(1, 32)).all()
    lengths = [np.linalg.norm(some[order[k]] - some[order[parent[k]]]) for k in range(1, 32)]
    assert np.allclose(edge[1:], lengths)
    # Kruskal's tree is as long.
    pairs = sorted((np.linalg.norm(some[i] - some[j]), i, j) for i in range(32) for j in range(i))
    root, total = list(range(32)), 0.0
    for d, i, j in pairs:
        while root[i] != i:
            i = root[i]
        while root[j] != j:
            j = root[j]
        if i != j:
            root[i], total = j, total + d
    assert np.isclose(edge.sum(), total)

    lane = rows_of(v[np.argsort(-np.sqrt((v**2).sum(1)))])
    anchors = rows_of(some[order], np.arange(32) + 9000, parent=parent, edge=edge)
    truth = anchors.v @ lane.v.T
    calls, scored = [], 0

    def wanted(k, part, low, high):
        assert (low <= truth[k, part] + 1e-9).all() and (truth[k, part] <= high + 1e-9).all()
        return high >= np.sort(truth[k])[-20]

    def found(k, rows, score):
        nonlocal scored
        scored += len(rows)
        assert (score == truth[k, rows]).all()
        calls.append((k, set(rows.tolist())))

    tree = negatives.Tree(anchors)
    tree.walk(lane, wanted, found)
    for k in range(32):
        got = set().union(*[rows for c, rows in calls if c == k])
        assert set(np.argsort(-truth[k])[:20]) <= got
    assert scored < 0.5 * truth.size


def test_large_components_stay_whole():
    a = np.array([[vectors.LARGEST, 3.0]])
    assert vectors.products(a, a, float((a**2).sum()))[0, 0] == vectors.LARGEST**2 + 9


def test_scaled(spark):
    rows = [([1.0, -0.001],), ([None],), (None,), ([float("nan")],), ([float("-inf")],), ([],), ([1e30, -1e30],)]
    df = spark.createDataFrame(rows, "e array<double>").select(vectors.scaled("e").alias("v"))
    top = vectors.LARGEST
    assert [r["v"] for r in df.collect()] == [[256, -1], None, None, None, None, [], [top, -top]]
