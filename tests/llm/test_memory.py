"""What a Python worker holds does not grow with the rows of a batch."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loanspan.llm import common, langid, neardup


def _texts(n):
    random = np.random.default_rng(3)
    return [" ".join(f"word{w}" for w in random.integers(0, 400, 60)) for _ in range(n)]


def _model():
    counts = np.array([langid.term_counts(t) for t in _texts(40)], np.float32)
    return langid.fit(counts, ["a", "b"] * 20)


def _pairs(texts):
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([ids, ids, pa.array(texts, pa.string()), pa.array(texts, pa.string())], names=["a", "b", "x", "y"])


def _rows(texts):
    return pa.RecordBatch.from_arrays(
        [pa.StructArray.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])],
        names=["row"],
    )


def _columns(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _languages(texts):
    return pa.RecordBatch.from_arrays([pa.array(["a"] * len(texts), pa.string()), pa.array(texts, pa.string())], names=["lang", "text"])


STEPS = {
    "signatures": (lambda: neardup._signatures(5, 128), _columns),
    "confirmed": (lambda: neardup._confirmed(5, 80), _pairs),
    "counts": (lambda: langid._count_batches, _languages),
    "languages": (lambda: langid._predictor(_model()), _rows),
}


def _peak(step, batch):
    tracemalloc.start()
    try:
        for _ in step(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", STEPS)
def test_memory_of_a_worker_does_not_grow_with_the_batch(name):
    make, batch_of = STEPS[name]
    step, texts = make(), _texts(3000)
    few, many = batch_of(texts[:300]), batch_of(texts)
    _peak(step, few)
    assert _peak(step, many) < 2 * _peak(step, few)


@pytest.mark.parametrize("name", ["signatures", "counts", "languages"])
def test_rows_of_a_batch_stay_whole_and_in_order(name):
    make, batch_of = STEPS[name]
    step, texts = make(), [None, "", *_texts(600)]
    whole = pa.Table.from_batches(step(iter([batch_of(texts)])))
    single = pa.Table.from_batches(step(iter([batch_of([t]) for t in texts])))
    assert len(whole) == len(texts)
    column = "row" if name == "languages" else whole.column_names[0]
    assert whole[column].to_pylist() == batch_of(texts).column(0).to_pylist()
    for c in ("n_shingles", "sid", "signature", "counts", "lang_pred", "rejected"):
        if c in whole.column_names:
            assert whole[c].to_pylist() == single[c].to_pylist()


def test_pieces_take_every_row_of_every_batch():
    batches = [_columns(_texts(n)) for n in (0, 1, common.PIECE_ROWS, 0, common.PIECE_ROWS + 1)]
    found = list(common.pieces(iter(batches)))
    assert max(map(len, found)) <= common.PIECE_ROWS
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches(batches))


def test_each_text_goes_to_a_task_once(spark):
    texts = ["the cat and the dog", "le chat et le chien"] * 10
    rows = [(i, t, "en", 0.5, True) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, Text string, lang string, SCORE double, rejected boolean")
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns
    plan = kept._jdf.queryExecution().analyzed().toString()
    struct = next(line for line in plan.split("\n") if "AS row#" in line)
    assert struct.lower().count("text#") == 1
    assert set(kept.collect()) <= set(docs.collect())
