"""Memory of the encoder's and the language model's processes."""

import gc
import tracemalloc

import numpy as np
import pyarrow as pa

from loanspan.llm import bpe, langid


def test_encoding_is_not_held_up_by_searches_for_cycles():
    class Shared:
        value = (
            bpe.Vocabulary({0: "a", 1: "b", 2: "a</w>", 3: "b</w>", 4: "ab</w>"}, {("a", "b</w>"): 0}, {}),
            bpe.Transducer.compile({}).to_bytes(),
        )

    words = ["".join("ab"[i >> k & 1] for k in range(16)) for i in range(40_000)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    row = pa.StructArray.from_arrays([pa.array(texts, pa.string())], names=["text"])
    batch = pa.RecordBatch.from_arrays([row], names=["row"])
    starts = []
    seen = lambda phase, info: starts.append(1) if phase == "start" else None
    bpe._loaded.clear()
    gc.callbacks.append(seen)
    try:
        run = bpe._encode_batches(Shared, ["n", "ids_sha256", "decoded_sha256"])
        counts = [n for out in run(iter([batch])) for n in out.column(1).to_pylist()]
        assert gc.isenabled()
    finally:
        gc.callbacks.remove(seen)
        bpe._loaded.clear()
    assert len(counts) == 400 and min(counts) > 100
    assert len(starts) < 10


def test_training_rows_are_read_where_they_lie():
    random = np.random.default_rng(2)
    counts = random.integers(0, 9, (300, langid.DIMENSIONS)).astype(np.uint16)
    counts[7] = counts[8]
    names = [["da", "en", "zh"][i % 3] for i in range(300)]
    rows = [(n, c.tobytes()) for n, c in zip(names, counts, strict=True)]
    table = lambda part: pa.table({"lang": [n for n, _ in part], "counts": [c for _, c in part]})
    both = pa.concat_tables([table(rows[:100]), table(rows[100:])])
    tracemalloc.start()
    try:
        found, languages = langid._learnable(both)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    expected = sorted(rows)
    assert languages == [n for n, _ in expected]
    assert (found == np.array([np.frombuffer(c, np.uint16) for _, c in expected])).all()
    assert peak < 1.2 * found.nbytes
