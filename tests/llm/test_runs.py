"""Periodic runs against a search by definition."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from loanspan.llm import runs
from tests.llm.conftest import documents


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[p:], strict=False)))


def by_definition(words, least=12):
    """Runs (start, length, period) by trying every period at every place."""
    n, found = len(words), set()
    for p in range(1, n // 2 + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            length = e + p - s
            if length >= max(least, 2 * p) and smallest_period(words[s : s + length]) == p:
                found.add((s, length, p))
            s = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in dropped]


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    found = by_definition(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id,
        len(found),
        *best,
        None if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()),
        sha(b" ".join(collapsed(words, found))),
    )


texts = st.lists(
    st.one_of(
        st.lists(st.integers(0, 2), max_size=40),
        st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 60)).map(
            lambda x: np.resize(x[0], x[1]).tolist()
        ),
        st.lists(st.sampled_from([[0, 1], [0, 0, 1], [2] * 7]), max_size=9).map(lambda x: sum(x, [])),
    ),
    max_size=5,
)


@settings(max_examples=300, deadline=None)
@given(texts, st.sampled_from([3, 12]), st.sampled_from([5, 1 << 21]))
def test_grammar_finds_the_runs_of_the_definition(lists, least, points):
    kept, runs.POINTS = runs.POINTS, points
    try:
        rows = runs.runs_of(
            np.array(sum(lists, []), np.int64), np.array([len(x) for x in lists], np.int64), least
        )
    finally:
        runs.POINTS = kept
    assert rows.tolist() == [[i, *r] for i, x in enumerate(lists) for r in by_definition(x, least)]


def test_extensions_of_any_two_positions():
    random = np.random.default_rng(5)
    body = np.concatenate([random.integers(0, 2, 60), np.zeros(50, int), np.resize([0, 1, 1], 70)])
    codes = np.concatenate([[7], body, [8]])
    a, b = np.triu_indices(len(body), 1)
    grammar = runs.Grammar(codes)
    for side in (1, -1):
        found = grammar.extended(a + 1, b + 1, side)
        for i, j, n in zip(a + 1, b + 1, found, strict=True):
            e = 0
            while codes[i + side * e] == codes[j + side * e]:
                e += 1
            assert e == n


def test_periods_of_long_texts():
    random = np.random.default_rng(1)
    noise = random.integers(0, 4000, 60_000)
    long = np.resize(random.integers(4000, 8000, 7_001), 50_000)
    rows = runs.runs_of(np.concatenate([noise, long, np.zeros(9_999, int)]), np.array([119_999]))
    assert [0, 60_000, 50_000, 7_001] in rows.tolist()
    assert any(r[3] == 1 and r[2] >= 9_999 for r in rows.tolist())


def test_query_on_the_smallest_documents(small):
    rows = {r["doc_id"]: tuple(r) for r in runs.query(small).collect()}
    texts = small.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    tested = [r for r in texts if len((r["text"] or "").split()) < 700]
    assert len(tested) > 100
    for r in tested:
        assert rows[r["doc_id"]] == expected(r["doc_id"], r["text"])
    assert any(rows[r["doc_id"]][1] for r in tested)


def test_odd_documents(spark, odd, none, monkeypatch):
    monkeypatch.setattr(runs, "GROUP_BYTES", 100)
    found = runs.periodic_runs(odd)
    assert set(odd.columns) <= set(found.columns)
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, by_id.values())) == odd.count()
    assert by_id[0][0]["runs"] == [] and by_id[0][0]["collapsed"] == ""
    assert [(x["start"], x["length"], x["period"]) for x in by_id[4][0]["runs"]] == [(0, 32_000, 8)]
    assert by_id[4][0] == by_id[4][1] and by_id[4][0]["collapsed"] == "Some words and more of them stand here."
    assert runs.periodic_runs(none).collect() == [] and runs.query(none).collect() == []
    clash = documents(spark, ["a b " * 9]).withColumnRenamed("kept", "RUNS").withColumnRenamed("score", "searched")
    (row,) = runs.periodic_runs(clash).collect()
    assert row["runs"][0]["length"] == 18 and row["collapsed"] == "a b" and row["searched"] == 0.5


def test_periodic_tails_whatever_the_id(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0] + [None, 3]
    words = [f"w{i}" for i in range(97)]
    texts = [" ".join(words[: 1 + (i or 0) % 97]) for i in ids]
    texts[3], texts[4] = None, " \t\n"
    rows = runs.query(documents(spark, texts, ids)).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(
        str(expected(i, t)) for i, t in zip(ids, texts, strict=True)
    )
