"""Periodic runs of words by recompression.

A run is a stretch of neighbouring words with smallest period q (words q apart are equal), of at
least `LEAST_LENGTH` words and two periods, that no neighbouring word extends. Texts are read in
Arrow batches. All texts of a group are laid one behind the other, a mark of its own between any
two, and this sequence is compressed level by level: equal neighbours become one symbol with a
count (blocks), then the alphabet is dealt into left and right symbols and each left symbol
followed by a right one becomes a pair. Equal stretches are cut alike except at their ends, so the
levels form a grammar of linear size in which common extensions of two positions are found by
climbing equal symbols: a logarithmic number of steps, without suffix arrays.

A run of period p spans two neighbouring points of the grid 0, p, 2p, ... of its text. For each
period those points are extended to both sides by the grammar; n words have n ln n such points,
and only points of equal words are extended. The stretches found are exactly the runs of periods p
and of their multiples; of one stretch the smallest period is kept.

Whole texts are handled, of any length; memory is linear in the longest text. Groups end at
`GROUP_BYTES` of text, which changes no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.llm.common import replacing, text_of, words_of

#: Words of the shortest run.
LEAST_LENGTH = 12
#: Bytes of text compressed together.
GROUP_BYTES = 1 << 21
#: Grid points looked at together.
POINTS = 1 << 21
#: Ways to deal the alphabet that are compared on each level.
DEALS = 4

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _numbered(keys: np.ndarray) -> np.ndarray:
    return pd.factorize(keys)[0]


class Grammar:
    """Levels of block and pair compression of `codes`, as one table of nodes.

    Nodes 0 .. n-1 are the given symbols. A level's nodes follow each other in one stretch, so the
    neighbours of a node are the numbers beside it. `run[1]` and `run[-1]` count how many equal
    nodes stand from a node to the end or the start of its block, itself included.
    """

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        random = np.random.default_rng(7)
        levels, sizes, base = [], [], 0
        symbols = _numbered(codes)
        while True:
            m = len(symbols)
            place = np.arange(m, dtype=np.int64)
            blocks = not levels or not levels[-1][0]
            fresh = np.ones(m, bool)
            if blocks:
                fresh[1:] = symbols[1:] != symbols[:-1]
            else:
                fresh[1:] = ~self._paired(symbols, random)
            heads = np.flatnonzero(fresh)
            counts = np.diff(heads, append=m)
            parent = np.cumsum(fresh) - 1
            before, after = place - heads[parent], heads[parent] + counts[parent] - 1 - place
            levels.append((blocks, symbols, parent, heads, counts, before, after))
            sizes.append(m)
            second = counts if blocks else np.where(counts == 2, symbols[np.minimum(heads + 1, m - 1)] + 1, 0)
            above = _numbered(symbols[heads].astype(np.int64) << 32 | second)
            if above.max(initial=-1) + 1 == len(above):
                break
            symbols = above
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        total = int(offsets[-1])
        self.symbol = np.concatenate([x[1] for x in levels]).astype(np.int32)
        self.parent = np.zeros(total, np.int32)
        self.child = {1: np.zeros(total, np.int32), -1: np.zeros(total, np.int32)}
        self.edge = {1: np.zeros(total, bool), -1: np.zeros(total, bool)}
        self.run = {1: np.ones(total, np.int32), -1: np.ones(total, np.int32)}
        for k, (blocks, _, parent, heads, counts, before, after) in enumerate(levels):
            here = slice(offsets[k], offsets[k + 1])
            if blocks:
                self.run[1][here], self.run[-1][here] = after + 1, before + 1
            if k + 1 < len(levels):
                above = slice(offsets[k + 1], offsets[k + 2])
                self.parent[here] = offsets[k + 1] + parent
                self.edge[1][here], self.edge[-1][here] = before == 0, after == 0
                self.child[1][above] = offsets[k] + heads
                self.child[-1][above] = offsets[k] + heads + counts - 1

    @staticmethod
    def _paired(symbols: np.ndarray, random) -> np.ndarray:
        """Whether each symbol but the first is the right one of a pair; of some deals the best."""
        best = np.zeros(len(symbols) - 1, bool)
        most = 0
        for _ in range(DEALS):
            right = random.integers(0, 2, int(symbols.max(initial=0)) + 1, dtype=np.int8).view(bool)[symbols]
            paired = ~right[:-1] & right[1:]
            if (found := int(np.count_nonzero(paired))) > most:
                best, most = paired, found
        if not most and len(symbols) > 1:
            # Neighbours differ here, so the first two make a pair.
            best = (symbols[:-1] == symbols[0]) & (symbols[1:] == symbols[1])
        return best

    def extended(self, a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
        """Number of equal symbols of positions a and b, read to the right (1) or left (-1).

        A unique symbol must stand at the end on that side.
        """
        symbol, parent, edge = self.symbol, self.parent, self.edge[side]
        run, child = self.run[side], self.child[side]
        found = np.zeros(len(a), np.int64)
        which, start = np.arange(len(a)), a.astype(np.int64)
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(which):
            up_a, up_b = parent[a], parent[b]
            up = edge[a] & edge[b] & (symbol[up_a] == symbol[up_b])
            equal = symbol[a] == symbol[b]
            done = ~equal & (a < self.n)
            found[which[done]] = np.abs(a[done] - start[done])
            steps = side * np.minimum(run[a], run[b])
            next_a = np.where(up, up_a, np.where(equal, a + steps, child[a]))
            next_b = np.where(up, up_b, np.where(equal, b + steps, child[b]))
            go = ~done
            which, start, a, b = which[go], start[go], next_a[go], next_b[go]
        return found


def _grid(first: np.ndarray, sizes: np.ndarray):
    """Points (position, period) of all texts, `POINTS` or a little more at a time."""
    half = sizes // 2
    text = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    counts = (sizes[text] - 1) // period
    ends = np.cumsum(counts)
    start = 0
    while start < len(counts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + POINTS, "right")))
        part = slice(start, stop)
        which = np.repeat(np.arange(start, stop), counts[part])
        step = np.arange(len(which)) - np.repeat(ends[part] - counts[part] - done, counts[part])
        yield first[text[which]] + step * period[which], period[which]
        start = stop


def runs_of(codes: np.ndarray, sizes: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    `codes` holds the word numbers of the texts one behind the other, `sizes` their lengths.
    """
    texts = len(sizes)
    first = np.cumsum(sizes) - sizes + np.arange(1, texts + 1)
    laid = np.empty(len(codes) + texts + 1, np.int64)
    owner = np.repeat(np.arange(texts), sizes)
    laid[np.arange(len(codes)) + owner + 1] = codes
    marks = np.append(first - 1, len(laid) - 1)
    laid[marks] = codes.max(initial=0) + 1 + np.arange(texts + 1)
    grammar, found = None, []
    for at, period in _grid(first, sizes):
        equal = laid[at] == laid[at + period]
        at, period = at[equal], period[equal]
        if not len(at):
            continue
        grammar = grammar or Grammar(laid)
        right = grammar.extended(at, at + period, 1)
        # A run's first grid point lies within its first period, so shorter sums are no run of it.
        left = grammar.extended(at - 1, at + period - 1, -1)
        length = left + right + period
        long = length >= np.maximum(least, 2 * period)
        rows = np.stack([at - left, length, period], 1)[long]
        found.append(np.unique(rows, axis=0))
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[fresh]
    text = np.searchsorted(first, rows[:, 0], "right") - 1
    rows = np.column_stack([text, rows[:, 0] - first[text], rows[:, 1:]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], text))]


def _groups(texts: list[str | None]):
    """Stretches of `texts` that hold `GROUP_BYTES` or a single longer text."""
    start = size = 0
    for i, text in enumerate(texts):
        more = len(text or "")
        if i > start and size + more > GROUP_BYTES:
            yield start, i
            start, size = i, 0
        size += more
    if start < len(texts):
        yield start, len(texts)


def _found(texts: list[str | None], least: int) -> tuple[list, list]:
    # bytes.split() without an argument cuts at space and 0x09 to 0x0D, and nowhere else.
    words = [(t or "").encode().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = pa.array([w for text in words for w in text], pa.binary()).dictionary_encode()
    rows = runs_of(flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes, least)
    bounds = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    runs, collapsed = [], []
    for i, text in enumerate(words):
        mine = rows[bounds[i] : bounds[i + 1], 1:]
        if len(mine):
            # Overlapping drops as differences: +1 where one begins, -1 behind its end.
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, mine[:, 0] + mine[:, 2], 1)
            np.add.at(change, mine[:, 0] + mine[:, 1], -1)
            text = [text[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in mine.tolist()])
        collapsed.append(b" ".join(text).decode())
    return runs, collapsed


def _searcher(least: int):
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _groups(texts):
                runs, collapsed = _found(texts[start:stop], least)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, stop - start),
                        pa.array(runs, kind),
                        pa.array(collapsed, pa.string()),
                    ],
                    names=["row", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """`docs` with `runs` (start, length, period in words) and `collapsed`.

    `collapsed` is the text without the repetitions: each run keeps its first period only, the
    words left are joined by one space. Runs come by start, then period. Columns of `docs` with
    result names are replaced. A null or empty text has no run and an empty `collapsed`; null ids
    and repeated rows are rows like others; an empty table gives an empty table.
    """
    row = docs.select(F.struct("*").alias("row"), F.col("text").alias("searched"))
    found = row.mapInArrow(
        _searcher(least),
        f"row {row.schema['row'].dataType.simpleString()}, runs {RUNS}, collapsed string",
    )
    flat = found.select("row.*", F.col("runs").alias("__runs"), F.col("collapsed").alias("__collapsed"))
    return replacing(
        flat, {"runs": F.col("__runs"), "collapsed": F.col("__collapsed")}
    ).drop("__runs", "__collapsed")


def with_periodic_tails(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document by checksum of its id, its tail made periodic; else `text`.

    With n words, h = crc32 of the decimal id and g = h / 10, every word i >= a = g % n becomes
    word a + (i - a) % p where p = 1 + (n - a) / (3 + g % 8). A null id leaves the text.
    """
    words = words_of(text_of(text))
    n = F.size(words)
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    whole = lambda c: c.cast("int")
    block = F.slice(words, whole(a) + 1, whole(F.least(p, n - a)))
    tail = F.slice(F.flatten(F.array_repeat(block, whole(F.ceil((n - a) / p)))), F.lit(1), whole(n - a))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), whole(a)), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def query(docs: DataFrame) -> DataFrame:
    """Digests of the runs of each document, some of which get a periodic tail first."""
    made = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        with_periodic_tails(F.col("doc_id"), F.col("text")).alias("text"),
    )
    found = periodic_runs(made).withColumn(
        "longest",
        F.array_max(
            F.transform(
                "runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
            )
        ),
    )
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.n").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("1000 * longest.n div -longest.p").alias("exponent_milli"),
        F.sha2(
            F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256
        ).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
