"""Byte-pair encoding and decoding with a transducer lexicon.

The most frequent words of the corpus and their ids are compiled into a minimal acyclic
transducer: states with equal continuations are shared, and the numbers on a word's edges add up
to its place in the list of id sequences. Tasks memory-map the transducer and look up all new
words of a batch together; a word that it lacks is merged exactly. Texts are put together from
units between white space, so that each distinct unit of a batch is encoded once.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import io
import json
import tempfile
import unicodedata
from array import array
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanspan.llm.common import pieces, replacing, written

#: Words in the lexicon, and bytes of the longest one.
LEXICON_WORDS = 100_000
LEXICON_BYTES = 64
#: Units whose count a task, or whose encoding a process remembers, about 300 bytes each.
REMEMBERED = 400_000
#: Rows that are encoded before they are passed on.
ROWS = 500
#: Bytes of a word up to which plain search for the best pair is faster than a heap.
SHORT = 128
#: Short words that are merged together.
TOGETHER = 4096
#: Counts are told apart by this many steps for each doubling when the lexicon is cut.
STEPS = 64

_SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed values of the tokenizer file's kind: its word pattern, ends of words, byte characters.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_SPACE}\p{{L}}\p{{N}}]+")
_BLANK = regex.compile(f"[{_SPACE}]+")
_END = "</w>"


@cache
def _byte_chars() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one above 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


@dataclass
class Vocabulary:
    """Tokens by id, ranks of merges, and special tokens that stand for themselves in a text."""

    tokens: dict[int, str]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    #: Id of each byte inside a word and at its end, -1 for one without token.
    inside: list[int] = field(init=False)
    last: list[int] = field(init=False)
    #: Rank of a pair of ids, as one number, and the id that each rank makes.
    pairs: dict[int, int] = field(init=False)
    made: list[int] = field(init=False)
    width: int = field(init=False)
    #: The pairs in order and their ranks, for many words at once.
    sorted_pairs: np.ndarray = field(init=False)
    sorted_ranks: np.ndarray = field(init=False)

    def __post_init__(self):
        ids = {token: i for i, token in self.tokens.items()}
        self.width = max(self.tokens, default=0) + 1
        self.inside = [ids.get(c, -1) for c in _byte_chars()]
        self.last = [ids.get(c + _END, -1) for c in _byte_chars()]
        self.pairs = {ids[a] * self.width + ids[b]: r for (a, b), r in self.ranks.items()}
        self.made = [ids[a + b] for a, b in self.ranks]
        self.sorted_pairs = np.array(sorted(self.pairs), np.int64)
        self.sorted_ranks = np.array([self.pairs[p] for p in self.sorted_pairs.tolist()], np.int64)

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"]]
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = {i: t for t, i in data["model"]["vocab"].items()}
        return Vocabulary(
            tokens | {i: t for t, i in special.items()}, {m: r for r, m in enumerate(merges)}, special
        )

    def merge(self, word: str) -> list[int]:
        """Ids of one word: the adjacent pair of lowest rank, leftmost first, is merged while
        there is one."""
        data = word.encode("utf-8", "replace")
        ids = [self.inside[b] for b in data]
        ids[-1] = self.last[data[-1]]
        if min(ids) < 0:
            raise ValueError(f"the vocabulary lacks a byte of {word!r}")
        rank, made, width, never = self.pairs.get, self.made, self.width, len(self.made)
        if len(ids) <= SHORT:
            found = [rank(a * width + b, never) for a, b in pairwise(ids)]
            while found and (best := min(found)) < never:
                i = found.index(best)
                ids[i : i + 2] = [made[best]]
                del found[i]
                if i:
                    found[i - 1] = rank(ids[i - 1] * width + ids[i], never)
                if i < len(found):
                    found[i] = rank(ids[i] * width + ids[i + 1], never)
            return ids
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [
            (best, i, a, b)
            for i, (a, b) in enumerate(pairwise(ids))
            if (best := rank(a * width + b, never)) < never
        ]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made[best], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0:
                    a, b = ids[left], ids[right]
                    if (best := rank(a * width + b, never)) < never:
                        heapq.heappush(heap, (best, left, a, b))
        return [i for i in ids if i >= 0]

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; the number of merges for a pair without, or an id below 0."""
        never = len(self.made)
        if not len(self.sorted_pairs):
            return np.full(a.shape, never, np.int64)
        pairs = a * self.width + b
        at = np.minimum(np.searchsorted(self.sorted_pairs, pairs), len(self.sorted_pairs) - 1)
        known = (self.sorted_pairs[at] == pairs) & (a >= 0) & (b >= 0)
        return np.where(known, self.sorted_ranks[at], never)

    def merge_all(self, words: list[str]) -> list[list[int]]:
        """What `merge` gives for each word; short words of near lengths are merged together."""
        data = [word.encode("utf-8", "replace") for word in words]
        found: list[list[int]] = [[] for _ in words]
        order = sorted(range(len(words)), key=lambda i: len(data[i]))
        while order and len(data[order[-1]]) > SHORT:
            i = order.pop()
            found[i] = self.merge(words[i])
        for start in range(0, len(order), TOGETHER):
            self._merge_rows(order[start : start + TOGETHER], words, data, found)
        return found

    def _merge_rows(self, order: list[int], words: list[str], data: list[bytes], found: list[list[int]]):
        """Merge the words `order` into `found`, a row for each; every round merges one pair of a row."""
        sizes = np.array([len(data[i]) for i in order], np.int64)
        wide, never = int(sizes.max()), len(self.made)
        letters = np.frombuffer(b"".join(data[i].ljust(wide, b"\0") for i in order), np.uint8)
        letters = letters.reshape(len(order), wide)
        rows, place = np.arange(len(order)), np.arange(wide)
        ids = np.array(self.inside, np.int64)[letters]
        ids[rows, sizes - 1] = np.array(self.last, np.int64)[letters[rows, sizes - 1]]
        beyond = place >= sizes[:, None]
        for row in np.flatnonzero(((ids < 0) & ~beyond).any(axis=1))[:1]:
            raise ValueError(f"the vocabulary lacks a byte of {words[order[row]]!r}")
        ids[beyond] = -1
        ranks, made = self._ranks_of(ids[:, :-1], ids[:, 1:]), np.array(self.made, np.int64)
        while len(rows):
            if ids.shape[1] > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(rows)), at]
                going = best < never
            else:
                going = np.zeros(len(rows), bool)
            for row, kept in zip(rows[~going].tolist(), ids[~going].tolist(), strict=True):
                found[order[row]] = [i for i in kept if i >= 0]
            if not going.any():
                return
            rows, ids, ranks, at, best = (x[going] for x in (rows, ids, ranks, at, best))
            here, wide = np.arange(len(rows)), ids.shape[1]
            ids[here, at] = made[best]
            # The second id of the pair goes, and with it the pair; its neighbours are new pairs.
            place = np.arange(wide - 1)
            ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)
            place = np.arange(wide - 2)
            ranks = np.take_along_axis(ranks, place + (place >= at[:, None]), 1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self._ranks_of(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at < wide - 2)
            ranks[right, at[right]] = self._ranks_of(ids[right, at[right]], ids[right, at[right] + 1])

    def units(self, text: str | None) -> list[str]:
        """Runs of characters other than white space, and special tokens, in order.

        No word reaches over white space, and neither lower case nor composed form depends on what
        stands beyond it, so the words of a text are those of its units.
        """
        text = text or ""
        if not any(token in text for token in self.special):
            return _runs(text)
        pattern = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        found, at = [], 0
        for match in regex.finditer(pattern, text):
            found += [*_runs(text[at : match.start()]), match.group()]
            at = match.end()
        return found + _runs(text[at:])

    def words(self, unit: str) -> list[str]:
        """Words of a unit in order, in lower case and composed form; a special token is one."""
        if unit in self.special:
            return [unit]
        if not unit.isascii():
            # Lower case goes by character: no final sigma.
            unit = unicodedata.normalize("NFC", unit).replace("Σ", "σ")
        unit = unit.lower()
        return [unit] if unit.isalpha() else _WORD.findall(unit)


def _runs(text: str) -> list[str]:
    # Python takes four control characters for white space that the tokenizer's kind does not.
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [run for run in _BLANK.split(text) if run]
    return text.split()


class Transducer:
    """Words to id sequences, in flat arrays of one memory-mapped file."""

    PARTS = ("keys", "targets", "adds", "final", "offsets", "ids")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = arrays

    @staticmethod
    def compile(entries: dict[bytes, list[int]]) -> Transducer:
        """Minimal automaton of the words, built in order with shared suffixes; a state counts
        the words below it, and an edge the words that come before it in its state."""
        register: dict[tuple, int] = {}
        states: list[tuple[bool, list]] = []
        counts: list[int] = []

        def close(final: bool, edges: list) -> int:
            key = (final, tuple(edges))
            if key not in register:
                register[key] = len(states)
                states.append((final, edges))
                counts.append(final + sum(counts[t] for _, t in edges))
            return register[key]

        # Open states along the current word: [final, edges closed so far, byte to the next].
        path: list[list] = [[False, [], None]]
        previous = b""
        words = sorted(entries)
        for word in words:
            same = 0
            while same < min(len(word), len(previous)) and word[same] == previous[same]:
                same += 1
            while len(path) > same + 1:
                final, edges, _ = path.pop()
                path[-1][1].append((path[-1][2], close(final, edges)))
            for byte in word[same:]:
                path[-1][2] = byte
                path.append([False, [], None])
            path[-1][0] = True
            previous = word
        while len(path) > 1:
            final, edges, _ = path.pop()
            path[-1][1].append((path[-1][2], close(final, edges)))
        root = close(path[0][0], path[0][1])
        keys, targets, adds = [], [], []
        order = [root, *(i for i in range(len(states)) if i != root)]
        number = {state: i for i, state in enumerate(order)}
        for state in order:
            final, edges = states[state]
            passed = int(final)
            for byte, target in edges:
                keys.append(number[state] * 256 + byte)
                targets.append(number[target])
                adds.append(passed)
                passed += counts[target]
        lengths = [len(entries[w]) for w in words]
        return Transducer(
            {
                "keys": np.array(keys, np.int64),
                "targets": np.array(targets, np.int64),
                "adds": np.array(adds, np.int64),
                "final": np.array([states[s][0] for s in order], np.int64),
                "offsets": np.concatenate(([0], np.cumsum(lengths))).astype(np.int64),
                "ids": np.array([i for w in words for i in entries[w]], np.int64),
            }
        )

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        out.write(np.array([len(self.arrays[p]) for p in self.PARTS], np.int64).tobytes())
        for part in self.PARTS:
            out.write(self.arrays[part].tobytes())
        return out.getvalue()

    @staticmethod
    def mapped(data: bytes) -> Transducer:
        """The arrays in an unnamed, memory-mapped file that goes with the process."""
        with tempfile.TemporaryFile() as file:
            file.write(data)
            file.flush()
            flat = np.asarray(np.memmap(file, np.int64, "r"))
        ends = len(Transducer.PARTS) + np.cumsum(flat[: len(Transducer.PARTS)])
        starts = ends - flat[: len(Transducer.PARTS)]
        return Transducer({p: flat[a:b] for p, a, b in zip(Transducer.PARTS, starts, ends, strict=True)})

    def lookup(self, words: list[bytes]) -> list[np.ndarray | None]:
        """Ids of each word, or None; all words go through the states together."""
        keys, n = self.arrays["keys"], len(words)
        if not n or not len(keys):
            return [None] * n
        sizes = np.fromiter(map(len, words), np.int64, n)
        width = int(min(sizes.max(), LEXICON_BYTES))
        letters = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), np.uint8)
        letters = letters.reshape(n, width)
        state, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        alive = (sizes > 0) & (sizes <= width)
        for i in range(width):
            here = np.flatnonzero(alive & (sizes > i))
            wanted = state[here] * 256 + letters[here, i]
            edge = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[edge] == wanted
            alive[here[~found]] = False
            state[here] = self.arrays["targets"][edge]
            place[here] += self.arrays["adds"][edge]
        alive &= self.arrays["final"][state] > 0
        offsets, ids = self.arrays["offsets"], self.arrays["ids"]
        return [
            ids[offsets[p] : offsets[p + 1]] if ok else None
            for p, ok in zip(place.tolist(), alive.tolist(), strict=True)
        ]


class Encoder:
    """Encodes units through the transducer, exact merges for the rest, and remembers them.

    Without `decode` no decoded texts are made and remembered.
    """

    def __init__(
        self, vocabulary: Vocabulary, transducer: Transducer, digest: bool, decode: bool = True
    ):
        self.vocabulary, self.transducer = vocabulary, transducer
        self.digest, self.decode = digest, decode
        #: Ids of each known unit, as decimals joined by spaces or as packed 32-bit integers.
        self.ids: dict[str, str] | dict[str, bytes] = {}
        #: Decoded text of each known unit.
        self.plain: dict[str, str] = {}
        #: Both of them for the units known before these, from where those met again come back.
        self.older: tuple[dict, dict] = ({}, {})
        self.decimals = {i: str(i) for i in vocabulary.tokens}

    def ids_of(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: a special token's, the transducer's, or those of exact merges."""
        special, found = self.vocabulary.special, []
        looked_up = self.transducer.lookup([w.encode("utf-8", "replace") for w in words])
        lacking = [
            w for w, ids in zip(words, looked_up, strict=True) if ids is None and w not in special
        ]
        merged = iter(self.vocabulary.merge_all(lacking))
        for word, ids in zip(words, looked_up, strict=True):
            if word in special:
                found.append([special[word]])
            else:
                found.append(ids.tolist() if ids is not None else next(merged))
        return found

    def learn(self, units: set[str]) -> None:
        """Remember these units; without room, those not met since the last time are forgotten."""
        new = units.difference(self.ids)
        if len(self.ids) + len(new) > REMEMBERED // 2:
            self.older, self.ids, self.plain, new = (self.ids, self.plain), {}, {}, units
        known, plain = self.older
        again = [unit for unit in new if unit in known]
        for unit in again:
            self.ids[unit] = known[unit]
            if self.decode:
                self.plain[unit] = plain[unit]
        new = new.difference(again)
        parts = {unit: self.vocabulary.words(unit) for unit in new}
        words = list({word for found in parts.values() for word in found})
        ids_of = dict(zip(words, self.ids_of(words), strict=True))
        decimal, token = self.decimals.__getitem__, self.vocabulary.tokens.__getitem__
        for unit, found in parts.items():
            ids = ids_of[found[0]] if len(found) == 1 else [i for w in found for i in ids_of[w]]
            self.ids[unit] = " ".join(map(decimal, ids)) if self.digest else array("i", ids).tobytes()
            if self.decode:
                self.plain[unit] = " ".join(map(token, ids))

    def decoded(self, units: list[str]) -> str:
        return " ".join(map(self.plain.__getitem__, units))

    def digests(self, texts: list[list[str]]) -> list[pa.Array]:
        """Number of ids and digests of ids and decoded text, for texts as known units."""
        ids = [" ".join(map(self.ids.__getitem__, units)) for units in texts]
        sha = lambda x: hashlib.sha256(x.encode("utf-8")).hexdigest()
        return [
            pa.array([x.count(" ") + 1 if x else 0 for x in ids], pa.int64()),
            pa.array([sha(x) for x in ids], pa.string()),
            pa.array([sha(self.decoded(units)) for units in texts], pa.string()),
        ]

    def whole(self, texts: list[list[str]], decode: bool) -> list[pa.Array]:
        """Number of ids, the ids and, if wanted, the decoded text, for texts as known units."""
        packed = [b"".join(map(self.ids.__getitem__, units)) for units in texts]
        sizes = np.array([len(x) // 4 for x in packed], np.int64)
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
        ids = pa.array(np.frombuffer(b"".join(packed), np.int32))
        found = [pa.array(sizes), pa.ListArray.from_arrays(offsets, ids)]
        if decode:
            found.append(pa.array([self.decoded(units) for units in texts], pa.string()))
        return found


@contextmanager
def _uncollected():
    """Without Python's search for cycles of references.

    Encoding makes none, but so many short lists that they would be gone through again and again;
    they end with their last reference.
    """
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


_loaded: dict[tuple[str, bool, bool], Encoder] = {}


def _encoder(shared, digest: bool, decode: bool) -> Encoder:
    """Encoder of a broadcast (vocabulary, transducer bytes), made once in a process."""
    vocabulary, data = shared.value
    key = (hashlib.sha256(data).hexdigest(), digest, decode)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(vocabulary, Transducer.mapped(data), digest, decode)
    return _loaded[key]


def _count_words(shared):
    def run(batches):
        vocabulary = shared.value
        units: Counter[str] = Counter()

        def flushed():
            counts: dict[str, int] = {}
            with _uncollected():
                for unit, n in units.items():
                    for word in vocabulary.words(unit):
                        counts[word] = counts.get(word, 0) + n
            units.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())],
                names=["word", "n"],
            )

        for batch in pieces(batches):
            for text in batch.column(0).to_pylist():
                units.update(vocabulary.units(text))
                if len(units) > REMEMBERED:
                    yield flushed()
        yield flushed()

    return run


def lexicon(docs: DataFrame, vocabulary: Vocabulary, size: int = LEXICON_WORDS) -> Transducer:
    """Transducer of the most frequent words of all documents, `size` at most.

    Words are taken by steps of their count, from the highest, while a whole step fits. Only the
    number of words of each step and the words taken reach the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    counted = written(
        docs.select("text")
        .mapInArrow(_count_words(shared), "word string, n bigint")
        .filter(F.octet_length("word") <= LEXICON_BYTES)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .select("word", F.floor(F.log2("n") * STEPS).cast("int").alias("step"))
    )
    room, least = size, None
    for row in counted.groupBy("step").count().orderBy(F.desc("step")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    if least is None:
        return Transducer.compile({})
    words = [r["word"] for r in counted.filter(F.col("step") >= least).select("word").collect()]
    return Transducer.compile(
        {w.encode("utf-8"): vocabulary.merge(w) for w in words if w not in vocabulary.special}
    )


def _encode_batches(shared, names: list[str]):
    def run(batches):
        digest, decode = "ids_sha256" in names, "decoded" in names
        encoder = _encoder(shared, digest, digest or decode)
        # Ids take more memory than texts: a few rows at a time.
        for part in pieces(batches, ROWS):
            column = part.column(0).field("text").to_pylist()
            with _uncollected():
                texts = [encoder.vocabulary.units(text) for text in column]
                encoder.learn(set().union(*texts))
                found = encoder.digests(texts) if digest else encoder.whole(texts, decode)
            yield pa.RecordBatch.from_arrays([part.column(0), *found], names=["row", *names])

    return run


def encoded(
    docs: DataFrame,
    path: str,
    digest: bool = False,
    decode: bool = True,
    size: int = LEXICON_WORDS,
) -> DataFrame:
    """`docs` with n_tokens, ids and decoded, or the digests ids_sha256 and decoded_sha256.

    `path` names the tokenizer file, which only the driver reads; without `decode` there is no
    column decoded. Columns of `docs` with result names are replaced. Null texts are empty: no
    ids, an empty decoded text. Null ids and repeated rows pass through. Texts are encoded whole.
    """
    vocabulary = Vocabulary.load(path)
    transducer = lexicon(docs, vocabulary, size)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, transducer.to_bytes()))
    row = docs.select(F.struct("*").alias("row"))
    kinds = {"n": "bigint"}
    if digest:
        kinds |= {"ids_sha256": "string", "decoded_sha256": "string"}
    else:
        kinds |= {"ids": "array<int>"} | ({"decoded": "string"} if decode else {})
    names = list(kinds)
    columns = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    found = row.mapInArrow(
        _encode_batches(shared, names),
        f"row {row.schema['row'].dataType.simpleString()}, {columns}",
    )
    flat = found.select("row.*", *[F.col(c).alias(f"__{c}") for c in names])
    return replacing(
        flat, {"n_tokens": F.col("__n")} | {c: F.col(f"__{c}") for c in names[1:]}
    ).drop(*[f"__{c}" for c in names])


def query(docs: DataFrame, path: str) -> DataFrame:
    """Number of tokens and digests of each document."""
    return encoded(docs.select("doc_id", "text"), path, digest=True).select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"
    )
