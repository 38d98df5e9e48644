"""Personal data: fixed formats, and boosted trees over wider candidates.

Generators propose overlapping spans with high recall. Gradient-boosted trees judge format and
context, and a threshold calibrated for precision on held-out candidates selects the spans that
are added to those of the fixed formats.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanspan.llm.common import replacing

KINDS = ["email", "ip", "card", "phone", "mail_like", "number_like", "account_like"]
#: About this many documents, picked by a hash of the id, give at most TRAIN_ROWS candidates.
TRAIN_DOCS = 5000
TRAIN_ROWS = 20_000
TREES, DEPTH, SHRINKAGE, LEAST_LEAF = 40, 3, 0.2, 10
#: The threshold is the lowest with this precision on the candidates held out from training.
PRECISION = 0.98
LEAST_THRESHOLD = 0.6
CONTEXT = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is taken whole, so the search never starts again inside it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_GENERATORS = [
    (4, re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\s?(?:\(at\)|\[at\]|\{at\}|@)\s?[\w-]{1,64}(?:\s?(?:\(dot\)|\[dot\]|\.)\s?[\w-]{2,24}){1,4}", re.I)),
    (5, re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,24}(?![0-9A-Za-z])")),
    (5, re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20-]?[0-9]{4}){3}(?![0-9A-Za-z])")),
    (6, re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
]
_CUES = [
    re.compile(p, re.I)
    for p in (
        r"e-?mail|contact|write to|mailto|reach",
        r"phone|tel\b|tel[.:]|call|mobile|fax|whatsapp|sms",
        r"card|visa|master|amex|credit|debit|payment",
        r"ssn|social|passport|iban|account|licen[cs]e no|tax id|national id",
        r"page|year|date|version|chapter|isbn|issn|figure|table|total|price|id\b",
    )
]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_rest(value: str) -> int:
    """Remainder of an account number modulo 97; 1 if its check digits are right."""
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _account(digits: str) -> str:
    """An account number with right check digits, made from digits."""
    country = ["DE", "FR", "ES", "GB", "NL"][sum(map(int, digits)) % 5]
    body = (digits * 3)[:18]
    return f"{country}{98 - iban_rest(f'{country}00{body}'):02d}{body}"


def _fours(value: str) -> str:
    return " ".join(value[i : i + 4] for i in range(0, len(value), 4))


def _emails(text: str):
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        after = domain.end() if domain else at + 1
        if domain:
            yield start, after
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed formats, by kind, then start."""
    found = [(0, *span) for span in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((3, *m.span()))
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every generator; spans may overlap."""
    return [(kind, *m.span()) for kind, pattern in _GENERATORS for m in pattern.finditer(text)]


def features(kind: int, value: str, before: str, after: str) -> list[float]:
    """Format and context of one candidate."""
    digits = [c for c in value if c.isdigit()]
    groups = [len(g) for g in re.findall(r"[0-9]+", value)] or [0]
    letters = sum(c.isalpha() for c in value)
    plain = "".join(digits)
    return [
        float(kind == 4), float(kind == 5), float(kind == 6), float(len(value)), float(len(digits)),
        letters / max(len(value), 1), float(len(groups)), float(max(groups)), float(min(groups)),
        float(groups[-1]), float(value[:1] == "+"), float("(" in value), float(value.count("-")),
        float(value.count(".")), float(value.count(" ")), float("@" in value),
        float(len(digits) >= 12 and luhn(plain)), float(len(set(plain)) / max(len(plain), 1)),
        float(value.count("/")), float(kind == 6 and iban_rest(value) == 1), *[float(bool(cue.search(before))) for cue in _CUES],
        float(before[-1:].isalnum() or before[-1:] in "\"'=:"), float(after[:1] in "%$€\"'"),
    ]


def _variants(kind: int, value: str) -> list[tuple[int, str]]:
    """A positive in other spellings, so that the trees learn more than the fixed formats."""
    digits = re.sub(r"[^0-9]", "", value)
    if kind == 0:
        return [(4, value), (4, value.replace("@", " (at) ")), (4, value.replace("@", "[at]").replace(".", "[dot]"))]
    if kind == 2:
        return [(5, value), (5, _fours(digits))]
    if kind == 3:
        rest = digits[-10:]
        return [(5, value), (5, f"({rest[:3]}) {rest[3:6]}-{rest[6:]}"), (5, f"{rest[:3]}-{rest[3:6]}-{rest[6:]}")]
    return [(5, value)]


def _checked(kind: int, value: str, before: str) -> int | None:
    """Label of a candidate outside the fixed formats; None if nothing tells."""
    if kind == 6:
        return int(iban_rest(value) == 1)
    cues = [bool(cue.search(before)) for cue in _CUES]
    if cues[-1] and not any(cues[:-1]):
        return 0
    digits = re.sub(r"[^0-9]", "", value)
    if kind == 5 and 16 <= len(digits) <= 19 and not luhn(digits) and not any(cues):
        return 0
    return None


def examples(text: str) -> list[tuple[list[float], int]]:
    """Labelled candidates of a text. Fixed-format spans in several spellings, and account numbers
    with right check digits, found or made from a span's digits, are positive. Numbers and dates made
    from their digits, account numbers with wrong check digits and candidates after words of pages,
    prices or versions only are negative. Other candidates have no label: they may be what is sought."""
    base, rows = base_spans(text), []
    around = lambda s, e: (text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT])
    for kind, s, e in base:
        digits = re.sub(r"[^0-9]", "", text[s:e])
        rows += [(features(k, v, *around(s, e)), 1) for k, v in _variants(kind, text[s:e])]
        if len(digits) >= 8:
            year = f"{1900 + int(digits[:4]) % 130}-{1 + int(digits[4:6]) % 12:02d}-{1 + int(digits[6:8]) % 28:02d}"
            for v in (digits[:8], year, f"{digits[:3]}.{digits[3:6]}.{digits[6:8]}00"):
                rows.append((features(5, v, *around(s, e)), 0))
            good = _account(digits)
            bad = f"{good[:2]}{(int(good[2:4]) + 1) % 100:02d}{good[4:]}"
            for v, label in ((good, 1), (_fours(good), 1), (bad, 0), (_fours(bad), 0)):
                rows.append((features(6, v, *around(s, e)), label))
    for kind, s, e in candidates(text):
        if not any(a < e and s < b for _, a, b in base):
            label = _checked(kind, text[s:e], text[max(0, s - CONTEXT) : s])
            if label is not None:
                rows.append((features(kind, text[s:e], *around(s, e)), label))
    return rows


@dataclass
class Trees:
    """Boosted regression trees in arrays: feature, cut, children; and the chosen threshold."""

    start: float
    trees: list[list[tuple]]
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.start)
        for tree in self.trees:
            logit += _walk(tree, x)
        return 1 / (1 + np.exp(-logit))


def _walk(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """Value of each row's leaf; a node is (feature, cut, left, right) or (None, value)."""
    node, value = np.zeros(len(x), int), np.zeros(len(x))
    for i, item in enumerate(tree):
        here = np.flatnonzero(node == i)
        if item[0] is None:
            value[here] = item[1]
        else:
            node[here] = np.where(x[here, item[0]] <= item[1], item[2], item[3])
    return value


def _grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> list[tuple]:
    """One tree of DEPTH levels on second-order gains, nodes in breadth-first order."""
    tree: list = [None]
    todo = [(0, np.arange(len(x)), 0)]
    gain_of = lambda g, h: g * g / (h + 1.0)
    while todo:
        place, rows, depth = todo.pop(0)
        g, h = gradient[rows].sum(), weight[rows].sum()
        best = (1e-6, None, None)
        if depth < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            for f in range(x.shape[1]):
                order = np.argsort(x[rows, f], kind="stable")
                v = x[rows[order], f]
                gl, hl = np.cumsum(gradient[rows[order]])[:-1], np.cumsum(weight[rows[order]])[:-1]
                gains = gain_of(gl, hl) + gain_of(g - gl, h - hl) - gain_of(g, h)
                gains[v[1:] <= v[:-1]] = -1
                gains[: LEAST_LEAF - 1] = -1
                gains[len(gains) - LEAST_LEAF + 1 :] = -1
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (gains[k], f, (v[k] + v[k + 1]) / 2)
        if best[1] is None:
            tree[place] = (None, SHRINKAGE * g / (h + 1.0))
            continue
        goes = x[rows, best[1]] <= best[2]
        tree[place] = (best[1], best[2], len(tree), len(tree) + 1)
        tree += [None, None]
        todo += [(len(tree) - 2, rows[goes], depth + 1), (len(tree) - 1, rows[~goes], depth + 1)]
    return tree


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees; every third example only calibrates the threshold. Without examples of both
    labels nothing is selected."""
    held = np.arange(len(y)) % 3 == 2
    learn_x, learn_y = x[~held], y[~held]
    if not len(y) or learn_y.min() == learn_y.max() or len(learn_y) < 2 * LEAST_LEAF:
        return Trees(-20.0, [], 1.0)
    rate = float(learn_y.mean())
    model = Trees(float(np.log(rate / (1 - rate))), [], 1.0)
    logit = np.full(len(learn_y), model.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        tree = _grow(learn_x, learn_y - p, p * (1 - p))
        model.trees.append(tree)
        logit += _walk(tree, learn_x)
    p, truth = model.probability(x[held]), y[held]
    for cut in np.arange(LEAST_THRESHOLD, 1.0, 0.01):
        chosen = p >= cut
        if chosen.any() and truth[chosen].mean() >= PRECISION:
            model.threshold = float(cut)
            break
    return model


def _example_batches(batches):
    for batch in batches:
        rows = [r for text in batch.column(0).to_pylist() for r in examples(text or "")]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.list_(pa.float64())),
                pa.array([r[1] for r in rows], pa.int32()),
            ],
            names=["x", "y"],
        )


def train(docs: DataFrame) -> Trees:
    """Trees from the candidates of a sample of documents, labelled by the fixed formats."""
    total = docs.count()
    share = min(1.0, TRAIN_DOCS / max(total, 1))
    rows = (
        docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
        .select("text")
        .mapInArrow(_example_batches, "x array<double>, y int")
        .orderBy(F.xxhash64("x", "y"), "y")
        .limit(TRAIN_ROWS)
        .toArrow()
        .to_pydict()
    )
    if not rows["y"]:
        return fit(np.zeros((0, 1)), np.zeros(0, int))
    return fit(np.array(rows["x"], float), np.array(rows["y"], int))


def find(text: str | None, model: Trees) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the fixed formats, and those that the trees add: the most likely candidate first,
    none that touches a span already taken."""
    text = text or ""
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    proposed = candidates(text)
    if not proposed or model.threshold >= 1:
        return base, []
    x = np.array(
        [features(k, text[s:e], text[max(0, s - CONTEXT) : s], text[e : e + CONTEXT]) for k, s, e in proposed]
    )
    chance = model.probability(x)
    added: list[tuple[int, int, int]] = []
    used = np.zeros(len(text) + 1, bool)
    for s, e in taken:
        used[s:e] = True
    for i in sorted(np.flatnonzero(chance >= model.threshold), key=lambda i: (-chance[i], proposed[i])):
        kind, s, e = proposed[i]
        if not used[s:e].any():
            used[s:e] = True
            added.append(proposed[i])
    return base, added


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _find_batches(model: Trees):
    def run(batches):
        for batch in batches:
            found = [find(t, model) for t in batch.column(0).field("text").to_pylist()]
            counts = [[sum(k == kind for k, _, _ in b) for b, _ in found] for kind in range(4)]
            digests = [hashlib.sha256(_listed(b).encode()).hexdigest() for b, _ in found]
            spans = [_listed(b + a) for b, a in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                ],
                names=["row", *_COLUMNS],
            )

    return run


_COLUMNS = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def detect(docs: DataFrame, model: Trees) -> DataFrame:
    """`docs` with n_email, n_ip, n_card, n_phone, base_sha256 and spans, in place of columns of
    these names.

    Spans count code points, ends are exclusive, order is by kind, then start. Null and empty
    texts have none and the digest of nothing. Null ids, repeated rows and other columns pass
    through; texts are searched whole.
    """
    row = docs.select(F.struct("*").alias("row"))
    found = row.mapInArrow(
        _find_batches(model),
        f"row {row.schema['row'].dataType.simpleString()}, n_email bigint, n_ip bigint,"
        " n_card bigint, n_phone bigint, base_sha256 string, spans string",
    )
    flat = found.select("row.*", *[F.col(c).alias(f"__{c}") for c in _COLUMNS])
    return replacing(flat, {c: F.col(f"__{c}") for c in _COLUMNS}).drop(*[f"__{c}" for c in _COLUMNS])


def query(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans of each document."""
    return detect(docs.select("doc_id", "text"), train(docs)).drop("text")
