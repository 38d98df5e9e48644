"""Quality rules, secrets, shards and decontamination against plain Python and SQL."""

import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loanspan.llm import decontam, quality, queries, secrets, sharding
from tests.conftest import SF
from tests.llm.conftest import documents

SQL_CHECKED = [
    "op1_quality", "op2_minhash_neardup", "op3_sharding", "op10_decontaminate", "op11_topk",
    "op12_hard_negatives",
]


@pytest.mark.parametrize("name", SQL_CHECKED)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = db.execute(queries.ORACLE[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(result.fetchall())


def quality_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if many[r] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


def test_quality_of_odd_texts(odd, none):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    result = quality.clean_lines(odd)
    rows = result.collect()
    assert len(rows) == 10 and {"lang", "shard", "component_id"} <= set(result.columns)
    for r in rows:
        assert tuple(r[n] for n in names) == quality_counts(r["text"] or "")
    assert not any(r["kept"] for r in rows if r["n_words"] < 20)
    assert quality.clean_lines(none).count() == 0


def test_lines_decide(spark):
    prose = "\n".join(f"Line {i} says something else about {i * 7} other things today." for i in range(8))
    menu = "\n".join(["Home | News | Sport | Weather | More | Contact | About | Help | Jobs"] * 1 + [f"Item {i} | b{i} | c{i} | d{i} | e{i}" for i in range(20)])
    rows = {r["doc_id"]: r for r in quality.query(documents(spark, [prose, menu, prose + "\nAll rights reserved."])).collect()}
    assert rows[0]["kept"] and not rows[1]["kept"] and not rows[1]["base_failed"]
    assert rows[2]["kept"] and rows[2]["n_lines_kept"] == 8


BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]


def secret_spans(text):
    found = [
        (m.start(), k, m.end(), kind)
        for k, (kind, pattern, group, least) in enumerate(BASE)
        for m in re.finditer(pattern, text)
        if len(m.group(group)) >= least
    ]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


def test_secrets_equal_plain_search(spark, small, odd):
    model = secrets.train(small)
    texts = [
        "Token: 'abcdef' PASSWORD=\"12345\" api_key = zzzzzz secret=token=abc", "é AKIA" + "A1" * 8 + " AKIAX",
        "a" * 24 + "0" * 23, "token=" + "0123456789abcdef" * 2 + " x=ghp16C7e42F292c6912E7710c838347Ae178B4a",
        "internationalizationofidentifiers get_user_name_from_table",
    ]
    for docs in (documents(spark, texts), odd, small):
        for r in secrets.scan(docs, model).collect():
            expected = secret_spans(r["text"] or "")
            assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest()
            assert set(expected) <= set(filter(None, r["spans"].split(",")))
            assert r["n_assign"] == sum(x.startswith("assign") for x in expected)
    rows = {r["doc_id"]: r for r in secrets.scan(documents(spark, texts), model).collect()}
    assert rows[3]["n_markov"] == 1 and rows[4]["spans"] == ""


def random_strings(n, seed=11):
    """Strings over three alphabets that no model has seen."""
    draw = np.random.default_rng(seed)
    alphabets = [
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "0123456789ABCDEF",
    ]
    return [
        "".join(draw.choice(list(alphabets[i % 3]), int(draw.integers(24, 44)))) for i in range(n)
    ]


def identifiers(texts, n, seed=12):
    """Names joined from words of texts that the models do not learn from."""
    words = sorted({w for t in texts for w in re.findall(r"[A-Za-z]{3,}", t)})
    draw = np.random.default_rng(seed)
    found = []
    for i in range(n):
        w = [str(x) for x in draw.choice(words, int(draw.integers(3, 6)))]
        styles = ["_".join(w), "-".join(w), "".join(x.capitalize() for x in w), "/".join(w), "_".join(w).upper()]
        found.append(styles[i % 5])
    return found


def test_markov_spans_of_held_out_strings(spark, small):
    apart = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2))
    model = secrets.train(small.filter(apart == 0))
    left = [r["text"] for r in small.filter(apart == 1).select("text").collect() if r["text"]]
    strings, names = random_strings(600), identifiers(left, 600)
    names[:8] = [
        "=" * 30, "-" * 40, "X" * 20, "1234567890123456789", "2024-01-15T10-20-30", "+49-30-1234567-89012",
        "/usr/local/lib/python3/dist-packages", "user_id=1234567890123",
    ]
    docs = documents(spark, [f"see {x} here" for x in strings + names])
    flagged = {
        r["doc_id"]: {s["kind"] for s in r["secret_spans"]} for r in secrets.scan(docs, model).collect()
    }
    caught = sum(bool(flagged[i]) for i in range(600))
    wrong = sum(bool(flagged[i]) for i in range(600, 1200))
    assert caught >= 0.9 * 600 and caught >= 0.95 * (caught + wrong), (caught, wrong)
    assert not any(flagged[i] for i in range(600, 608))


def test_markov_judges_what_fixed_formats_leave(spark, small):
    model = secrets.train(small)
    a, b = "Xq9ZkT4vLr8WmB2nYc7HpNd6", "Gh5JuR3xQe1VtZ8sKw6MfPhJk"
    hexes = "0a1b2c3d4e5f60718293a4b5"
    texts = [f"é {a}_{hexes}_{b} end", f"internationalization_{hexes}_identifiers_of_tables", f"{a} token=abcdefg"]
    docs = documents(spark, texts).withColumn("__text", F.lit(1)).withColumn("__base", F.lit("b")).withColumn("__own_0", F.lit(2))
    scanned = secrets.scan(docs, model)
    rows = {r["doc_id"]: r for r in scanned.collect()}
    assert rows[0]["spans"] == "markov:2:27,hex:27:51,markov:51:77"
    assert rows[1]["n_markov"] == 0 and rows[1]["n_hex"] == 1
    assert rows[2]["spans"] == "markov:0:24,assign:25:38"
    assert all(r["__text"] == 1 and r["__base"] == "b" and r["__own_0"] == 2 for r in rows.values())
    assert scanned.filter("text = ''").count() == 0
    left = {r["doc_id"]: r["text"] for r in secrets.redacted(docs.limit(1)).collect()}
    assert a not in left[0] and b not in left[0] and hexes not in left[0]
    for r in rows.values():
        ends = [(s["start"], s["end"]) for s in r["secret_spans"]]
        assert all(x[1] <= y[0] for x, y in zip(ends, ends[1:], strict=False))


def test_redaction(spark, odd, none):
    docs = documents(spark, ["go token=abcdefgh1 then " + "0a" * 13 + " end", "nothing here"])
    rows = {r["doc_id"]: r for r in secrets.redacted(docs).collect()}
    assert rows[0]["text"] == "go [SECRET] then [SECRET] end" and rows[0]["n_chars"] == 29
    assert rows[1]["text"] == "nothing here"
    out = secrets.redacted(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert secrets.redacted(none).count() == 0


def test_shards(spark, odd, none, tmp_path):
    rows = sharding.sharded(odd, 10_000).collect()
    assert len(rows) == 10
    held = Counter()
    for r in rows:
        held[r["shard"], r["page"]] += r["n_bytes"]
    members = Counter((r["shard"], r["page"]) for r in rows)
    assert all(n <= 10_000 or members[k] == 1 for k, n in held.items())
    # The two long rows share id and text: two pages of one shard at full depth.
    twins = [r for r in rows if r["doc_id"] == 4]
    assert {r["page"] for r in twins} == {0, 1} and len({r["shard"] for r in twins}) == 1
    assert sharding.sharded(none).count() == 0
    clash = documents(spark, ["some text"] * 3).selectExpr("doc_id", "text", "7 AS cell", "8 AS __h", "9 AS __page", "1 AS of_0")
    out = sharding.sharded(clash, 10)
    assert out.columns == [*clash.columns, "n_bytes", "shard", "depth", "page"]
    assert {(r["cell"], r["__h"], r["__page"], r["of_0"]) for r in out.collect()} == {(7, 8, 9, 1)} and out.count() == 3
    docs = documents(spark, [f"text {i} " * (i % 50) for i in range(2000)])
    rows = sharding.sharded(docs, 5000).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["n_bytes"]
    assert len(rows) == 2000 and max(sizes.values()) <= 5000
    # Leaves: no shard is a prefix of another, and a parent would be over the limit.
    names = sorted(sizes)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    for name in names:
        assert sum(n for s, n in sizes.items() if s.startswith(name[:-1])) > 5000
    sharding.write(docs, str(tmp_path / "out"), 5000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000


def contained(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sets = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            sets.setdefault(i, set()).update({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))})
    found = set()
    for d, t in docs:
        w = words(t)
        held = {tuple(w[k : k + n]) for n in range(1, 6) for k in range(len(w) - n + 1)}
        for i, s in sets.items():
            if 100 * len(s & held) >= 80 * len(s) and d is not None:
                found.add((d, i, len(s), len(s & held)))
    return found


def test_decontamination(spark, odd, none):
    item = "the quick brown fox jumps over the lazy dog and runs away from all hunters " * 1
    long = " ".join(f"w{i}" for i in range(300))
    texts = [
        "Before. " + item.upper() + " after", "filler " * 3000 + item, item[:40], long, " ".join(f"w{i}" for i in range(250)),
        "w " + " ".join(f"w{i}" for i in range(200)), "Yes No", "yes, no!", None,
    ]
    docs = documents(spark, texts)
    items = [(1, item), (2, long), (3, "Yes no"), (4, None), (5, ""), (None, "Yes"), (3, "Yes no")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = {tuple(r) for r in decontam.contaminated(docs, bench).collect()}
    assert rows == contained(list(enumerate(texts)), items)
    left = decontam.decontaminated(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == set(range(9)) - {r[0] for r in rows}
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0
    assert decontam.decontaminated(odd, bench).count() == 10
    shared = spark.createDataFrame(
        [(1, item, 0), (1, "clean words", 0), (None, item, 0), (None, "other words", 0)],
        "doc_id bigint, text string, __leaked int",
    )
    left = decontam.decontaminated(shared, bench).collect()
    assert {r["text"] for r in left} == {"clean words", "other words"} and len(left) == 2
