"""Near-duplicates: which texts are shuffled, and the same results when keys are too many to broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from loanspan.llm import neardup
from tests.llm.conftest import documents
from tests.llm.test_free import groups


def _texts():
    """Forty texts, each with up to three near copies, exact copies and odd ones."""
    r = random.Random(5)
    texts = []
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(80)]
        texts.append(" ".join(words))
        for _ in range(i % 4):
            copy = list(words)
            copy[r.randrange(80)] = f"v{len(texts)}"
            texts.append(" ".join(copy))
    return [*texts, texts[0], texts[7], "two words", "TWO words", "", None]


@pytest.fixture
def merged(spark):
    """Joins as on large tables: nothing is small enough to be broadcast of itself."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_kept_texts_are_not_shuffled(spark, merged, capsys):
    kept = neardup.deduplicated(documents(spark, _texts()))
    capsys.readouterr()
    kept.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    expected = groups(list(enumerate(_texts())), 5)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, least) in expected.items() if d == least}


@pytest.mark.parametrize("dense", [8, 0])
def test_many_keys_give_the_same_groups(spark, merged, monkeypatch, dense):
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neardup, "DENSE", dense)
    if not dense:
        monkeypatch.setattr(neardup, "SMALL", 2)
    docs = documents(spark, _texts())
    expected = groups(list(enumerate(_texts())), 4)
    rows = neardup.similar_groups(docs, n=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected
    expected = groups(list(enumerate(_texts())), 5)
    kept = [r["doc_id"] for r in neardup.deduplicated(docs).collect()]
    assert sorted(kept) == sorted(d for d, (_, least) in expected.items() if d == least)


def test_bitmap_lists_every_key_and_few_others(spark):
    rows = spark.range(-20_000, 20_000).select(
        F.when(F.col("id") % 500 != 0, F.col("id")).alias("row"), F.col("id").cast("string").alias("text")
    )
    keys = spark.range(-20_000, 20_000).filter("pmod(id, 8) = 3 AND id % 500 <> 0").select(F.col("id").alias("key"))
    listed = neardup._listed(rows, "row", keys)
    assert listed.columns == ["row", "text", "listed"] and listed.count() == 40_000
    wanted = F.coalesce(F.pmod("row", F.lit(8)) == 3, F.lit(False))
    by = {r["wanted"]: r for r in listed.groupBy(wanted.alias("wanted")).agg(
        F.count("*").alias("n"), F.sum(F.col("listed").cast("int")).alias("listed")
    ).collect()}
    assert by[True]["n"] == by[True]["listed"] > 0
    assert by[False]["listed"] < by[False]["n"] / 10
    assert not neardup._listed(rows, "row", keys.limit(0)).filter("listed").count()


def test_rows_without_dropped_ones(spark, merged, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 2900).alias("row"), F.lit("x").alias("text"))
    dropped = spark.range(0, 2900, 5).select(F.col("id").alias("row"))
    expected = sorted(i % 2900 for i in range(3000) if i % 2900 % 5)
    for most in (500_000, 0):
        monkeypatch.setattr(neardup, "BROADCAST_ROWS", most)
        assert sorted(r["row"] for r in neardup._without(rows, dropped).collect()) == expected
