"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set. Each partition has its own number of
MinHash coordinates and of coordinates that must be found, chosen from its largest size, so that
an item contained to 80 % is missed with a chance below one in a billion, whatever the length of
the document: a coordinate is the item's shingle with the least value of one hash function, and a
containing document holds it with a chance of 0.8. Documents too small for a partition never meet
it. Candidates are confirmed by the exact containment of the items' full sets.

Built-in functions only. The coordinates are the small side of the search and are broadcast if
their measured number allows it; the documents' shingles never shuffle then.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.llm.common import row_key, text_of, windows, written

SHINGLE = 5
PERCENT = 80
#: (least set size, coordinates, coordinates that must be found). Sets of up to 16 shingles are
#: searched by all of them; found by chance 0.8 each, fewer than the least has a chance below 1e-9.
PARTITIONS = [(1, 16, 1), (17, 32, 8), (65, 48, 16)]
#: Rows of the small side, 24 bytes each, that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case: punctuation and spacing do not hide a passage."""
    return F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, width, h, size): distinct shingle hashes of each item.

    An item shorter than a shingle is one run of its own width. Null and empty items, and rows
    without item_id, have none. Rows that repeat an item_id make one set.
    """
    words = benchmark.filter("item_id IS NOT NULL").select("item_id", tokens(F.col("text")).alias("w"))
    long = words.filter(F.size("w") >= SHINGLE).select(
        "item_id", F.lit(SHINGLE).alias("width"), F.explode(windows(F.col("w"), SHINGLE)).alias("h")
    )
    short = words.filter((F.size("w") > 0) & (F.size("w") < SHINGLE)).select(
        "item_id", F.size("w").alias("width"), F.xxhash64("w").alias("h")
    )
    each = long.union(short).distinct()
    sizes = each.groupBy("item_id").agg(F.count("*").alias("size"))
    return each.join(sizes, "item_id")


def coordinates(shingles: DataFrame) -> DataFrame:
    """(item_id, h, weight, wanted): MinHash coordinates of each item by size partition.

    `weight` counts the coordinates that a shingle is the least of.
    """
    parts = []
    for i, (least, count, wanted) in enumerate(PARTITIONS):
        until = PARTITIONS[i + 1][0] - 1 if i + 1 < len(PARTITIONS) else None
        part = shingles.filter(F.col("size").between(least, until) if until else F.col("size") >= least)
        if i == 0:
            chosen = part.select("item_id", "h", F.lit(1).cast("bigint").alias("weight"))
        else:
            chosen = (
                part.select(
                    "item_id", "h", F.explode(F.sequence(F.lit(1), F.lit(count))).alias("k")
                )
                .groupBy("item_id", "k")
                .agg(F.min(F.struct(F.xxhash64("h", "k").alias("value"), "h")).alias("m"))
                .groupBy("item_id", F.col("m.h").alias("h"))
                .agg(F.count("*").alias("weight"))
            )
        parts.append(chosen.withColumn("wanted", F.lit(wanted).cast("bigint")))
    return reduce(DataFrame.union, parts)


def document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(row columns, h): distinct shingle hashes of each document, of each width."""
    hashes = [F.array_distinct(windows(F.col("__w"), width)) for width in widths]
    return docs.withColumn("__w", tokens(F.col("text"))).select(
        "doc_id", F.explode(F.concat(*hashes) if len(hashes) > 1 else hashes[0]).alias("h")
    )


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): items contained in documents to 80 % or more.

    Containment is the share of an item's distinct five-word shingles that the document holds.
    Null and empty documents contain nothing; rows without doc_id are not searched. Rows that
    repeat a doc_id are one document. No items, no documents: no rows.
    """
    docs = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    shingles = written(item_shingles(benchmark))
    wanted = written(coordinates(shingles))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    # At most SHINGLE widths exist.
    widths = sorted(r.width for r in shingles.select("width").distinct().collect()) or [SHINGLE]
    found = (
        document_shingles(docs, widths)
        .join(small(wanted), "h")
        .groupBy("doc_id", "item_id", "h", "weight", "wanted")
        .agg(F.lit(1).alias("held"))
        .groupBy("doc_id", "item_id", "wanted")
        .agg(F.sum("weight").alias("found"))
        .filter(F.col("found") >= F.col("wanted"))
        .select("doc_id", "item_id")
    )
    candidates = written(found)
    ids = candidates.select(F.col("doc_id").alias("id")).distinct()
    texts = docs.join(small(ids), F.col("doc_id") == F.col("id"), "left_semi")
    held = (
        document_shingles(texts, widths)
        .join(small(shingles), "h")
        .select("doc_id", "item_id", "h", "size")
        .distinct()
        .groupBy("doc_id", "item_id", "size")
        .agg(F.count("*").alias("n_shared"))
        .filter(100 * F.col("n_shared") >= PERCENT * F.col("size"))
    )
    return held.join(candidates, ["doc_id", "item_id"], "left_semi").select(
        "doc_id", "item_id", F.col("size").alias("n_item_shingles"), "n_shared"
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that contain an item; each row is judged by its own text, whether its
    doc_id is null, repeated or neither. All columns of `docs` are returned, whatever their names."""
    rows = docs.select(row_key(), "text", F.struct("*").alias("doc"))
    leaked = contaminated(rows.select(F.col("row").alias("doc_id"), "text"), benchmark)
    leaked = leaked.select(F.col("doc_id").alias("row")).distinct()
    return rows.join(leaked, "row", "left_anti").select("doc.*")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
), ig AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS width, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM iw WHERE len(w) > 0)
), dg AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i : i + width - 1], ' ') AS g FROM (
    SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
    FROM dw, (SELECT DISTINCT width FROM ig) WHERE len(w) >= width)
), sizes AS (SELECT item_id, count(*) AS n FROM ig GROUP BY item_id),
shared AS (
  SELECT doc_id, item_id, count(*) AS c FROM dg JOIN ig USING (width, g) GROUP BY ALL
)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared
FROM shared JOIN sizes USING (item_id) WHERE 100 * c >= 80 * n
"""
