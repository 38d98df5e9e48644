"""Shards of bounded size by extendible hashing.

A shard is a prefix of a row's hash bits. Only a shard over the byte limit is split on one more
bit, so the shards are the leaves of a binary tree, and the directory is the list of leaves. Sizes
are summed once per cell of `STEP` bits; the tree over the cells is built from these sums, and
only rows in cells that are still too large are looked at again, with the next bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loanspan.llm.common import set_aside, text_of, with_results, written

BYTE_LIMIT = 1 << 20
#: Hash bits, the levels of one pass over the sizes, and the cells aimed at for a full shard.
BITS = 60
STEP = 12
CELLS = 4


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 digest of id and text, as a number."""
    digest = F.md5(F.concat_ws("\n", F.coalesce(doc_id.cast("string"), F.lit("")), text))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def _split(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(cell, shard, depth) of the cells, prefixes of `high` bits, whose leaf has between `low`
    and `high` bits. Cells over the limit have none."""
    prefix = F.expr(f"shiftright(cell, {high} - depth)")
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
        "prefix", prefix
    )
    sums = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("held"))
    # The leaf of a cell is its shortest prefix within the limit: longer ones hold no more.
    return (
        levels.join(sums.filter(F.col("held") <= limit), ["depth", "prefix"])
        .groupBy("cell")
        .agg(F.min("depth").alias("depth"))
        .withColumn("shard", F.expr(f"left({_bits('cell', high)}, depth)"))
    )


def _bits(value: str, n: int) -> str:
    return f"right(concat(repeat('0', 64), bin({value})), {n})"


def sharded(docs: DataFrame, limit: int = BYTE_LIMIT) -> DataFrame:
    """`docs` with n_bytes, shard, depth and page, in place of columns of these names.

    `shard` is the row's leaf as a string of `depth` bits, empty while all rows fit one shard; no
    shard and page hold more than `limit` bytes of text. Rows that no bit can part, copies of one
    id and text, go to pages 0, 1, ... of the shard at the last depth; every other page is 0. A
    text over the limit is alone in its page. Null texts have no bytes; null ids hash as empty.
    Other columns pass through, whatever their names; an empty table has no shards.
    """
    text = text_of(F.col("text"))
    size, h = F.octet_length(text).cast("bigint"), row_hash(F.col("doc_id"), text)
    sizes = written(docs.select(size.alias("n_bytes"), h.alias("h")))
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(max(STEP, (CELLS * total // limit).bit_length()), BITS)
    placed, own = set_aside(
        docs,
        n_bytes=size,
        __h=h,
        __shard=F.lit(None).cast("string"),
        __depth=F.lit(None).cast("int"),
    )
    while True:
        cell = F.expr(f"shiftright(h, {BITS - high})")
        cells = written(sizes.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")))
        leaves = written(_split(cells, low, high, limit))
        placed = (
            placed.withColumn("cell", F.expr(f"shiftright(__h, {BITS - high})"))
            .join(leaves, "cell", "left")
            .withColumns(
                {
                    "__shard": F.coalesce("__shard", leaves["shard"]),
                    "__depth": F.coalesce("__depth", leaves["depth"]),
                }
            )
            .drop("cell", leaves["shard"], leaves["depth"])
        )
        over = written(cells.filter(F.col("n_bytes") > limit).select("cell"))
        if high == BITS or over.isEmpty():
            break
        sizes = sizes.withColumn("cell", cell).join(over, "cell", "left_semi").drop("cell")
        low, high = high + 1, min(high + STEP, BITS)
    single = placed.filter("__shard IS NOT NULL").withColumn("__page", F.lit(0).cast("bigint"))
    if not over.isEmpty():
        single = single.union(_pages(placed.filter("__shard IS NULL"), limit))
    return with_results(
        single,
        own,
        {
            "n_bytes": F.col("n_bytes"),
            "shard": F.col("__shard"),
            "depth": F.col("__depth"),
            "page": F.col("__page"),
        },
    )


def _pages(copies: DataFrame, limit: int) -> DataFrame:
    """Copies that share all hash bits, numbered within input partitions, after the copies of the
    partitions before."""
    copies = written(copies.withColumn("__part", F.spark_partition_id()))
    before = Window.partitionBy("__h").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        copies.groupBy("__h", "__part")
        .agg(F.count("*").alias("__n"))
        .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    within = Window.partitionBy("__h", "__part").orderBy("n_bytes")
    place = F.col("__offset") + F.row_number().over(within) - 1
    per_page = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    return (
        copies.join(offsets, ["__h", "__part"])
        .withColumns(
            {
                "__shard": F.expr(_bits("__h", BITS)),
                "__depth": F.lit(BITS),
                "__page": F.floor(place / per_page).cast("bigint"),
            }
        )
        .select(*[c for c in copies.columns if c != "__part"], "__page")
    )


def write(docs: DataFrame, path: str, limit: int = BYTE_LIMIT) -> None:
    """Write `docs` as Parquet, one folder per shard and page below `path`.

    Rows are clustered by shard, so a shard is one file and a task has one file open.
    """
    sharded(docs, limit).withColumn("shard", F.concat(F.lit("s"), "shard")).repartition(
        "shard", "page"
    ).sortWithinPartitions("shard", "page").write.partitionBy("shard", "page").parquet(path)


def query(docs: DataFrame) -> DataFrame:
    """Shard of each document."""
    return sharded(docs.select("doc_id", "text")).drop("text")


SQL = rf"""
WITH hashed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), levels AS (
  SELECT d, (h >> (60 - d)) AS p, sum(n_bytes) AS b FROM hashed, range(61) AS r(d) GROUP BY ALL
), leaves AS (
  SELECT a.d, a.p FROM levels a LEFT JOIN levels up ON up.d = a.d - 1 AND up.p = (a.p >> 1)
  WHERE a.b <= {BYTE_LIMIT} AND (a.d = 0 OR up.b > {BYTE_LIMIT})
)
SELECT doc_id, n_bytes,
  CASE WHEN d = 0 THEN '' ELSE right(lpad(to_base(p, 2), 64, '0'), d::INT) END AS shard,
  d::INT AS depth, 0::BIGINT AS page
FROM hashed JOIN leaves ON p = (h >> (60 - d))
"""

