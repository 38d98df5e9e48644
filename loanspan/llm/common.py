"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanspan.functions.durable import shared_folder

#: White space that separates words, as a character class of Java, RE2 and Python regexes.
SPACE = r"[\x20\x09-\x0D]"
#: Rows of a batch that a task turns into Python values at a time.
PIECE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(text: Column) -> Column:
    """The text; an empty one for null."""
    return F.coalesce(text, F.lit(""))


def words_of(text: Column) -> Column:
    """Runs of characters other than white space, in order."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def windows(words: Column, n: int) -> Column:
    """One 64-bit hash for each run of `n` neighbouring words; empty if there are fewer."""
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - (n - 1)),
        lambda i: F.xxhash64(F.slice(words, i, n)),
    )
    return F.when(F.size(words) >= n, hashes).otherwise(F.array().cast("array<bigint>"))


def replacing(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with result columns at the end; a column of `df` with such a name is replaced.

    Names differ as Spark tells them apart, that is without regard to case.
    """
    new = {name.lower() for name in columns}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in new]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def set_aside(docs: DataFrame, **columns: Column) -> tuple[DataFrame, dict[str, Column]]:
    """`docs` with `columns`, and its own columns under names that no operator uses.

    The second value has these columns by their former names, to be selected at the end.
    """
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    frame = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in own.items()], *[v.alias(n) for n, v in columns.items()]
    )
    return frame, {c: F.col(n) for c, n in own.items()}


def with_results(df: DataFrame, own: dict[str, Column], columns: dict[str, Column]) -> DataFrame:
    """The columns set aside, and result columns at the end in place of those of such a name."""
    new = {name.lower() for name in columns}
    kept = [value.alias(name) for name, value in own.items() if name.lower() not in new]
    return df.select(*kept, *[value.alias(name) for name, value in columns.items()])


def row_key() -> Column:
    """`row`: 64 bits of doc_id and text, which tell documents apart where ids are null or repeated."""
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text")).alias("row")


def pieces(batches, rows: int = PIECE_ROWS):
    """The rows of all batches, in order, in slices of `rows` rows at most.

    A Spark batch has 10,000 rows however long they are: as Python values, with results of the same
    size, they would take most of a worker's memory. Memory that Arrow keeps after a batch goes back
    to the system, since workers live on from stage to stage.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
        pa.default_memory_pool().release_unused()


def written(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read again.

    This cuts the lineage with files that outlive executors. They are removed when the driver's
    JVM ends, since the result may be read until then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
