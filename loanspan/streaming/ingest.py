"""Incremental ingestion: new yearly text files are standardized once and appended.

A file stream with an available-now trigger replaces the bookkeeping of which files are already
done: its checkpoint remembers them, and a restarted job continues without repeating any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanspan.contracts import all_strings
from loanspan.operators.standardize import clean_origination, clean_performance
from loanspan.sources.text import kind_fields


def stream_text(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Stream of pipe text; the vintage is the four digits in each file name."""
    fields, keep = kind_fields(kind)
    return (
        spark.readStream.schema(all_strings(fields))
        .option("sep", "|")
        .option("mode", "FAILFAST")
        # With pruned parsing a row of the wrong length would pass unnoticed.
        .option("columnPruning", "false")
        .option("quote", "\u0000")
        .option("pathGlobFilter", "*.txt")
        .csv(folder)
        .select(
            *keep,
            F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4})", 1).alias("vintage_year"),
        )
    )


def ingest_new_files(
    spark: SparkSession, folder: str, kind: str, out: str, checkpoint: str
) -> None:
    """Clean every file not ingested yet and append it to `out`, partitioned by vintage."""
    clean = clean_origination if kind == "origination" else clean_performance
    query = (
        clean(stream_text(spark, folder, kind))
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("compression", "zstd")
        .partitionBy("vintage_year")
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
