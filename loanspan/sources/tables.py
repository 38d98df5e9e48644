"""Parquet and CSV tables, and the sinks that publish them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanspan.contracts import ContractError


def _filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object, so any store the cluster mounts works."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _filesystem(spark, path)
    return fs.exists(target)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, target = _filesystem(spark, path)
    fs.delete(target, True)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    """One lazy scan over any number of Parquet paths."""
    return spark.read.parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_any(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """`<base>.csv` if present, else `<base>.parquet`, else an empty frame of the schema."""
    if path_exists(spark, f"{base}.csv"):
        return read_csv(spark, f"{base}.csv", schema)
    if path_exists(spark, f"{base}.parquet"):
        return spark.read.parquet(f"{base}.parquet")
    return spark.createDataFrame([], schema)


def write_parquet(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Iterable[str] = (),
    sort_by: Iterable[str] = (),
) -> str:
    """Zstandard Parquet. Files are sorted inside, never globally."""
    keys = list(sort_by)
    writer = (df.sortWithinPartitions(*keys) if keys else df).write.mode(mode)
    parts = list(partition_by)
    if parts:
        writer = writer.partitionBy(*parts)
    writer.option("compression", "zstd").parquet(path)
    return path


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_vintages(df: DataFrame, path: str, force: bool = False) -> str:
    """Materialize by `vintage_year` partition.

    Without `force` only vintages not yet on disk are written; with it the vintages in `df` replace
    their partitions and others stay.
    """
    spark = df.sparkSession
    if not force and path_exists(spark, path):
        done = spark.read.parquet(path).select(F.col("vintage_year").cast("int")).distinct()
        fresh = df.join(done, df["vintage_year"].cast("int") == done["vintage_year"], "left_anti")
        fresh.write.mode("append").partitionBy("vintage_year").option(
            "compression", "zstd"
        ).parquet(path)
        return path
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("vintage_year")
        .parquet(path)
    )
    return path


def export_checked(
    df: DataFrame, path: str, validate: Callable[[DataFrame], object], partition_by=()
) -> str:
    """Write to a staging path, re-read and validate it, then move it to the final path.

    The final path keeps its old contents when validation fails. The old table is moved aside, not
    deleted, until the new one is in place: after a crash in between it is at `<path>__previous`,
    and it is moved back when the second move fails.
    """
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}__staging"
    write_parquet(df, staging, partition_by=partition_by)
    written = spark.read.parquet(staging)
    if written.isEmpty():
        raise ContractError(f"{path}: refusing to publish an empty table.")
    validate(written)
    fs, final = _filesystem(spark, path)
    _, source = _filesystem(spark, staging)
    _, previous = _filesystem(spark, f"{path.rstrip('/')}__previous")
    if fs.exists(final):
        fs.delete(previous, True)
        if not fs.rename(final, previous):
            raise ContractError(f"{path}: could not move the old table aside.")
    if not fs.rename(source, final):
        if fs.exists(previous):
            fs.rename(previous, final)
        raise ContractError(f"{path}: could not move the validated table into place.")
    fs.delete(previous, True)
    return path


def _pointers(spark: SparkSession, root: str) -> dict[int, str]:
    """Numbered pointer files of a folder, by number."""
    fs, folder = _filesystem(spark, f"{root.rstrip('/')}/pointers")
    if not fs.exists(folder):
        return {}
    names = [str(f.getPath().getName()) for f in fs.listStatus(folder)]
    return {int(n): f"{root.rstrip('/')}/pointers/{n}" for n in names if n.isdigit()}


def point(spark: SparkSession, root: str, target: str, expected: int | None = None) -> int:
    """Make `target` what the folder's highest pointer names, and return the pointer's number.

    A pointer is a file that is created once and never changed or replaced, so two publications get
    two numbers whatever the clock says. Where another one takes the same number first, or the
    highest number is not the `expected` one, this one fails and changes nothing.
    """
    last = max(_pointers(spark, root), default=0)
    if expected is not None and expected != last:
        raise ContractError(f"{root}: expected pointer {expected}, found {last}.")
    fs, place = _filesystem(spark, f"{root.rstrip('/')}/pointers/{last + 1:010d}")
    try:
        stream = fs.create(place, False)
    except Exception as error:
        if fs.exists(place):
            raise ContractError(f"{root}: pointer {last + 1} was published meanwhile.") from error
        raise
    stream.write(f"{target}\n".encode())
    stream.close()
    return last + 1


def pointed(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, target) of all pointers, the highest first.

    A pointer whose writer died in between has no full line and counts for nothing.
    """
    found = []
    for number, path in sorted(_pointers(spark, root).items(), reverse=True):
        fs, place = _filesystem(spark, path)
        stream = fs.open(place)
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text.endswith("\n"):
            found.append((number, text[:-1]))
    return found


def publish_snapshot(
    df: DataFrame,
    root: str,
    validate: Callable[[DataFrame], object],
    expected: int | None = None,
    partition_by=(),
) -> int:
    """Write `df` as a new version under `root`, check it as stored, and switch to it.

    Readers see the old version until one new file names the new one, so there is no moment without a
    table. A version that fails its check, is empty or loses against another publication is never
    named. Returns the version's number.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    write_parquet(df, f"{root.rstrip('/')}/{version}", partition_by=partition_by)
    written = spark.read.parquet(f"{root.rstrip('/')}/{version}")
    if written.isEmpty():
        raise ContractError(f"{root}: refusing to publish an empty table.")
    validate(written)
    return point(spark, root, version, expected)


def read_snapshot(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The current version, or an earlier one by number."""
    for found, version in pointed(spark, root):
        if number in (None, found):
            return spark.read.parquet(f"{root.rstrip('/')}/{version}")
    raise ContractError(f"{root}: no such version is published.")
