"""Durable intermediate results for jobs that scan the same rows many times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from loanspan.sources.tables import remove_path


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    Only a local session without the setting falls back to a temporary folder: on a cluster a
    machine-local folder would be lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a shared folder.")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"loanspan-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


@contextmanager
def durable(df: DataFrame):
    """Write `df` once as Parquet in the shared folder and yield the written table.

    Later scans read columns from files that survive executor loss, instead of recomputing the
    lineage or relying on executor caches. The files go away when the block ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.parquet(path)
    finally:
        remove_path(spark, path)
