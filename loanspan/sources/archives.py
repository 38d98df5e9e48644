"""Yearly ZIP archives holding one origination and one performance text member.

A deflate stream cannot be split, so a member is one task; it is read as a stream, so its size does not
matter. Archives lie in any file system that Arrow opens (local or shared paths, hdfs, s3, gs, ...).
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loanspan.sources.text import kind_fields, split_lines

#: Bytes of a member that are unpacked at a time.
CHUNK = 4 << 20
# Member names inside a yearly archive.
MEMBERS = {"origination": "sample_orig_{year}.txt", "performance": "sample_perf_{year}.txt"}


def _opened(path: str):
    system, inside = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    return system.open_input_file(inside)


def member_lines(path: str, member: str, tag: str) -> Iterator[pa.RecordBatch]:
    """Tagged lines of the archive's member of that name, in whatever folder it lies, by batches."""
    with _opened(path) as file, zipfile.ZipFile(file) as archive:
        found = [n for n in archive.namelist() if n.rsplit("/", 1)[-1] == member]
        if not found:
            raise ValueError(f"{path} holds no member {member}.")
        with archive.open(found[0]) as stream:
            rest, first = b"", True
            while chunk := stream.read(CHUNK):
                if first:
                    chunk, first = chunk.removeprefix(b"\xef\xbb\xbf"), False
                *lines, rest = (rest + chunk).split(b"\n")
                if lines:
                    yield _lines(lines, tag)
            if rest:
                yield _lines([rest], tag)


def _lines(lines: list[bytes], tag: str) -> pa.RecordBatch:
    texts = pa.array([line.rstrip(b"\r").decode() for line in lines], pa.string())
    return pa.RecordBatch.from_arrays(
        [texts, pa.repeat(pa.scalar(tag), len(texts))], names=["value", "vintage_year"]
    )


class Member(InputPartition):
    """One archive's member."""

    def __init__(self, path: str, member: str, tag: str):
        self.path, self.member, self.tag = path, member, tag


class MemberReader(DataSourceReader):
    def __init__(self, options: dict):
        self.members = json.loads(options["members"])

    def partitions(self) -> list[Member]:
        return [Member(*m) for m in self.members]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        return member_lines(partition.path, partition.member, partition.tag)


class MemberLines(DataSource):
    """Data source `archive_lines`: option `members` is a JSON list of [archive, member, year]."""

    @classmethod
    def name(cls) -> str:
        return "archive_lines"

    def schema(self) -> str:
        return "value string, vintage_year string"

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options)


def scan_archives(spark: SparkSession, paths, kind: str, vintage_year: int) -> DataFrame:
    """Kept columns of the wanted member of each archive, tagged with the vintage year."""
    return scan_yearly_archives(spark, {vintage_year: paths}, kind)


def scan_yearly_archives(spark: SparkSession, paths: dict, kind: str) -> DataFrame:
    """`scan_archives` of the paths of several vintage years in one scan.

    An archive without the wanted member fails the query. The listing holds file names only, as that
    of any scan does.
    """
    kind_fields(kind)
    members = []
    for year, where in paths.items():
        listed = spark.read.format("binaryFile").load(where).select("path").toArrow()
        found = sorted(listed["path"].to_pylist())
        members += [[path, MEMBERS[kind].format(year=year), str(year)] for path in found]
    spark.dataSource.register(MemberLines)
    lines = spark.read.format(MemberLines.name()).option("members", json.dumps(members)).load()
    return split_lines(lines, kind)


def write_archives(lines: DataFrame, kind: str, vintage_year: int, folder: str) -> None:
    """One archive for each partition of `lines` (value), written as a stream.

    Archives appear under their name when they are whole, so a task that is run again leaves none
    in part. Empty partitions write none.
    """
    member = MEMBERS[kind].format(year=vintage_year)

    def write(batches):
        from pyspark import TaskContext

        system, inside = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        part, first = TaskContext.get().partitionId(), next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        system.create_dir(inside)
        whole, begun = f"{inside}/{kind}_{vintage_year}_{part}.zip", f"{inside}/.{uuid.uuid4().hex}"
        with system.open_output_stream(begun) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as archive:
            with archive.open(member, "w", force_zip64=True) as stream:
                batch = first
                while batch is not None:
                    for text in batch.column(0).to_pylist():
                        stream.write(text.encode() + b"\n")
                    batch = next(batches, None)
        system.move(begun, whole)
        yield pa.RecordBatch.from_arrays([pa.array([whole])], names=["path"])

    lines.select("value").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
