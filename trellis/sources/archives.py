"""Archives read without unpacking: ``spark.read.format("archive_member").option("path", file)`` gives a row a member.

Every member of a zip file is a partition of its own, read in place; a tar.gz can only be read from its beginning, so each
of ``partitions`` tasks streams it once and keeps its share of the members. Names are judged before anything is read: one
that leaves the archive (absolute, drive, ``..``), links, and members or totals beyond the given sizes refuse the archive.
A member that holds more than its header says is refused where it is read. Paths are local or on a file system that every
executor mounts.

Columns: name, rank (of the kinds of text that are candidates: jsonl, csv, txt, md; null for others and read-me files),
size, content. Options: member_bytes, total_bytes, partitions (tar.gz), candidates (true: candidates alone).
"""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import BadInput

SCHEMA = "name string, rank int, size long, content binary"
# Suffixes of files that may hold a source's text, in order.
CANDIDATES = (".jsonl", ".csv", ".txt", ".md")
READ_ME = "README.md"
MEMBER_BYTES, TOTAL_BYTES, PARTITIONS = 1 << 30, 1 << 38, 8


def safe_name(name: str) -> str:
    """The name, if it stays below the archive's root."""
    parts = PurePosixPath(name.replace("\\", "/")).parts
    if not parts or name.startswith(("/", "\\")) or ".." in parts or ":" in parts[0] or "\x00" in name:
        raise BadInput(f"unsafe archive member path: {name!r}")
    return name


def rank_of(name: str) -> int | None:
    path = PurePosixPath(name)
    return CANDIDATES.index(path.suffix.lower()) if path.suffix.lower() in CANDIDATES and path.name != READ_ME else None


class Archive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive_member"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.most, self.total = int(options.get("member_bytes", MEMBER_BYTES)), int(options.get("total_bytes", TOTAL_BYTES))
        self.parts, self.only = int(options.get("partitions", PARTITIONS)), options.get("candidates", "false").lower() == "true"
        self.zipped = zipfile.is_zipfile(self.path)

    def members(self) -> list[tuple[str, int]]:
        """(name, size) of all files, from headers alone; refuses what is unsafe or too large."""
        found = []
        if self.zipped:
            with zipfile.ZipFile(self.path) as archive:
                for m in archive.infolist():
                    if (m.external_attr >> 16) & 0o170000 == 0o120000:
                        raise BadInput(f"archive member is a link: {m.filename!r}")
                    if not m.is_dir():
                        found.append((safe_name(m.filename), m.file_size))
        else:
            with tarfile.open(self.path, "r:gz") as archive:
                for m in archive:
                    safe_name(m.name)
                    if m.issym() or m.islnk() or not (m.isfile() or m.isdir()):
                        raise BadInput(f"archive member is no file: {m.name!r}")
                    if m.isfile():
                        found.append((m.name, m.size))
        if large := [n for n, size in found if size > self.most]:
            raise BadInput(f"archive members are too large: {large[:5]}")
        if sum(size for _, size in found) > self.total:
            raise BadInput("the archive is too large")
        if len({n for n, _ in found}) < len(found):
            raise BadInput("archive member names repeat")
        return [(n, size) for n, size in found if not self.only or rank_of(n) is not None]

    def partitions(self) -> list[InputPartition]:
        names = [n for n, _ in self.members()]
        if self.zipped:
            return [InputPartition([n]) for n in names] or [InputPartition([])]
        return [InputPartition(names[i :: self.parts]) for i in range(min(self.parts, len(names)))] or [InputPartition([])]

    def _row(self, name: str, size: int, content: bytes) -> tuple:
        if len(content) != size:
            raise BadInput(f"archive member does not have the size that its header says: {name!r}")
        return name, rank_of(name), size, content

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        wanted = set(partition.value)
        if self.zipped:
            with zipfile.ZipFile(self.path) as archive:
                for name in partition.value:
                    size = archive.getinfo(name).file_size
                    with archive.open(name) as f:
                        yield self._row(name, size, f.read(size + 1))
        elif wanted:
            with tarfile.open(self.path, "r:gz") as archive:
                for m in archive:
                    if m.name in wanted:
                        yield self._row(m.name, m.size, archive.extractfile(m).read())


def members(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(Archive)
    return spark.read.format("archive_member").options(path=path, **{k: str(v).lower() for k, v in options.items()}).load()


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """path, rank, name, text of the candidates, the likeliest first."""
    return members(spark, path, candidates=True).select("name", "rank", F.col("content").cast("string").alias("text")).orderBy("rank", "name")
