"""Archives as a data source: ``spark.read.format("archive").load(path)``, a row for each file in zip and tar archives.

The reader plans tasks from the archives' own directories: a zip's central directory and a plain tar's headers say where
each member is, so one large archive is read by many tasks, each of them only its members.  A compressed tar can only be
read from its start and is one task.  Conditions on the member's name are applied to the plan, so members that aren't
wanted are never read.  Paths are whatever Arrow's file systems open (local, HDFS, object stores).
"""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "archive string, name string, size long, content binary"
#: Bytes of members, uncompressed, that a task reads, unless the option ``taskBytes`` says otherwise.
TASK_BYTES = 64 << 20


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}") if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)
    return system, inner


def _archives(path: str) -> list[str]:
    """The archive itself, or those in a folder."""
    from pyarrow import fs

    system, inner = _opened(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if system.get_file_info(inner).type == fs.FileType.Directory:
        return sorted(prefix + f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and kind(f.path))
    if not kind(inner):
        raise ValueError(f"not an archive: {path}")
    return [path]


def kind(path: str) -> str | None:
    name = path.lower()
    if name.endswith(".zip"):
        return "zip"
    if name.endswith(".tar"):
        return "tar"
    return "packed tar" if name.endswith((".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")) else None


@dataclass
class Members(InputPartition):
    """Some members of an archive: their names, or places of a plain tar; all of them, if None."""

    archive: str
    kind: str
    members: list[tuple[str, int, int]] | None


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.task_bytes = options["path"], int(options.get("taskBytes", TASK_BYTES))
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = {EqualTo: "equal", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains"}
        for f in filters:
            if type(f) in known and f.attribute == ("name",):
                self.tests.append((known[type(f)], f.value))
            else:
                yield f

    def wanted(self, name: str) -> bool:
        says = {"equal": lambda v: name == v, "in": lambda v: name in v, "starts": name.startswith, "ends": name.endswith, "contains": lambda v: v in name}
        return all(says[test](value) for test, value in self.tests)

    def partitions(self) -> list[Members]:
        out = []
        for path in _archives(self.path):
            what = kind(path)
            if what == "packed tar":
                out.append(Members(path, what, None))
                continue
            system, inner = _opened(path)
            with system.open_input_file(inner) as f:
                if what == "zip":
                    with zipfile.ZipFile(f) as z:
                        members = [(m.filename, m.header_offset, m.file_size) for m in z.infolist() if not m.is_dir()]
                else:
                    with tarfile.open(fileobj=f, mode="r:") as t:
                        members = [(m.name, m.offset_data, m.size) for m in t if m.isfile()]
            task, size = [], 0
            for m in (m for m in members if self.wanted(m[0])):
                if task and size + m[2] > self.task_bytes:
                    out.append(Members(path, what, task))
                    task, size = [], 0
                task.append(m)
                size += m[2]
            if task:
                out.append(Members(path, what, task))
        return out

    def read(self, partition: Members) -> Iterator[tuple[str, str, int, bytes]]:
        system, inner = _opened(partition.archive)
        if partition.kind == "packed tar":
            with system.open_input_stream(inner, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as t:
                for m in t:
                    if m.isfile() and self.wanted(m.name):
                        yield partition.archive, m.name, m.size, t.extractfile(m).read()
            return
        with system.open_input_file(inner) as f:
            if partition.kind == "tar":
                for name, at, size in partition.members:
                    f.seek(at)
                    yield partition.archive, name, size, f.read(size)
                return
            with zipfile.ZipFile(f) as z:
                at = {m.header_offset: m for m in z.infolist()}
                for name, offset, size in partition.members:
                    yield partition.archive, name, size, z.read(at[offset])


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archive(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """archive, name, size, content of the files in an archive, or in the archives of a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive").option("taskBytes", task_bytes).load(path)
