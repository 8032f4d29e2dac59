"""Spark source and sink ``entrylog``: files of checksummed entries.

Reading: one partition a file, as chunks of a domain are files of a bounded
size. Values of external entries stay links; ``external.read_values`` joins
them. Writing: each task writes files of at most FILE_BYTES and an entry, so that
one fits into a reader's memory at any size of the input, under temporary names,
and the commit on the driver gives them their names, so a lost task leaves no
entries behind.
External values have the checksum of their content in their names, so tasks
name them themselves, and a task that runs again writes the same files. As a
stream, the driver looks at file lengths only; a task returns the entries that
became whole between two lengths.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schemas import FLAG_EXTERNAL, LOG
from .codec import Entry, link, made, scan

_BATCH = 4096
#: A writer goes on in a new file beyond this size.
FILE_BYTES = 1 << 22
#: Rows that a writer has as Python objects at a time.
_ROWS = 256


def _columns(name: str, entries: list[Entry]) -> pa.RecordBatch:
    links = [link(e.value) if e.flags & FLAG_EXTERNAL else (None, None) for e in entries]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * len(entries), pa.string()), pa.array([e.pos for e in entries], pa.int64()), pa.array([e.size for e in entries], pa.int64()),
            pa.array([e.time for e in entries], pa.int64()), pa.array([e.entry_id for e in entries], pa.int64()), pa.array([e.flags for e in entries], pa.int32()),
            pa.array([e.key for e in entries], pa.binary()), pa.array([None if e.flags & FLAG_EXTERNAL else e.value for e in entries], pa.binary()),
            pa.array([x for _, x in links], pa.string()), pa.array([x for x, _ in links], pa.int64()),
        ],
        [x.split()[0] for x in LOG.split(", ")],
    )


def _batches(name: str, entries: Iterator[Entry]) -> Iterator[pa.RecordBatch]:
    held: list[Entry] = []
    for entry in entries:
        held.append(entry)
        if len(held) == _BATCH:
            yield _columns(name, held)
            held = []
    if held:
        yield _columns(name, held)


def decoded(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Entries of all files under path, read by Spark's own file source, so from any store that it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(name, scan(data.as_py(), start))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, LOG)


@dataclass
class _File(InputPartition):
    path: str
    start: int
    end: int | None = None


def _listed(path: str) -> list[pafs.FileInfo]:
    fs, base = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    return sorted((x for x in found if x.is_file and x.extension == "log"), key=lambda x: x.path)


def _content(path: str, root: str, start: int = 0, end: int | None = None) -> bytes:
    fs = pafs.FileSystem.from_uri(root)[0] if "://" in root or root.startswith("file:") else pafs.LocalFileSystem()
    with fs.open_input_file(path) as file:
        file.seek(start)
        return file.read() if end is None else file.read(end - start)


def _shifted(entries: Iterator[Entry], by: int) -> Iterator[Entry]:
    return (e._replace(pos=e.pos + by) for e in entries)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.start = options["path"], int(options.get("startpos", 0))

    def partitions(self) -> list[InputPartition]:
        return [_File(x.path, self.start) for x in _listed(self.path)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        data = _content(partition.path, self.path, partition.start)
        yield from _batches(partition.path, _shifted(scan(data), partition.start))


class _Follower(DataSourceStreamReader):
    """The offset is the length of each file.

    A task reads its file, a chunk of bounded size, from the beginning, as only
    entries tell where entries begin; it returns those that end behind the
    former length. An entry that is half written comes once it is whole.
    """

    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {x.path: x.size for x in _listed(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(p, start.get(p, 0), e) for p, e in sorted(end.items()) if e > start.get(p, 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        data = _content(partition.path, self.path, 0, partition.end)
        yield from _batches(partition.path, (e for e in scan(data, follow=True) if e.pos + e.size > partition.start))

    def commit(self, end: dict) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _Writer(DataSourceArrowWriter):
    """Appends files. Values that are too long go to files of their own beside them."""

    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"]
        self.at = [schema.fieldNames().index(c) for c in ("time", "entry_id", "flags", "key", "value")]

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        fs, base = self._fs()
        fs.create_dir(base, recursive=True)
        task, known, names, out, size = uuid.uuid4().hex, set(), [], None, 0
        try:
            for batch in batches:
                for k in range(0, batch.num_rows, _ROWS):
                    part, raws = batch.slice(k, _ROWS), []
                    for time, entry_id, flags, key, value in zip(*(part.column(k).to_pylist() for k in self.at), strict=True):
                        raw, external = made(key or b"", value or b"", time, entry_id, flags or 0)
                        raws.append(raw)
                        if external and external not in known:
                            with fs.open_output_stream(f"{base}/{external}.{task}.partial") as file:
                                file.write(value or b"")
                            fs.move(f"{base}/{external}.{task}.partial", f"{base}/{external}")
                            known.add(external)
                    for raw in raws:
                        if out is not None and size >= FILE_BYTES:
                            out.close()
                            out = None
                        if out is None:
                            names.append(f"{base}/{task}-{len(names):06d}.log")
                            out, size = fs.open_output_stream(f"{names[-1]}.partial"), 0
                        out.write(raw)
                        size += len(raw)
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages: list) -> None:
        fs, _ = self._fs()
        for name in sorted({n for m in messages if m for n in m.names}):  # names only
            if fs.get_file_info(f"{name}.partial").is_file:
                fs.move(f"{name}.partial", name)

    def abort(self, messages: list) -> None:
        """Drops the logs; values without an entry stay, and a later write of the same ones finds them."""
        fs, _ = self._fs()
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(f"{name}.partial")


class EntryLog(DataSource):
    """Options: path; startpos (batch reads only)."""

    @classmethod
    def name(cls) -> str:
        return "entrylog"

    def schema(self) -> str:
        return LOG

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Follower(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EntryLog)


def read_values(entries: DataFrame, path: str, verify: bool = True) -> DataFrame:
    """entries of the log at path with the values of external ones filled in.

    An external value stays null if its file is missing, and with verify if its
    checksum differs.
    """
    files = entries.sparkSession.read.format("binaryFile").option("pathGlobFilter", "value-*").load(path)
    files = files.select(F.regexp_extract("path", r"(value-[0-9a-f]+-[0-9a-f]+)$", 1).alias("ext_file"), F.col("content").alias("_content"))
    joined = entries.join(files, "ext_file", "left")
    good = F.col("_content").isNotNull() & (F.lit(not verify) | (F.crc32("_content") == F.col("ext_crc")))
    return joined.withColumn("value", F.when(F.col("ext_file").isNull(), F.col("value")).when(good, F.col("_content"))).select(entries.columns)
