"""Arrow IPC files as a distributed source and sink.

``read_arrow`` opens a file or folder of IPC files by a Python data source whose partitions are runs of record
batches: a task seeks to its batches and hands them over one at a time, so nothing passes the driver and memory is
that of a batch. Files in the stream format have no index; each is one partition and streams.

``write_arrow`` writes one file a task. The driver then names the files of the attempts that counted in a manifest;
readers of a folder with a manifest read those only, so lost or repeated tasks leave nothing behind that is read.

Paths are those of pyarrow's file systems (local, hdfs, s3, gs). An empty folder or a file without batches has no rows;
files of a folder share the first one's schema, by column name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from veilframe.plans.budget import PrivacyError

NAME, MANIFEST, MAGIC, RUN = "arrow_ipc", "_manifest.json", b"ARROW1", 16


def located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("/"):
        path = f"file://{path}"
    elif path.startswith("file:/") and not path.startswith("file://"):
        path = f"file://{path[5:]}"
    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> tuple[fs.FileSystem, list[str]]:
    """The files that are read of a path, in order."""
    store, root = located(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise PrivacyError(f"no such file: {path}")
    if info.type == fs.FileType.File:
        return store, [root]
    manifest = store.get_file_info(f"{root}/{MANIFEST}")
    if manifest.type == fs.FileType.File:
        with store.open_input_stream(manifest.path) as f:
            return store, [f"{root}/{name}" for name in json.loads(f.read())]
    found = store.get_file_info(fs.FileSelector(root, recursive=True))
    return store, sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def _is_stream(source: pa.NativeFile) -> bool:
    magic = source.read(len(MAGIC))
    source.seek(0)
    return magic != MAGIC


@dataclass
class Run(InputPartition):
    """Batches ``lo`` to ``hi - 1`` of a file; all that a stream holds if ``hi`` is None."""

    file: str
    lo: int
    hi: int | None


class ArrowReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, run: int):
        self.path, self.schema, self.run = path, to_arrow_schema(schema), run

    def partitions(self) -> list[Run]:
        store, files = files_of(self.path)
        out = []
        for name in files:
            with store.open_input_file(name) as source:
                if _is_stream(source):
                    out.append(Run(name, 0, None))
                else:  # the footer alone is read
                    n = pa.ipc.open_file(source).num_record_batches
                    out += [Run(name, lo, min(lo + self.run, n)) for lo in range(0, n, self.run)]
        return out

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # there are none
            return
        store, _ = located(self.path)
        with store.open_input_file(partition.file) as source:
            if partition.hi is None:
                batches = iter(pa.ipc.open_stream(source))
            else:
                opened = pa.ipc.open_file(source)
                batches = (opened.get_batch(i) for i in range(partition.lo, partition.hi))
            for b in batches:
                yield b.select(self.schema.names).cast(self.schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, to_arrow_schema(schema), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = located(self.path)
        store.create_dir(root, recursive=True)
        name, writer = f"part-{uuid.uuid4().hex}.arrow", None
        for b in iterator:
            if writer is None:
                sink = store.open_output_stream(f"{root}/{name}", compression=None)
                writer = pa.ipc.new_file(sink, self.schema)
            writer.write_batch(b.cast(self.schema))
        if writer is None:
            return Written([])
        writer.close()
        sink.close()
        return Written([name])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = located(self.path)
        store.create_dir(root, recursive=True)
        own = sorted(name for m in messages if m for name in m.files)
        listed = store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File
        before = [] if self.overwrite or not listed else [f.rpartition("/")[2] for f in files_of(self.path)[1]]
        if not own and not before:  # the schema of an empty table
            own = [f"part-{uuid.uuid4().hex}.arrow"]
            with store.open_output_stream(f"{root}/{own[0]}", compression=None) as sink, pa.ipc.new_file(sink, self.schema):
                pass
        scratch = f"{root}/_{uuid.uuid4().hex}"
        with store.open_output_stream(scratch, compression=None) as f:
            f.write(json.dumps(before + own).encode())
        store.move(scratch, f"{root}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = located(self.path)
        for m in messages:
            for name in m.files if m else ():
                store.delete_file(f"{root}/{name}")


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_ipc").load(path)``; option ``batches``: record batches a partition."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        store, files = files_of(self.options["path"])
        if not files:
            raise PrivacyError("no Arrow file to take a schema from")
        with store.open_input_file(files[0]) as source:
            opened = (pa.ipc.open_stream if _is_stream(source) else pa.ipc.open_file)(source)
            return from_arrow_schema(opened.schema, prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.options["path"], schema, int(self.options.get("batches", RUN)))

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"], schema, overwrite)


def read_arrow(spark: SparkSession, path: str, batches: int = RUN) -> DataFrame:
    """A file or folder of Arrow IPC files, ``batches`` record batches a partition."""
    spark.dataSource.register(ArrowFiles)
    return spark.read.format(NAME).option("batches", batches).load(path)


def write_arrow(df: DataFrame, path: str, mode: str = "append") -> None:
    """Arrow IPC files, one a task; ``mode``: append or overwrite."""
    df.sparkSession.dataSource.register(ArrowFiles)
    df.write.format(NAME).mode(mode).save(path)
