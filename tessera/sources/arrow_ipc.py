"""Arrow IPC as a Python data source (survey S5): streams and files, split into tasks at record batches.

Both forms are a sequence of messages: a mark, the length of the metadata, the metadata, the body. A file has a magic
before them and a footer behind. A task gets a range of bytes of one file and reads the record batches whose messages
begin in it; of the messages before, it reads the lengths alone, and the dictionaries that its batches may use. Files
are opened by their URI in the tasks, through the file systems of pyarrow, so they can be remote; plain paths are local.

An empty folder, and a stream without a schema, is an error; a file without batches has no rows. Hidden files (``.``,
``_``) are passed over. All files must have the schema of the first, in the order of their names.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

SPLIT_BYTES = 64 << 20
#: Fixed values of the format: the magic of files, the mark before a message, and message kinds.
MAGIC, MARK = b"ARROW1", b"\xff\xff\xff\xff"
SCHEMA, DICTIONARY, BATCH = 1, 2, 3


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def list_files(uri: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of all files in a folder, by name."""
    fs, path = open_uri(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


@dataclass
class Message:
    kind: int
    begin: int
    end: int


def _field(data: bytes, table: int, number: int, kind: str, default: int) -> int:
    """A scalar of a flatbuffers table, by the place that its vtable states."""
    vtable = table - struct.unpack_from("<i", data, table)[0]
    at = 4 + 2 * number
    offset = struct.unpack_from("<H", data, vtable + at)[0] if at < struct.unpack_from("<H", data, vtable)[0] else 0
    return struct.unpack_from(kind, data, table + offset)[0] if offset else default


def messages(source: pa.NativeFile, size: int) -> Iterator[Message]:
    """The messages of a stream or file in order; only their lengths and metadata are read."""
    source.seek(0)
    at = 8 if source.read(len(MAGIC)) == MAGIC else 0
    while at + 8 <= size:
        source.seek(at)
        head = source.read(8)
        # Streams of the first versions have no mark before the length.
        marked = head[:4] == MARK
        (length,) = struct.unpack_from("<i", head, 4 if marked else 0)
        if length <= 0 or head[: len(MAGIC)] == MAGIC:
            return
        begin = at + (8 if marked else 4)
        source.seek(begin)
        meta = source.read(length)
        if len(meta) < length:
            raise EOFError(f"a message at {at} is cut off")
        table = struct.unpack_from("<I", meta, 0)[0]
        # Fields of a message: version, kind of the header, header, length of the body.
        kind, body = _field(meta, table, 1, "<B", 0), _field(meta, table, 3, "<q", 0)
        end = begin + length + body
        if end > size:
            raise EOFError(f"a message at {at} is cut off")
        yield Message(kind, at, end)
        at = end


def read_schema(uri: str) -> pa.Schema:
    fs, path = open_uri(uri)
    with fs.open_input_file(path) as source:
        for m in messages(source, source.size()):
            if m.kind == SCHEMA:
                source.seek(m.begin)
                return pa.ipc.read_schema(pa.py_buffer(source.read(m.end - m.begin)))
    raise ValueError(f"{uri} holds no Arrow schema")


@dataclass
class Split(InputPartition):
    uri: str
    begin: int
    end: int


def read_split(split: Split) -> Iterator[pa.RecordBatch]:
    """The batches whose messages begin in the split, one in memory at a time."""
    fs, path = open_uri(split.uri)
    with fs.open_input_file(path) as source:
        before = b""
        for m in messages(source, source.size()):
            if m.begin >= split.end:
                return
            if m.kind in (SCHEMA, DICTIONARY) or (m.kind == BATCH and m.begin >= split.begin):
                source.seek(m.begin)
                data = source.read(m.end - m.begin)
                if m.kind == BATCH:
                    yield from pa.ipc.open_stream(pa.py_buffer(before + data))
                else:
                    before += data


def _plain(schema: pa.Schema) -> pa.Schema:
    """The schema with dictionaries decoded, which Spark has no type for, and without metadata."""
    return pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in schema])


def write_arrow(rows: DataFrame, folder: str) -> int:
    """Write ``rows`` as Arrow streams, one file from each task with rows; returns their number of rows.

    A file is written under a hidden name of the attempt and moved into place under its partition's, so a repeated
    attempt replaces what an earlier one left, and readers see whole files only.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_uri(folder)
        part, sink, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if sink is None:
                fs.create_dir(path, recursive=True)
                hidden = f"{path}/.{uuid.uuid4().hex}"
                out = fs.open_output_stream(hidden, compression=None)
                sink = pa.ipc.new_stream(out, batch.schema)
            sink.write_batch(batch)
            total += batch.num_rows
        if sink is not None:
            sink.close()
            out.close()
            fs.move(hidden, f"{path}/part-{part:06d}.arrow")
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["rows"])

    return rows.mapInArrow(write, "rows long").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


class ArrowIpc(DataSource):
    """``spark.read.format("arrow_ipc").option("path", uri).option("splitBytes", n)``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _files(self) -> list[tuple[str, int]]:
        found = list_files(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no files in {self.options['path']}")
        return found

    def _uri(self, path: str) -> str:
        """The URI of a listed path, in the scheme of the given one."""
        given = self.options["path"]
        fs, root = open_uri(given)
        return given if path == root else given[: given.rindex(root)] + path if root in given else path

    def schema(self) -> StructType:
        return from_arrow_schema(_plain(read_schema(self._uri(self._files()[0][0]))))

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArrowIpcReader([(self._uri(path), size) for path, size in self._files()], int(self.options.get("splitBytes", SPLIT_BYTES)))


class ArrowIpcReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, int]], split_bytes: int):
        self.files, self.split_bytes = files, split_bytes
        self.want = _plain(read_schema(files[0][0]))

    def partitions(self) -> list[InputPartition]:
        return [Split(uri, at, at + self.split_bytes) for uri, size in self.files for at in range(0, max(size, 1), self.split_bytes)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        for batch in read_split(partition):
            if _plain(batch.schema) != self.want:
                raise ValueError(f"{partition.uri} has another schema than {self.files[0][0]}: {batch.schema}")
            yield pa.RecordBatch.from_arrays([c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in batch.columns], schema=self.want)
