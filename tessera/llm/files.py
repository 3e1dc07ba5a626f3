"""Files of our own formats in the shared folder, written and read by tasks.

A task writes to a name of its own (partition, attempt, random part), moves the finished file into place and reports
it in a manifest row. Only files of the manifest are ever read, so what a failed or repeated attempt left behind has
no effect. The manifest is a Parquet table, committed by Spark.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark import TaskContext


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI; ``file:/x`` and plain paths count as local."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


class RollingFile:
    """One output file at a time, under a name that no other attempt uses."""

    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix, self.count, self.sink = folder.rstrip("/"), suffix, 0, None
        context = TaskContext.get()
        self.part = context.partitionId() if context else 0
        self.name = f"part-{self.part:06d}-{context.taskAttemptId() if context else 0}-{uuid.uuid4().hex[:12]}"
        self.fs, _ = resolve(folder)

    def open(self):
        _, path = resolve(self.folder)
        self.fs.create_dir(path, recursive=True)
        self.path = f"{self.folder}/{self.name}-{self.count:04d}{self.suffix}"
        self.count += 1
        self.sink = self.fs.open_output_stream(resolve(self.path + ".tmp")[1], compression=None)
        return self.sink

    def close(self) -> str:
        self.sink.close()
        self.sink = None
        self.fs.move(resolve(self.path + ".tmp")[1], resolve(self.path)[1])
        return self.path
