"""Files as a source and a sink: the first bytes of many files, and sets of named files that appear as a whole or not at all.

Both are Python data sources over pyarrow's file systems, so paths may be local or on any store that pyarrow knows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

HEAD_BYTES = 512


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or of an absolute path."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace(":", "://", 1))


@dataclass
class Files(InputPartition):
    """Files that one task reads, with their lengths."""

    names: list[tuple[str, int]]


class FileHeads(DataSource):
    """path, length and head, the first `bytes` bytes (512), of all files below a folder; hidden names are left out.

    Only that many bytes of a file are asked for, however long it is. `files` (1000) is how many a task opens. An empty folder gives no
    rows, an empty file an empty head; a folder that is not there is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeadsReader(self.options["path"], int(self.options.get("bytes", HEAD_BYTES)), int(self.options.get("files", 1000)))


class HeadsReader(DataSourceReader):
    def __init__(self, path: str, n: int, files: int) -> None:
        self.path, self.n, self.files = path, n, files

    def partitions(self) -> list[Files]:
        """The driver lists names and lengths, as for any file source; by number of files, since each costs one opening."""
        store, folder = opened(self.path)
        hidden = lambda p: any(x[:1] in "._" for x in p[len(folder) :].split("/") if x)
        found = sorted((i.path, i.size) for i in store.get_file_info(fs.FileSelector(folder, recursive=True)) if i.is_file and not hidden(i.path))
        return [Files(found[k : k + self.files]) for k in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        for k in range(0, len(partition.names), 500):
            part = partition.names[k : k + 500]
            heads = []
            for path, _ in part:
                with store.open_input_file(path) as f:
                    heads.append(f.read(self.n))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part], pa.string()), pa.array([s for _, s in part], pa.int64()), pa.array(heads, pa.binary())], ["path", "length", "head"])


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: its folder, how many files."""

    folder: str
    files: int


class FileSet(DataSource):
    """Writes rows (name, content as binary or string) as files. A task's files go to a folder of their own, which only a
    commit of the whole job moves into place: attempts that failed or ran twice are never seen, and an aborted job leaves what was there.
    Overwriting replaces the whole set; appending adds to it. Rows of one task with equal names are an error, and so are names with a path.
    """

    @classmethod
    def name(cls) -> str:
        return "file_set"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SetWriter(self.options["path"], overwrite)


class SetWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        store, folder = opened(self.path)
        own, seen = f"{folder}/_staging-{self.run}/{uuid.uuid4().hex}", set()
        store.create_dir(own, recursive=True)
        for row in iterator:
            name, content = row["name"], row["content"]
            if not name or "/" in name or name in seen:
                raise ValueError(f"not a new file name: {name!r}")
            seen.add(name)
            with store.open_output_stream(f"{own}/{name}") as f:
                f.write(content.encode() if isinstance(content, str) else bytes(content or b""))
        return Staged(own, len(seen))

    def commit(self, messages: list[Staged | None]) -> None:
        """One move per task that wrote something."""
        store, folder = opened(self.path)
        old = [i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.base_name.startswith("part-")] if self.overwrite else []
        for k, m in enumerate(m for m in messages if m is not None and m.files):
            store.move(m.folder, f"{folder}/part-{self.run[:8]}-{k:05d}")
        for path in old:
            store.delete_dir(path)
        self.abort([])

    def abort(self, messages: list[Staged | None]) -> None:
        store, folder = opened(self.path)
        staging = f"{folder}/_staging-{self.run}"
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


def register(spark: SparkSession) -> None:
    """Make both known to a session by name."""
    for source in (FileHeads, FileSet):
        spark.dataSource.register(source)
