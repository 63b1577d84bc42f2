"""Files as byte ranges, read and written inside tasks: what the frame source and the file sinks stand on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """A path as Spark writes it (file:/x, hdfs://host/x, /x) as a file system and a path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        scheme, rest = uri.split("://", 1)
        return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return fs.LocalFileSystem(), uri


class Ranges:
    """A file of known length, read in ranges; `taken` counts the bytes read."""

    def __init__(self, uri: str) -> None:
        where, path = located(uri)
        self.file: BinaryIO = where.open_input_file(path)
        self.size, self.taken = self.file.size(), 0

    def __call__(self, start: int, length: int) -> bytes:
        length = max(0, min(length, self.size - start))
        self.taken += length
        self.file.seek(start)
        return self.file.read(length)

    def close(self) -> None:
        self.file.close()


def files(folder: str) -> list[tuple[str, int]]:
    """(path, length) of the files of a folder and those below it, or of the one file, by path."""
    where, path = located(folder)
    info = where.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
    head = folder[: len(folder) - len(path)] if folder.endswith(path) else "file:" if folder.startswith("file:") else ""
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Each row (name, content) as a file of its own below folder; gives path and length of those written.

    A file appears whole or not at all: it is written under another name and moved, so a task that is run twice, or
    dies, leaves no part of one.  Of rows with one name, one is kept.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = located(folder)
        made: set[str] = set()
        for batch in batches:
            names, lengths = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content"), strict=True):
                data = content.as_py() or b""
                data = data.encode() if isinstance(data, str) else data
                path = f"{root.rstrip('/')}/{name}"
                parent, base = path.rsplit("/", 1)
                if parent not in made:
                    where.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{parent}/_{uuid.uuid4().hex}-{base}"
                with where.open_output_stream(part) as out:
                    out.write(data)
                where.move(part, path)
                lengths.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{name}" for name in names], pa.string()), pa.array(lengths, pa.int64())], ["path", "length"])

    from tagmill.sources.scratch import materialize

    return materialize(df.select("name", "content").mapInArrow(write, "path string, length long"))


def read_files(paths: DataFrame) -> DataFrame:
    """path, length and content of the files that rows name (path), each once, empty ones too: read inside tasks, with no listing at the driver.

    A file that is not there is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["path", "length", "content"])

        some, held = [], 0
        for path in (path for b in batches for path in b.column("path").to_pylist()):
            source = Ranges(path)
            some.append((path, source.size, source(0, source.size)))
            source.close()
            held += source.size
            if len(some) == 1024 or held >= 8 << 20:
                yield batch(some)
                some, held = [], 0
        if some:
            yield batch(some)

    from tagmill.sources.scratch import dealt

    return dealt(paths.select("path"), "path").distinct().mapInArrow(read, "path string, length long, content binary")
