"""A table as one CSV file, for readers that want one: header once, whole or not at all.

Tasks write their lines beside the file; the commit joins the parts in the order of partitions
(so of rows, where the table is sorted) under another name and moves the result into place.  A task
that dies or runs twice leaves nothing in the file, a job that fails leaves the file as it was.
The commit copies through in blocks: its memory does not grow, its time does, as one file asks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tagmill.sources import sinks, storage

BLOCK = 4 << 20


@dataclass
class Part(WriterCommitMessage):
    path: str
    partition: int
    rows: int


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        self.where, self.path = None, storage.located(options["path"])[1]
        parent, _, base = self.path.rpartition("/")
        self.staging = f"{parent}/_{base}.{uuid.uuid4().hex}"

    def _fs(self) -> fs.FileSystem:
        return storage.located(self.options["path"])[0]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        where, task, rows = self._fs(), TaskContext.get(), 0
        where.create_dir(self.staging, recursive=True)
        path = f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}"
        end = self.options["end"]
        with where.open_output_stream(path) as out:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    out.write((line + end).encode())
                rows += batch.num_rows
        return Part(path, task.partitionId(), rows)

    def commit(self, messages: list[Part | None]) -> None:
        where = self._fs()
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.partition)
        before = where.get_file_info(self.path)
        kept = not self.overwrite and before.type == fs.FileType.File and before.size > 0
        if kept and not parts:
            where.delete_dir(self.staging) if where.get_file_info(self.staging).type == fs.FileType.Directory else None
            return
        where.create_dir(self.staging, recursive=True)
        whole = f"{self.staging}/whole"
        with where.open_output_stream(whole) as out:
            if not kept and (parts or self.options["whenempty"] == "true"):
                out.write((self.options["head"] + self.options["end"]).encode())
            for path in [*([self.path] if kept else []), *[p.path for p in parts]]:
                with where.open_input_stream(path) as source:
                    while block := source.read(BLOCK):
                        out.write(block)
        where.move(whole, self.path)
        where.delete_dir(self.staging)

    def abort(self, messages: list[Part | None]) -> None:
        where = self._fs()
        if where.get_file_info(self.staging).type == fs.FileType.Directory:
            where.delete_dir(self.staging)


class OneFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tagmill_one_csv"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:  # noqa: ANN001
        return LinesWriter({k.lower(): v for k, v in dict(self.options).items()}, overwrite)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, append: bool = False, header_when_empty: bool = True, end: str = "\r\n") -> None:
    """One CSV of the named columns (those missing blank, others left out) or all; the header once, over all tasks and appends.

    A table without rows gives a header only, or an empty file unless `header_when_empty`; appended, it changes nothing.
    """
    columns = columns or df.columns
    rows = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])
    df.sparkSession.dataSource.register(OneFile)
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in columns)
    out = sinks.csv_lines(rows).write.format(OneFile.name()).mode("append" if append else "overwrite")
    out.option("head", head).option("end", end).option("whenEmpty", str(header_when_empty).lower()).save(path)
