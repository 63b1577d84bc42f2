"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.sources.scratch import discard, materialize  # noqa: F401

#: Text handled at once inside a Python worker; whole texts only, so one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str | None = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a worker holds a bounded amount of text at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist() if text else None
        if lengths is None or sum(lengths) <= max_bytes:
            yield batch
            continue
        for i, n in enumerate(lengths):
            if size and size + n > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def text_key(text: Column) -> Column:
    """With doc_id, names a document: rows equal in both are one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def quoted(name: str) -> str:
    """A column's name as an expression takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def boxed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and `rest`, a struct of all columns but text, so that no name of docs can clash with an operator's."""
    others = [F.col(quoted(c)) for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*others).alias("rest"))


def unboxed(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of docs out of boxed(); new values by name."""
    return df.select(*[new[c].alias(c) if c in new else F.col("text") if c == "text" else F.col(f"rest.{quoted(c)}").alias(c) for c in columns])


def table(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
