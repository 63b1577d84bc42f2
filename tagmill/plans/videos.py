"""Queries over recordings: files are made from the tables, written to the session's shared folder, and scanned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.plans.proxies import read
from tagmill.plans.registry import query
from tagmill.sources import container, frames, readers, storage
from tagmill.sources.scratch import new_folder

#: Documents in a recording, a frame each; pictures of this size.
LENGTH, WIDE, HIGH = 64, 8, 6


def _recordings(spark: SparkSession, sf_dir: str) -> str:
    """A folder of recordings of 64 documents: a frame is of one colour, by doc_id and length of text."""
    d = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / LENGTH).cast("long").alias("rec"), "doc_id", F.length("text").cast("long").alias("n"))
    whole = d.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("doc_id", "n"))).alias("frames"))  # at most 64

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                pictures = [np.full((HIGH, WIDE, 3), (f["doc_id"] % 251, (f["n"] or 0) % 256, k), np.uint8).tobytes() for k, f in enumerate(r["frames"])]
                data = container.write_mp4(pictures, WIDE, HIGH, 1000, 40 + r["rec"] % 3, header_first=r["rec"] % 2 == 0)
                yield pa.RecordBatch.from_arrays([pa.array([f"rec_{r['rec']}.mp4"]), pa.array([data], pa.binary())], ["name", "content"])

    folder = new_folder(spark)
    storage.write_files(whole.mapInArrow(make, "name string, content binary"), folder)
    return folder


_SQL = f"f AS (SELECT doc_id // {LENGTH} AS rec, doc_id, coalesce(length(text), 0) AS n, 40 + (doc_id // {LENGTH}) % 3 AS tick, row_number() OVER (PARTITION BY doc_id // {LENGTH} ORDER BY doc_id) - 1 AS frame FROM documents)"


def _rec() -> Column:
    return F.regexp_extract("path", r"rec_(\d+)\.mp4", 1).cast("long").alias("rec")


def _colour(at: int) -> Column:
    return F.conv(F.hex(F.substring("content", at, 1)), 16, 10).cast("long")


@query(f"WITH {_SQL} SELECT rec, frame, frame // 3 AS nth, (frame * tick)::DOUBLE AS ms, doc_id % 251 AS red, n % 256 AS green FROM f WHERE frame % 3 = 0 AND frame // 3 < 10")
def src_frames_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, SRC13: every third frame of a recording, ten at most, as a scan."""
    found = frames.read_frames(spark, _recordings(spark, sf_dir), stride=3, maxFrames=10)
    return found.select(_rec(), "frame", "nth", "ms", _colour(1).alias("red"), _colour(2).alias("green"))


@query(f"WITH {_SQL}, s AS (SELECT *, (2 * frame * tick * 10 + 1000) // 2000 AS slot, (2 * (max(frame) OVER (PARTITION BY rec) + 1) * tick * 10 + 1000) // 2000 AS stop FROM f), k AS (SELECT DISTINCT rec, unnest(range(stop)) AS nth FROM s) SELECT k.rec, nth, max(frame) AS frame, 4 AS width, 6 AS height, arg_max(doc_id % 251, frame) AS red FROM k JOIN s ON s.rec = k.rec AND slot <= nth GROUP BY k.rec, nth")
def src_frames_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14: ten frames a second, turned to the right and scaled down to a width of four."""
    found = frames.read_frames(spark, _recordings(spark, sf_dir), fps=10, rotation="cw", maxWidth=4)
    return found.select(_rec(), "nth", "frame", "width", "height", _colour(1).alias("red"))


@query(f"WITH {_SQL}, t AS (SELECT unnest([0, 100, 333, 1000, 99999]) AS wanted_ms, unnest(range(5)) AS nth) SELECT rec, nth, arg_min(frame, abs(frame * tick - wanted_ms) * 1000 + frame) AS frame FROM f, t GROUP BY rec, nth")
def src_frames_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: the frames nearest to given times."""
    return frames.read_frames(spark, _recordings(spark, sf_dir), timestamps="0,100,333,1000,99999").select(_rec(), "nth", "frame")


@query("WITH u AS (SELECT user_id AS rec, count(*) AS n, 900 + user_id % 7 AS scale, 30 + user_id % 5 AS tick FROM events GROUP BY 1) SELECT rec, CASE WHEN rec % 9 = 8 THEN NULL ELSE 16 + rec % 5 END AS width, CASE WHEN rec % 9 = 8 THEN NULL ELSE scale // gcd(scale, tick) END AS numerator, CASE WHEN rec % 9 = 8 THEN NULL ELSE tick // gcd(scale, tick) END AS denominator, CASE WHEN rec % 9 = 8 THEN NULL ELSE n END AS frame_count, CASE WHEN rec % 9 = 8 THEN NULL ELSE (n * tick)::DOUBLE / scale END AS duration_sec FROM u")
def src_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC15: what headers say of recordings, of which every ninth is damaged."""
    users = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                u = r["user_id"]
                data = container.write_mp4([b"x"] * r["n"], 16 + u % 5, 12, 900 + u % 7, 30 + u % 5, "jpeg", header_first=u % 2 == 0)
                data = data.replace(b"moov", b"free") if u % 9 == 8 else data
                yield pa.RecordBatch.from_arrays([pa.array([f"rec_{u}.mp4"]), pa.array([data], pa.binary())], ["name", "content"])

    folder = new_folder(spark)
    storage.write_files(users.mapInArrow(make, "name string, content binary"), folder)
    c = F.col
    found = frames.probe(readers.listing(spark, folder, readers.VIDEOS))
    return found.select(_rec(), c("width").cast("long").alias("width"), c("fps_numerator").alias("numerator"), c("fps_denominator").alias("denominator"), "frame_count", "duration_sec")
