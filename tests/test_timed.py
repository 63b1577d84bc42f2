"""Keyed state with timers: a stream gives the batch's result without an end marker, and forgets."""

import random

from pyspark.sql import functions as F

from tagmill.operators import suppression
from tagmill.streaming import timed


def batches(spark, tmp_path, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))


def result(spark, tmp_path, out):
    q = timed.started(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(150)
    progress = q.recentProgress
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect(), progress


def plain_runs(rows, gap):
    out = []
    for key in {r[0] for r in rows if r[0] is not None}:
        now = None
        for _, frame, score in sorted(r for r in rows if r[0] == key):
            if now and frame - now[2] <= gap:
                now = (key, now[1], frame, max(now[3], score), now[4] + 1)
            else:
                out += [now] if now else []
                now = (key, frame, frame, score, 1)
        out.append(now)
    return sorted(out)


def test_runs_end_by_themselves_and_are_forgotten(spark, tmp_path):
    r = random.Random(1)
    rows = [(k, f, r.randrange(100)) for k in range(6) for f in sorted(r.sample(range(300), 60))]
    rows.sort(key=lambda x: x[1])
    parts = [rows[i : i + 90] for i in range(0, 360, 90)]
    for p in parts:
        r.shuffle(p)  # any order inside a batch
    parts.append([(None, 10_000, 0)])  # the clock of another source
    got, progress = result(spark, tmp_path, timed.runs(batches(spark, tmp_path, parts, "job long, frame long, score long"), "job", "frame", "score", gap=4))
    assert sorted(map(tuple, got)) == plain_runs(rows, 4)
    lasting = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(lasting) < 360 and lasting[-1] <= 6


def test_rows_out_of_order_over_batches(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, f, r.randrange(100)) for k in range(3) for f in sorted(r.sample(range(200), 50))]
    rows.sort(key=lambda x: x[1] + r.randrange(15))  # late by less than the delay
    parts = [rows[i : i + 30] for i in range(0, 150, 30)] + [[(None, 10_000, 0)]]
    got, _ = result(spark, tmp_path, timed.runs(batches(spark, tmp_path, parts, "job long, frame long, score long"), "job", "frame", "score", gap=3, tick=1000, delay="60 seconds"))
    assert sorted(map(tuple, got)) == plain_runs(rows, 3)


def test_clusters_without_a_marker_are_those_of_the_batch(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for key in range(3):
        for frame in range(0, 120):
            for _ in range(r.randrange(3)):
                x, y = r.randrange(60), r.randrange(40)
                rows.append((key, frame, x, y, x + 30, y + 20, r.randrange(1000)))
    schema = "key long, frame long, x1 long, y1 long, x2 long, y2 long, score long"
    rows.sort(key=lambda x: x[1])
    parts = [rows[i : i + 100] for i in range(0, len(rows), 100)]
    parts.append([(None, 10_000, 0, 0, 0, 0, 0)])
    got, _ = result(spark, tmp_path, timed.clusters(batches(spark, tmp_path, parts, schema), "key", "frame", "score", gap=4))
    order = [F.col("frame"), -F.col("score"), *[F.col(c) for c in ("x1", "y1", "x2", "y2")]]
    batch = suppression.precluster(spark.createDataFrame(rows, schema), ["key"], "frame", order, ["frame", "x1", "y1", "x2", "y2", "score"], "score", gap=4)
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch.select("key", "frame", "x1", "y1", "x2", "y2", "score").collect()))


def test_jobs_step_once_for_each_stage(spark, tmp_path):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    steps = [
        (1, at(1), 1, "detect", None), (1, at(2), 2, "detect", None), (1, at(3), 3, "classify", None), (1, at(4), 4, "ocr", None), (1, at(5), 5, "finalize", None),
        (2, at(1), 1, "detect", None), (2, at(2), 2, "ocr", None), (2, at(3), 3, None, "broken"),
        (3, at(1), 1, None, "first"), (3, at(2), 2, "detect", None), (4, at(9), 1, "finalize", None),
    ]
    schema = "job long, at string, event long, stage string, error string"
    parts = [steps[::2], steps[1::2], [(None, "2024-03-01 00:00:00", 0, None, None)]]
    stream = batches(spark, tmp_path, parts, schema).withColumn("at", F.col("at").cast("timestamp"))
    got, _ = result(spark, tmp_path, timed.job_states(stream, "job", "at", "event", "stage", "error", patience=60_000, delay="30 seconds"))
    assert sorted((r.job, r.status, r.current_stage, r.error_message) for r in got) == [(1, "completed", "finalize", None), (2, "failed", "classify", "broken"), (3, "queued", "classify", None), (4, "queued", "detect", None)]


def test_keys_share_buckets_of_state(spark, tmp_path, monkeypatch):
    """Two thousand keys of one report each are at most a few rows of state: a key costs no state calls of its own."""
    monkeypatch.setattr(timed, "BUCKETS", 8)
    rows = [(k, 1 + k % 7, k % 100) for k in range(2000)]
    got, progress = result(spark, tmp_path, timed.runs(batches(spark, tmp_path, [rows, [(None, 10_000, 0)]], "job long, frame long, score long"), "job", "frame", "score", gap=4))
    assert sorted(map(tuple, got)) == plain_runs(rows, 4)
    assert max(p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators) <= 8 * 4
