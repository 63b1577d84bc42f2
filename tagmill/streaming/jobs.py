"""The job log: stages of a job as events, their latest state, and gap clusters over a stream.

The log is append-only.  A job's state is the fold of its events: a field keeps
its last non-null value, except the error message, which every event overwrites.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The stages in order, and the states of a job.
STAGES = ("detect", "classify", "ocr", "finalize")
STATUSES = ("queued", "processing", "completed", "failed")


def next_stage(stage: Column) -> Column:
    """The stage after one; null after the last or for an unknown one."""
    chain = F.create_map(*[F.lit(x) for pair in zip(STAGES[:-1], STAGES[1:], strict=True) for x in pair])
    return F.try_element_at(chain, stage)


def handled(stage: Column, failed: Column) -> Column:
    """Status and stage after a handler: failed where it is, queued at the next stage, or completed."""
    following = next_stage(stage)
    return F.struct(F.when(failed, "failed").when(following.isNull(), "completed").otherwise("queued").alias("status"), F.when(failed, stage).otherwise(F.coalesce(following, stage)).alias("current_stage"))


def progress(stage: Column, status: Column) -> Column:
    """Percent done: a quarter for each stage passed."""
    at = F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)
    return F.when(status == "completed", 100).otherwise((F.greatest(at, F.lit(1)) - 1) * 25).cast("int")


def latest_state(events: DataFrame, job: str, at: list[str], sticky: list[str], overwritten: list[str]) -> DataFrame:
    """One row a job. Each field is a map-side maximum by time, so a job with many events needs no sort."""
    when = F.struct(*at)
    keep = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), when)).alias(c) for c in sticky]
    last = [F.max_by(F.struct(F.col(c).alias("v")), when)["v"].alias(c) for c in overwritten]
    return events.groupBy(job).agg(*keep, *last, F.count("*").alias("n_events"))


def stage_batches(stream: DataFrame, process: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str):  # noqa: ANN201
    """Run each micro-batch through a stage; rows whose handler failed go to the dead-letter folder, the rest on."""

    def batch(df: DataFrame, epoch: int) -> None:
        # The folder carries the epoch: a batch that is replayed overwrites what it wrote before.
        done = process(df)
        done.filter("error is null").write.mode("overwrite").parquet(f"{sink}/ok/epoch={epoch}")
        done.filter("error is not null").write.mode("overwrite").parquet(f"{sink}/failed/epoch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gap_sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Runs of a key's events without a pause of `gap`; the same plan for a table and a stream."""
    return events.groupBy(F.col(key), F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def stream_best(events: DataFrame, key: str, frame: str, score: str, gap: int, end: str | None = None) -> DataFrame:
    """Best score of each run of frames without a gap, kept as state of a key: emitted when a later frame closes it.

    Rows of a key must arrive in the order of frames over batches; inside a batch they are sorted.  The last run of a key
    is closed by an end marker only: a row, itself no frame, in which the boolean column `end` is true; with a null frame
    it follows all others of its batch.  Without `end` every key's last run stays open and is not returned.
    """
    if end:
        events = events.withColumn(end, F.coalesce(end, F.lit(False)))
        events = events.withColumn(frame, F.when(F.col(end), F.coalesce(frame, F.lit((1 << 63) - 1))).otherwise(F.col(frame))).withColumn(score, F.when(F.col(end), 0).otherwise(F.col(score)))

    def advance(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, first, best, n = state.get if state.exists else (None, None, None, 0)
        out = []
        rows = pd.concat(list(parts)).sort_values([frame, end] if end else frame, kind="stable")
        for f, s, over in zip(rows[frame].tolist(), rows[score].tolist(), rows[end].tolist() if end else [False] * len(rows), strict=True):
            if last is not None and (over or f - last > gap):
                out.append((k[0], first, last, best, n))
                last, first, best, n = None, None, None, 0
            if over:
                continue
            first = f if first is None else first
            best, last, n = s if best is None else max(best, s), f, n + 1
        if last is not None:
            state.update((last, first, best, n))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "first_frame", "last_frame", "best", "n"])

    schema = f"{key} long, first_frame long, last_frame long, best long, n long"
    return events.groupBy(key).applyInPandasWithState(advance, schema, "last long, first long, best long, n long", "append", GroupStateTimeout.NoTimeout)


def run_stages(df: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], needs: list[str] = ()) -> DataFrame:
    """The stages in order as one batch job, each written to the shared folder before the next reads it.

    Paths in `needs` must be there before the first begins; a stage that fails ends the run with its name.
    """
    from tagmill.sources.readers import exists
    from tagmill.sources.scratch import materialize

    missing = [path for path in needs if not exists(df.sparkSession, path)]
    if missing:
        raise FileNotFoundError(f"stages need {', '.join(missing)}")
    for name, stage in stages:
        try:
            df = materialize(stage(df))
        except Exception as e:
            raise RuntimeError(f"stage {name} failed: {e}") from e
    return df


def stream_precluster(detections: DataFrame, key: str, frame: str, score: str, gap: int, numerator: int = 1, denominator: int = 4, end: str | None = None) -> DataFrame:
    """suppression.precluster() over a stream of long columns (key, frame, x1, y1, x2, y2, score): the best row of each cluster.

    State of a key are its open clusters only: one that no row can join any more is emitted and forgotten.  Rows of a key
    must arrive in the order of frames over batches; inside a batch they are sorted by (frame, score down, box).  `end`
    closes all as in stream_best().
    """
    box = ["x1", "y1", "x2", "y2"]
    columns = [frame, *box, score]
    if end:
        detections = detections.withColumn(end, F.coalesce(end, F.lit(False)))
        last = F.lit((1 << 63) - 1)
        detections = detections.withColumn(frame, F.when(F.col(end), F.coalesce(frame, last)).otherwise(F.col(frame))).na.fill(0, [*box, score])

    def overlap(a: list[int], b: list[int]) -> bool:
        w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
        inter = max(w, 0) * max(h, 0)
        both = (a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - inter
        return inter > 0 and inter * denominator >= both * numerator

    def advance(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clusters = json.loads(state.get[0]) if state.exists else []  # [last frame, best row]
        out = []
        rows = pd.concat(list(parts))
        rows["_down"] = -rows[score]
        rows = rows.sort_values([frame, *([end] if end else []), "_down", *box], kind="stable")
        for over, row in zip(rows[end].tolist() if end else [False] * len(rows), rows[columns].to_numpy().tolist(), strict=True):
            done = [c for c in clusters if over or row[0] - c[0] > gap]
            out += [(k[0], *c[1]) for c in done]
            clusters = [c for c in clusters if not (over or row[0] - c[0] > gap)]
            if over:
                continue
            hit = next((c for c in clusters if overlap(c[1], row)), None)
            if hit is None:
                clusters.append([row[0], row])
            else:
                hit[0] = row[0]
                if row[5] > hit[1][5]:
                    hit[1] = row
        if clusters:
            state.update((json.dumps(clusters),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, *columns])

    schema = ", ".join(f"{c} long" for c in [key, *columns])
    return detections.groupBy(key).applyInPandasWithState(advance, schema, "clusters string", "append", GroupStateTimeout.NoTimeout)
