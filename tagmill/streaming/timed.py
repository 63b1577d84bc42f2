"""Keyed state with event-time timers: rows in order of time, whatever order they come in, and state that ends by itself.

Rows wait in a key's state until the watermark has passed them, so they are folded in the
order of their time (then of their other columns) over all batches; rows later than the
watermark allows are dropped, as everywhere in Spark (a delay above zero lets rows of one time come in
several batches).  Keys share buckets of state, and a bucket has one timer, at the next
moment at which a waiting row of a key ripens or what is open ends; when it fires, the fold and
`ended` are asked, and a key with nothing left has no state.  So runs and clusters close without an
end marker as soon as any key's events move the watermark on, and dead keys cost nothing.

State is kept by the RocksDB store, which this kind of operator needs (`started` sets it for its query).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tagmill.streaming.jobs import STAGES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Rows = list[tuple]


class Fold:
    """What a key's rows come to.  `open` is a list of tuples of `state` columns; times are milliseconds of event time."""

    state: str
    out: str

    def row(self, opened: Rows, at: int, row: tuple) -> tuple[Rows, Rows]:
        """The open things after a row, and the output rows that it completes."""
        raise NotImplementedError

    def ended(self, opened: Rows, now: int) -> tuple[Rows, Rows]:
        """The open things that can still grow once the watermark is `now`, and the output of the others."""
        raise NotImplementedError

    def due(self, opened: Rows) -> int | None:
        """When ended() would next find something."""
        raise NotImplementedError


class Ordered(StatefulProcessor):
    """Feeds a fold with each key's rows in order of (time, other columns).

    A group of state is a bucket of keys: its keys' waiting rows and open things are read and written as one value, so a
    key costs no calls to the state store of its own.
    """

    def __init__(self, key: str, columns: list[str], fold: Fold, out: list[str]) -> None:
        self.key, self.columns, self.fold, self.names = key, columns, fold, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", T.StructType().add("keys", "binary"))
        self.timer = handle.getValueState("timer", T.StructType().add("at", "long"))

    def _keys(self) -> dict[object, tuple[Rows, Rows]]:
        return pickle.loads(self.kept.get()[0]) if self.kept.exists() else {}

    def _store(self, keys: dict[object, tuple[Rows, Rows]], had: int | None) -> None:
        """Keeps the keys and moves the timer to the next moment at which any of them has something to do."""
        if keys:
            self.kept.update((pickle.dumps(keys, pickle.HIGHEST_PROTOCOL),))
        elif self.kept.exists():
            self.kept.clear()
        due = [t for waiting, opened in keys.values() for t in (min((r[0] for r in waiting), default=None), self.fold.due(opened)) if t is not None]
        now = min(due) if due else None
        if had == now:
            return
        if had is not None:
            self.handle.deleteTimer(had)
        if now is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(now)
            self.timer.update((now,))

    def _frame(self, rows: Rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.names)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        new: dict[object, Rows] = {}
        for p in rows:
            for k, live, at, row in zip(p[self.key].tolist(), p["timed_live"].tolist(), p["timed_ms"].tolist(), p["timed_row"].tolist(), strict=True):
                if live:
                    new.setdefault(k, []).append((at, *(row[c] for c in self.columns)))
        if new:
            keys = self._keys()
            for k, some in new.items():
                waiting, opened = keys.get(k, ([], []))
                keys[k] = (waiting + some, opened)
            self._store(keys, self.timer.get()[0] if self.timer.exists() else None)
        yield self._frame([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        now, out, left = timerValues.getCurrentWatermarkInMs(), [], {}
        # A fired timer is gone; what is registered from here on is another.
        self.timer.clear()
        for k, (waiting, opened) in self._keys().items():
            for r in sorted((r for r in waiting if r[0] <= now), key=lambda r: [(v is not None, v if v is not None else 0) for v in r]):
                opened, made = self.fold.row(opened, r[0], r[1:])
                out += [(k, *m) for m in made]
            opened, made = self.fold.ended(opened, now)
            out += [(k, *m) for m in made]
            waiting = [r for r in waiting if r[0] > now]
            if waiting or opened:
                left[k] = (waiting, opened)
        self._store(left, None)
        yield self._frame(out)


# Fixed value: buckets of keys. A stream that has state must keep it.
BUCKETS = 1024


def folded(stream: DataFrame, key: str, at: Column, columns: list[str], fold: Fold, delay: str) -> DataFrame:
    """A stream through a fold: `at` is a row's event time, `columns` are what the fold sees of it and order rows of one time.

    A row without a key only moves the watermark: it is the clock of a source that has no more rows of its own.
    """
    # One column of structs: with a null in it, a plain column of longs would reach Python as doubles.
    live, row = F.col(key).isNotNull(), F.struct(*columns)
    any_key = F.coalesce(key, F.lit("" if dict(stream.dtypes)[key] == "string" else 0).cast(dict(stream.dtypes)[key]))
    bucket = F.pmod(F.xxhash64(any_key), F.lit(BUCKETS))
    rows = stream.select(bucket.alias("timed_bucket"), any_key.alias(key), at.alias("timed_at"), F.unix_millis(at).alias("timed_ms"), live.alias("timed_live"), row.alias("timed_row")).withWatermark("timed_at", delay)
    out = T.StructType([rows.schema[key], *T.StructType.fromDDL(fold.out)])
    return rows.groupBy("timed_bucket").transformWithStateInPandas(Ordered(key, columns, fold, out.names), out, "Append", "EventTime")


def started(out: DataFrame, path: str, checkpoint: str):  # noqa: ANN201
    """The query of a folded() stream into a folder of Parquet files, until what is there is read."""
    spark, name = out.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)


class Runs(Fold):
    """Runs of frames without a gap: first and last frame, best score, number of frames.  A frame is `tick` ms of event time."""

    state = "first_frame long, last_frame long, best long, n long"
    out = state

    def __init__(self, gap: int, tick: int) -> None:
        self.gap, self.tick = gap, tick

    def row(self, opened: Rows, at: int, row: tuple) -> tuple[Rows, Rows]:
        frame, score = row
        if opened and frame - opened[0][1] <= self.gap:
            first, _, best, n = opened[0]
            return [(first, frame, max(best, score), n + 1)], []
        return [(frame, frame, score, 1)], opened

    def ended(self, opened: Rows, now: int) -> tuple[Rows, Rows]:
        over = self.due(opened)
        return ([], opened) if over is not None and over <= now else (opened, [])

    def due(self, opened: Rows) -> int | None:
        # A frame as late as last + gap may still come while the watermark is before it.
        return (opened[0][1] + self.gap + 1) * self.tick if opened else None


class Clusters(Fold):
    """suppression.precluster(): the best row of each cluster, by overlap with the cluster's best, in order of (frame, score down, box)."""

    state = "last long, frame long, down long, x1 long, y1 long, x2 long, y2 long"
    out = "frame long, x1 long, y1 long, x2 long, y2 long, score long"

    def __init__(self, gap: int, tick: int, numerator: int, denominator: int) -> None:
        self.gap, self.tick, self.numerator, self.denominator = gap, tick, numerator, denominator

    def _overlap(self, a: tuple, b: tuple) -> bool:
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        inter = max(w, 0) * max(h, 0)
        both = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - inter
        return inter > 0 and inter * self.denominator >= both * self.numerator

    def _split(self, opened: Rows, alive: Callable[[int], bool]) -> tuple[Rows, Rows]:
        return [o for o in opened if alive(o[0])], [(o[1], *o[3:], -o[2]) for o in opened if not alive(o[0])]

    def row(self, opened: Rows, at: int, row: tuple) -> tuple[Rows, Rows]:
        opened, done = self._split(opened, lambda last: row[0] - last <= self.gap)
        for i, o in enumerate(opened):
            if self._overlap(o[1:], row):
                opened[i] = (row[0], *(row if row[1] < o[2] else o[1:]))
                return opened, done
        return [*opened, (row[0], *row)], done

    def ended(self, opened: Rows, now: int) -> tuple[Rows, Rows]:
        return self._split(opened, lambda last: (last + self.gap + 1) * self.tick > now)

    def due(self, opened: Rows) -> int | None:
        return min(((o[0] + self.gap + 1) * self.tick for o in opened), default=None)


class Stages(Fold):
    """A job's way through the stages: each reported stage counts once, in order, so repeated and stray reports change nothing.

    A job leaves a row, and is forgotten, when it completes or has been silent for `patience` ms.
    """

    state = "stage int, done_at long, error string, last_at long"
    out = "status string, current_stage string, error_message string, updated_ms long"

    def __init__(self, patience: int) -> None:
        self.patience = patience

    def row(self, opened: Rows, at: int, row: tuple) -> tuple[Rows, Rows]:
        _, stage, error = row
        here, done_at, message, _ = opened[0] if opened else (0, None, None, at)
        if error is not None:
            return [(here, done_at, error, at)], []
        if stage != STAGES[here]:
            return [(here, done_at, message, at)], []
        if here + 1 == len(STAGES):
            return [], [("completed", stage, None, at)]
        return [(here + 1, at, None, at)], []

    def ended(self, opened: Rows, now: int) -> tuple[Rows, Rows]:
        if not opened or opened[0][3] + self.patience > now:
            return opened, []
        here, done_at, message, _ = opened[0]
        return [], [("failed" if message is not None else "queued", STAGES[here], message, done_at)]

    def due(self, opened: Rows) -> int | None:
        return opened[0][3] + self.patience if opened else None


def _shown(frame: str, tick: int) -> Column:
    """Event time of a frame: when it is over, as the watermark begins at 0 and what is not after it is late."""
    return F.timestamp_millis((F.col(frame) + 1) * tick)


def runs(stream: DataFrame, key: str, frame: str, score: str, gap: int, tick: int = 1, delay: str = "1 milliseconds") -> DataFrame:
    """Runs of frames without a gap, a row when each has ended."""
    return folded(stream, key, _shown(frame, tick), [frame, score], Runs(gap, tick), delay)


def clusters(stream: DataFrame, key: str, frame: str, score: str, gap: int, numerator: int = 1, denominator: int = 4, tick: int = 1, delay: str = "1 milliseconds") -> DataFrame:
    """The best row of each cluster of long columns (key, frame, x1, y1, x2, y2, score), a row when each has ended."""
    rows = stream.withColumn("timed_down", -F.col(score))
    return folded(rows, key, _shown(frame, tick), [frame, "timed_down", "x1", "y1", "x2", "y2"], Clusters(gap, tick, numerator, denominator), delay)


def job_states(stream: DataFrame, job: str, at: str, event: str, stage: str, error: str, patience: int, delay: str = "1 seconds") -> DataFrame:
    """Each job's last state: reports of stages and errors, told apart by `event`."""
    return folded(stream, job, F.col(at), [event, stage, error], Stages(patience), delay)
