"""Frames of recordings as a scan, and probes of their headers.

Files are cut by bytes, as other scans cut them: a task reads the header (ranged reads, so
kilobytes), finds from the sample tables which frames are wanted, and reads and decodes
those whose bytes (for frames that need earlier ones: whose sync frame's bytes) begin in
its range.  So one long recording is spread over tasks, nothing is read at the driver but
the listing, and frames that no one asked for are stepped over, unless they are needed to decode.

Options: stride; fps (a number or fraction: frames of constant rate, a source frame may
be taken more than once or never); timestamps (ms, comma-separated: the nearest frame
each, the earlier of equals); maxFrames of a recording; rotation (cw, ccw, 180); maxWidth
(scales down only); splitBytes; content=false (numbers and times only).  Filters on path prune
files before any is opened; filters on frame and nth keep frames from being read.

Frames keep the number they have in their recording (`frame`); `nth` counts what the options keep, from 0.
Files whose header can't be read give no frames; probe() tells why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tagmill.functions import pixels
from tagmill.sources import container, storage
from tagmill.sources.readers import VIDEOS

Decoder = Callable[[Iterator[bytes], container.Track], Iterator[np.ndarray]]
SCHEMA = "path string, frame long, nth long, ms double, width int, height int, content binary"
#: Decoded pictures that a task holds before it hands them on.
BATCH_BYTES = 16 << 20


def raw_rgb(samples: Iterator[bytes], track: container.Track) -> Iterator[np.ndarray]:
    """Pictures stored as 8-bit RGB, row by row."""
    for s in samples:
        yield np.frombuffer(s, np.uint8).reshape(track.height, track.width, 3)


def wanted(track: container.Track, options: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """(nth, frame) that the options keep of a recording."""
    times, n = track.times, len(track.times)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if "timestamps" in options:
        ms = [Fraction(t) * track.timescale / 1000 for t in options["timestamps"].split(",") if t.strip()]
        after = np.searchsorted(times, [float(t) for t in ms])
        near = [min((i for i in (a - 1, a) if 0 <= i < n), key=lambda i, t=t: (abs(int(times[i]) - t), i)) for a, t in zip(after.tolist(), ms, strict=True)]
        frame = np.array(near, np.int64)
    elif "fps" in options:
        rate = Fraction(options["fps"])
        # The slot of a time is the nearest one, halves up; a slot shows the last frame that has begun.
        slot = lambda t: (2 * t * rate.numerator + track.timescale * rate.denominator) // (2 * track.timescale * rate.denominator)
        slots = slot(times)
        frame = np.searchsorted(slots, np.arange(int(slots[0]), int(slot(max(track.duration, int(times[-1]) + 1)))), side="right") - 1
    else:
        frame = np.arange(0, n, int(options.get("stride", 1)))
    nth = np.arange(len(frame))
    m = int(options["maxframes"]) if "maxframes" in options else len(frame)
    return nth[:m], frame[:m]


class Split(InputPartition):
    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str], decoder: Decoder) -> None:
        self.options, self.decoder, self.filters = {k.lower(): v for k, v in options.items()}, decoder, []
        self.content = self.options.get("content", "true") == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        tests = {EqualTo: "eq", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
        for f in filters:
            if type(f) in tests and f.attribute[0] in ("path", "frame", "nth"):
                self.filters.append((f.attribute[0], tests[type(f)], f.value))
            yield f  # Spark tests the rows again

    def _keeps(self, column: str, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for name, test, value in self.filters:
            if name == column:
                out &= np.isin(values, list(value)) if test == "in" else {"eq": values == value, "gt": values > value, "ge": values >= value, "lt": values < value, "le": values <= value}[test]
        return out

    def partitions(self) -> list[Split]:
        step = int(self.options.get("splitbytes", 128 << 20))
        found = [(p, n) for p, n in storage.files(self.options["path"]) if p.rsplit(".", 1)[-1].lower() in VIDEOS]
        kept = self._keeps("path", np.array([p for p, _ in found], object)) if found else []
        return [Split(p, a, min(a + step, n)) for (p, n), keep in zip(found, kept, strict=True) if keep for a in range(0, n, step)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        source = storage.Ranges(split.path)
        try:
            track = container.parse(source, source.size)
        except ValueError:
            return
        nth, frame = wanted(track, self.options)
        place = track.offsets
        sync = np.arange(len(place)) if track.sync is None else np.asarray(track.sync)
        if not len(sync):
            return
        usable = frame < len(place)
        nth, frame = nth[usable], frame[usable]
        first = sync[np.maximum(np.searchsorted(sync, frame, side="right") - 1, 0)]
        here = (place[first] >= split.begin) & (place[first] < split.end) & self._keeps("frame", frame) & self._keeps("nth", nth)
        nth, frame, first = nth[here], frame[here], first[here]
        out, held = [], 0
        for start in np.unique(first).tolist():
            asked: dict[int, list[int]] = {}
            for i, n in zip(frame[first == start].tolist(), nth[first == start].tolist(), strict=True):
                asked.setdefault(i, []).append(n)
            pictures = self._decoded(source, track, start, max(asked)) if self.content else ((i, None) for i in asked)
            for i, picture in pictures:
                if picture is None and self.content or i not in asked:
                    continue
                if picture is not None:
                    picture = pixels.rotate(picture, self.options.get("rotation", ""))
                    picture = pixels.at_most_wide(picture, int(self.options["maxwidth"])) if "maxwidth" in self.options else picture
                high, wide = picture.shape[:2] if picture is not None else (track.height, track.width)
                data = picture.tobytes() if picture is not None else None
                for n in asked[i]:
                    out.append((split.path, i, n, float(track.times[i]) * 1000 / track.timescale, wide, high, data))
                    held += len(data or b"")
                if held > BATCH_BYTES or len(out) >= 4096:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)

    def _decoded(self, source: storage.Ranges, track: container.Track, start: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
        samples = (source(int(track.offsets[i]), int(track.sizes[i])) for i in range(start, last + 1))
        yield from zip(range(start, last + 1), self.decoder(samples, track), strict=False)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])


def read_frames(spark: SparkSession, folder: str, decoder: Decoder = raw_rgb, **options: object) -> DataFrame:
    """Frames of the recordings below a folder: path, frame, nth, ms, width, height and content (8-bit RGB, row by row).

    The decoder takes the samples from a sync frame on and gives a picture for each.
    """

    class Frames(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"frames_{decoder.__module__}.{decoder.__qualname__}"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
            return FrameReader(dict(self.options), decoder)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Frames)
    return spark.read.format(Frames.name()).options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load(folder)


PROBE = "path string, codec string, width int, height int, fps_numerator long, fps_denominator long, fps double, frame_count long, duration_sec double, error string"


def probe(files: DataFrame) -> DataFrame:
    """Codec, size, rate, number of frames and duration of recordings (path), a row each; where a header can't be read, why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                try:
                    source = storage.Ranges(path)
                    t = container.parse(source, source.size)
                    source.close()
                    a, b = t.rate
                    rows.append((path, t.codec, t.width, t.height, a, b, a / b, t.frames, t.seconds, None))
                except (ValueError, OSError) as e:
                    rows.append((path, *[None] * 8, f"{type(e).__name__}: {e}"))
            names = [f.split()[0] for f in PROBE.split(", ")]
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return files.select("path").mapInArrow(run, PROBE)
