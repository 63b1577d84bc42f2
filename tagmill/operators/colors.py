"""Price tags and panels found by their colours, in pictures of 8-bit RGB stored row by row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.functions import deskew, masks, pixels
from tagmill.operators import suppression
from tagmill.operators.inference import _hsv


@dataclass(frozen=True)
class Settings:
    """What counts as a tag: sizes in pixels, shares of the blob or picture, grey and saturation of 0 to 255."""

    # The defaults.
    kernel: int = 11
    min_area: float = 6500
    extend: float = 1.0
    margin: float = 0.08
    white: float = 108
    saturation: float = 58
    min_short: int = 72
    least_ratio: float = 1.15
    most_ratio: float = 5.2
    most_share: float = 0.06
    first_n: int = 10
    layout_delta: float = 18
    #: Overlap, in percent, from which the smaller of two boxes goes.
    overlap: int = 42


def tag_mask(h: np.ndarray, s: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Orange, red and yellow of tags (hue in half degrees)."""
    orange = (h >= 8) & (h <= 28) & (s >= 55) & (v >= 60)
    red = ((h <= 12) | (h >= 168)) & (s >= 55) & (v >= 50)
    yellow = (h >= 18) & (h <= 45) & (s >= 40) & (v >= 100)
    return orange | red | yellow


def layout_fits(saturation: np.ndarray, box: tuple[int, int, int, int], delta: float) -> bool:
    """Whether the lower part of a box is more saturated than the upper 52 %."""
    x1, y1, x2, y2 = max(0, box[0]), max(0, box[1]), min(saturation.shape[1], box[2]), min(saturation.shape[0], box[3])
    if x2 <= x1 + 4 or y2 <= y1 + 4:
        return False
    part = saturation[y1:y2, x1:x2]
    cut = max(1, int(len(part) * 0.52))
    return bool(part[cut:].mean() >= part[:cut].mean() + delta)


def with_bright_side(grey: np.ndarray, saturation: np.ndarray, x: int, y: int, w: int, h: int, o: Settings) -> tuple[int, int, int, int] | None:
    """A coloured blob with the brightest strip beside it (above, left, right or below, the first of equals)."""
    if saturation[y : y + h, x : x + w].mean() < o.saturation:
        return None
    high, wide = grey.shape
    tall, broad = max(12, int(h * o.extend)), max(12, int(w * o.extend))
    up, left, right, down = max(0, y - tall), max(0, x - broad), min(wide, x + w + broad), min(high, y + h + tall)
    sides = [
        (grey[up:y, x : x + w], (x, up, x + w, y + h)), (grey[y : y + h, left:x], (left, y, x + w, y + h)),
        (grey[y : y + h, x + w : right], (x, y, right, y + h)), (grey[y + h : down, x : x + w], (x, y, x + w, down)),
    ]
    light = [(float(strip.mean()), -k, box) for k, (strip, box) in enumerate(sides) if strip.size]
    light = [side for side in light if side[0] >= o.white]
    if not light:
        return None
    x1, y1, x2, y2 = max(light)[2]
    return max(0, int(x1 - w * o.margin)), y1, min(wide, int(x2 + w * o.margin)), y2


def candidates(rgb: np.ndarray, o: Settings) -> list[tuple[int, int, int, int]]:
    """Boxes of one picture, before overlaps are settled."""
    h, s, v = _hsv(rgb)
    r = max(3, o.kernel | 1) // 2
    mask = masks.dilate(masks.closed(tag_mask(h, s, v), 2 * r), r)
    grey = np.rint(rgb.astype(np.float64) @ (0.299, 0.587, 0.114))
    out = []
    for x, y, w, t, area in masks.outlines(mask).tolist():
        if area < o.min_area or w < 8 or t < 8:
            continue
        box = with_bright_side(grey, s, int(x), int(y), int(w), int(t), o)
        if box is None:
            continue
        wide, high = box[2] - box[0], box[3] - box[1]
        short, long = min(wide, high), max(wide, high)
        if short < o.min_short or not o.least_ratio <= long / max(1, short) <= o.most_ratio or wide * high > o.most_share * rgb.shape[0] * rgb.shape[1]:
            continue
        if layout_fits(s, box, o.layout_delta):
            out.append(box)
    return out


def red_panel(rgb: np.ndarray) -> tuple[float, float, float, float] | None:
    """Place of the largest red component of at least 4 % of a picture, in shares of its width and height."""
    h, s, v = _hsv(rgb)
    mask = masks.opened(((h <= 15) | (h >= 165)) & (s >= 70) & (v >= 50), 2)
    found = masks.components(mask)
    high, wide = mask.shape
    if not len(found) or found[:, 4].max() < 0.04 * high * wide:
        return None
    x, y, w, t, _ = found[int(found[:, 4].argmax())].tolist()
    return x / wide, y / high, (x + w) / wide, (y + t) / high


def _pictures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray | None]]:
    for batch in batches:
        contents = batch.column("content")
        for k, (path, w, h) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("path", "width", "height")], strict=True)):
            content = contents[k].as_buffer()
            fits = content is not None and w and h and w > 0 and h > 0 and content.size >= 3 * w * h
            yield path, np.frombuffer(content, np.uint8, 3 * w * h).reshape(h, w, 3) if fits else None


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 512, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most so many rows, ended by the row that brings their last cells, if bytes, to `most_bytes`."""
    some, held = [], 0
    for row in rows:
        some.append(row)
        held += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(some) == most or held >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
            some, held = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)


def detect_tags(images: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Tags of pictures (path, width, height, content): path, x1, y1, x2, y2 and score (the box's area), the largest first_n of a picture.

    Of boxes that overlap the largest stays.  Pictures that are null, empty or shorter than their size have no tags.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path, *box, (box[2] - box[0]) * (box[3] - box[1]), k) for path, rgb in _pictures(batches) if rgb is not None for k, box in enumerate(candidates(rgb, settings)))
        yield from _batched(rows, pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("x1", "y1", "x2", "y2", "score", "nth"))]))

    found = images.select("path", "width", "height", "content").mapInArrow(run, "path string, x1 long, y1 long, x2 long, y2 long, score long, nth long")
    order = [-F.col("score"), F.col("nth")]
    kept = suppression.nms(found, ["path"], order, ["x1", "y1", "x2", "y2", "score", "nth"], settings.overlap, 100, settings.first_n)
    return kept.select("path", "x1", "y1", "x2", "y2", "score")


def panels(images: DataFrame) -> DataFrame:
    """path and panel (x1, y1, x2, y2 in shares of the picture), null where a picture has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([(c, pa.float64()) for c in ("x1", "y1", "x2", "y2")])
        found = ((path, red_panel(rgb) if rgb is not None else None) for path, rgb in _pictures(batches))
        yield from _batched(((path, dict(zip(kind.names, panel, strict=True)) if panel else None) for path, panel in found), pa.schema([("path", pa.string()), ("panel", kind)]))

    return images.select("path", "width", "height", "content").mapInArrow(run, "path string, panel struct<x1:double,y1:double,x2:double,y2:double>")


def straightened(images: DataFrame) -> DataFrame:
    """Pictures (path, width, height, content) deskewed: in their new size, with ok; those without a clear outline stay as they are, ok false.

    Broken pictures come back without content, ok false.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for path, rgb in _pictures(batches):
                out, ok = deskew.deskew(rgb) if rgb is not None else (None, False)
                yield (path, ok, *((out.shape[1], out.shape[0], out.tobytes()) if out is not None else (None, None, None)))

        yield from _batched(rows(), pa.schema([("path", pa.string()), ("ok", pa.bool_()), ("width", pa.int32()), ("height", pa.int32()), ("content", pa.binary())]))

    found = images.select("path", "width", "height", "content").mapInArrow(run, "path string, ok boolean, width int, height int, content binary")
    return found.select("path", "width", "height", "content", "ok")


def crops(images: DataFrame, boxes: DataFrame, pad: float = 0.0, turn: str = "", least_side: int | None = None) -> DataFrame:
    """Boxes (path, box, x1, y1, x2, y2) cut out of their pictures, turned and scaled up: path, box, width, height, content.

    A picture meets all its boxes at once, so it is shuffled and opened once. Boxes of missing or broken pictures have no row.
    The join is by sorting: pictures made in tasks look small to the planner, and broadcast they would all pass through the driver.
    """
    of_picture = boxes.groupBy("path").agg(F.collect_list(F.struct("box", "x1", "y1", "x2", "y2")).alias("boxes"))
    box_type = dict(boxes.dtypes)["box"]
    out = T.StructType([images.schema["path"], boxes.schema["box"], *T.StructType.fromDDL("width int, height int, content binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.string() if box_type == "string" else pa.int32() if box_type == "int" else pa.int64()
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                path, rgb = next(_pictures(iter([one])))
                for b in one.column("boxes").to_pylist()[0] if rgb is not None else ():
                    part = pixels.rotate(pixels.crop(rgb, b["x1"], b["y1"], b["x2"], b["y2"], pad), turn)
                    part = pixels.at_least_high(part, least_side) if least_side else part
                    values = ([path], pa.string()), ([b["box"]], kind), ([part.shape[1]], pa.int32()), ([part.shape[0]], pa.int32()), ([part.tobytes()], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in values], ["path", "box", "width", "height", "content"])

    return images.select("path", "width", "height", "content").join(of_picture.hint("merge"), "path").mapInArrow(run, out)
