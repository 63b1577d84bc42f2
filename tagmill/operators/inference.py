"""The boundary to models: functions of an image that Spark maps over, and the columns they give.

A model is a factory without arguments; each Python worker calls it once.  The
data plane around it is Spark's; what a model does with pixels is its own affair.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Detector = Callable[[bytes], list[tuple[int, str, float, float, float, float, float]]]
Reader = Callable[[bytes], list[tuple[str, float]]]
_MODELS: dict[object, object] = {}


@dataclass
class Registry:
    """Named factories of recognition engines; those whose probe fails count as not installed."""

    engines: dict[str, Callable[[], Reader]] = field(default_factory=dict)

    def add(self, name: str, factory: Callable[[], Reader]) -> None:
        self.engines[name] = factory

    def installed(self) -> list[str]:
        found = []
        for name, factory in self.engines.items():
            try:
                factory()
                found.append(name)
            except Exception:  # noqa: BLE001  a probe may fail in any way
                continue
        return found


def _model(factory: Callable):  # noqa: ANN202
    if factory not in _MODELS:
        _MODELS[factory] = factory()
    return _MODELS[factory]


def detect(images: DataFrame, factory: Callable[[], Detector], rows: int = 8) -> DataFrame:
    """path, content to detections, any number for each image; `rows` images at once in a worker."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(factory)
        for part in parts:
            for start in range(0, len(part), rows):
                some = part.iloc[start : start + rows]
                found = [(path, *box) for path, content in zip(some["path"], some["content"], strict=True) for box in model(content)]
                yield pd.DataFrame(found, columns=["image_path", "class_id", "class_name", "confidence", "x_min", "y_min", "x_max", "y_max"])

    return images.select("path", "content").mapInPandas(run, "image_path string, class_id int, class_name string, confidence double, x_min double, y_min double, x_max double, y_max double")


def recognize(images: DataFrame, engines: dict[str, Callable[[], Reader]]) -> DataFrame:
    """One row for each image and engine: lines, seconds, and the error where the engine failed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, content, engine in zip(part["path"], part["content"], part["engine"], strict=True):
                began, lines, error = time.perf_counter(), [], None
                try:
                    lines = [{"text": t, "score": float(s)} for t, s in _model(engines[engine])(content)]
                except Exception as e:  # noqa: BLE001  a failing engine is a result
                    error = f"{type(e).__name__}: {e}"
                out.append((path, engine, time.perf_counter() - began, " | ".join(x["text"] for x in lines), lines, error))
            yield pd.DataFrame(out, columns=["image_path", "engine", "elapsed_sec", "full_text", "lines", "error"])

    pairs = images.select("path", "content").withColumn("engine", F.explode(F.array(*[F.lit(e) for e in engines])))
    return pairs.mapInPandas(run, "image_path string, engine string, elapsed_sec double, full_text string, lines array<struct<text:string,score:double>>, error string")


def decode_frames(videos: DataFrame, factory: Callable[[], Callable[[bytes], Iterator[bytes]]], stride: int = 1, limit: int | None = None) -> DataFrame:
    """path, content to frames with the number that they have in the recording (striding does not renumber them)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = _model(factory)
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                kept = 0
                for n, image in enumerate(decoder(content)):
                    if limit is not None and kept >= limit:
                        break
                    if n % stride == 0:
                        kept += 1
                        yield pd.DataFrame({"path": [path], "frame": [n], "content": [image]})

    return videos.select("path", "content").mapInPandas(run, "path string, frame long, content binary")


def transform(content: Column, factory: Callable[[], Callable[[bytes], bytes]]) -> Column:
    """An image through a function (rotation, crop, deskew, upscaling); where it fails the image stays, with ok false."""

    @F.pandas_udf("content binary, ok boolean")
    def run(images: pd.Series) -> pd.DataFrame:
        model, out = _model(factory), []
        for image in images:
            try:
                out.append((model(image), True))
            except Exception:  # noqa: BLE001
                out.append((image, False))
        return pd.DataFrame(out, columns=["content", "ok"])

    return run(content)


def quality(pixels: Column, width: Column, height: Column) -> Column:
    """Variance of the Laplacian, mean and deviation of 8-bit grey pixels stored row by row; null where the size is
    unknown or negative, or more than the pixels given."""

    @F.pandas_udf("blur_score double, brightness_mean double, contrast_std double")
    def run(images: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.DataFrame:
        out = []
        for image, w, h in zip(images, widths, heights, strict=True):
            raw = np.frombuffer(image or b"", np.uint8)
            if pd.isna(w) or pd.isna(h) or w < 0 or h < 0 or raw.size < w * h:
                out.append((None, None, None))
                continue
            w, h = int(w), int(h)
            a = raw[: w * h].astype(np.float64).reshape(h, w)
            inner = 4 * a[1:-1, 1:-1] - a[:-2, 1:-1] - a[2:, 1:-1] - a[1:-1, :-2] - a[1:-1, 2:] if h > 2 and w > 2 else np.zeros((1, 1))
            out.append((float(inner.var()), float(a.mean()) if a.size else 0.0, float(a.std()) if a.size else 0.0))
        return pd.DataFrame(out, columns=["blur_score", "brightness_mean", "contrast_std"]).astype("float64")

    return run(pixels, width, height)


def decode_codes(content: Column, factory: Callable[[], Callable[[bytes], list[str]]]) -> Column:
    """Barcode and QR payloads of an image, none where the decoder fails."""

    @F.pandas_udf("array<string>")
    def run(images: pd.Series) -> pd.Series:
        model, out = _model(factory), []
        for image in images:
            try:
                out.append(list(model(image)))
            except Exception:  # noqa: BLE001
                out.append([])
        return pd.Series(out)

    return run(content)


def panel_color(red: Column, yellow: Column) -> Column:
    """red where its share of pixels is over .12 and no less than yellow's; yellow where over .08; else blank."""
    return F.when((red >= yellow) & (red > 0.12), "red").when(yellow > 0.08, "yellow").otherwise("")


@lru_cache(1)
def _hsv_tables() -> tuple[np.ndarray, np.ndarray]:
    """Hue by sector (red, green or blue is most), difference of the two others + 255, and span; saturation by most and span."""
    sector, less, span = np.ix_((0.0, 2.0, 4.0), np.arange(-255.0, 256.0), np.where(np.arange(256) == 0, 1.0, np.arange(256.0)))
    hue = np.where(np.arange(256) == 0, 0.0, (sector + less / span) * 30)
    most, span = np.arange(256.0)[:, None], np.arange(256.0)
    return (np.rint(hue % 180) % 180).astype(np.uint8), np.minimum(np.rint(255 * span / np.where(most == 0, 1.0, most)), 255).astype(np.uint8)


def _hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in half degrees (0 to 179), saturation and value of 0 to 255, rounded, of 8-bit pixels."""
    r, g, b = (np.ascontiguousarray(rgb[..., k]) for k in range(3))
    most = np.maximum(np.maximum(r, g), b)
    span = most - np.minimum(np.minimum(r, g), b)
    hues, saturations = _hsv_tables()
    red, green = most == r, most == g
    first, second = np.where(red, g, np.where(green, b, r)), np.where(red, b, np.where(green, r, g))
    at = np.where(red, 0, np.where(green, 511, 1022)) + (first.astype(np.int16) - second + 255)
    return hues.reshape(-1)[(at << 8) + span], saturations.reshape(-1)[(most.astype(np.int32) << 8) + span], most


def color_shares(pixels: Column) -> Column:
    """Shares of red and yellow pixels of 8-bit RGB stored pixel by pixel; null without a whole pixel, a broken last one is left out."""

    @F.pandas_udf("red double, yellow double")
    def run(images: pd.Series) -> pd.DataFrame:
        out = []
        for image in images:
            raw = np.frombuffer(image or b"", np.uint8)
            h, s, v = _hsv(raw[: raw.size // 3 * 3].reshape(-1, 3))
            if not h.size:
                out.append((None, None))
                continue
            # The colours of panels.
            red = ((h <= 12) | (h >= 170)) & (s >= 80) & (v >= 60)
            yellow = (h >= 15) & (h <= 40) & (s >= 80) & (v >= 80)
            out.append((float(red.mean()), float(yellow.mean())))
        return pd.DataFrame(out, columns=["red", "yellow"]).astype("float64")

    return run(pixels)


def with_fallback(first: Callable[[], Reader], second: Callable[[], Reader]) -> Callable[[], Reader]:
    """A factory whose engine asks the second where the first, or its start, fails."""

    def make() -> Reader:
        try:
            ahead = first()
        except Exception:  # noqa: BLE001  an engine that can't start is one that fails
            return second()
        behind: list[Reader] = []

        def read(image: bytes) -> list[tuple[str, float]]:
            try:
                return ahead(image)
            except Exception:  # noqa: BLE001
                if not behind:
                    behind.append(second())
                return behind[0](image)

        return read

    return make


def track(frames: DataFrame, video: str, frame: str, payload: str, factory: Callable[[], Callable]) -> DataFrame:
    """Track numbers of the detections in each recording, frame after frame, by a tracker that keeps state.

    A tracker is a function of one frame's payload that gives (track_id, detection JSON) rows.  A recording is sorted in one task, as the
    state asks, and streams through it: memory is a batch and the tracker's own state, not the recording.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracker = None, None
        for part in parts:
            out = []
            for v, f, image in zip(part[video], part[frame], part[payload], strict=True):
                if tracker is None or v != now:
                    now, tracker = v, factory()
                out += [(v, f, int(t), d) for t, d in tracker(image)]
            yield pd.DataFrame(out, columns=[video, frame, "track_id", "detection"])

    types = dict(frames.dtypes)
    ordered = frames.select(video, frame, payload).repartition(video).sortWithinPartitions(video, frame)
    return ordered.mapInPandas(run, f"{video} {types[video]}, {frame} {types[frame]}, track_id long, detection string")


def polygon_box(points: Column) -> Column:
    """Bounding box of a polygon of (x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))
