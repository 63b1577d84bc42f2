"""EAN-13 from pixels: pictures become scan lines, lines become votes, the code with most votes counts.

A picture gives lines in two directions, each cut at two grey levels; a line's dark and light runs are
compared, in windows of the 59 runs of a code, forward and backward, with the code sets; a code
counts only with a right check digit.  Lines that are equal are read once, with the weight of all,
and votes are an aggregate with map-side combine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Widths of a digit's four runs in modules (set L; R has the same, G the reverse), and by first digit the sets of the left half.
WIDTHS = ("3211", "2221", "2122", "1411", "1132", "1231", "1114", "1312", "1213", "3112")
PARITY = ("LLLLLL", "LLGLGG", "LLGGLG", "LLGGGL", "LGLLGG", "LGGLLG", "LGGGLL", "LGLGLG", "LGLGGL", "LGGLGL")
_LEFT = {w: (str(d), "L") for d, w in enumerate(WIDTHS)} | {w[::-1]: (str(d), "G") for d, w in enumerate(WIDTHS)}
_FIRST = {p: str(d) for d, p in enumerate(PARITY)}
RUNS, MODULES = 59, 95


def modules(code: str) -> list[int]:
    """Widths of the runs of a code, dark first."""
    sets = PARITY[int(code[0])]
    left = [int(w) for d, s in zip(code[1:7], sets, strict=True) for w in (WIDTHS[int(d)] if s == "L" else WIDTHS[int(d)][::-1])]
    return [1, 1, 1, *left, 1, 1, 1, 1, 1, *[int(w) for d in code[7:] for w in WIDTHS[int(d)]], 1, 1, 1]


_GREY = np.array([0.299, 0.587, 0.114])
_DIGITS = np.r_[3:27, 32:56]
_GUARDS = np.r_[0:3, 27:32, 56:59]
_BY_WIDTHS = {int(w): v for w, v in _LEFT.items()}


def _codes(windows: np.ndarray) -> set[str]:
    """The codes among windows of runs; a window that is none gives none."""
    units = windows.sum(axis=1, keepdims=True) / MODULES
    fits = (units[:, 0] >= 1) & (np.abs(windows[:, _GUARDS] / units - 1) <= 0.6).all(axis=1)
    found = set()
    for four in windows[fits][:, _DIGITS].reshape(-1, 12, 4):
        read = np.rint(four * 7 / four.sum(axis=1, keepdims=True)).astype(int) @ (1000, 100, 10, 1)
        digits = [_BY_WIDTHS.get(v) for v in read.tolist()]
        if None in digits or any(kind != "L" for _, kind in digits[6:]):
            continue
        first = _FIRST.get("".join(kind for _, kind in digits[:6]))
        code = first + "".join(d for d, _ in digits) if first else ""
        if code and sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(code)) % 10 == 0:
            found.add(code)
    return found


def codes_of_line(grey: np.ndarray) -> set[str]:
    """Codes along a line of grey pixels, read from either end, for each of two levels of dark."""
    found, seen = set(), []
    for level in {float(grey.mean()), (float(grey.min()) + float(grey.max())) / 2} if grey.size else ():
        dark = grey < level
        if any((dark == other).all() for other in seen):
            continue
        seen.append(dark)
        edges = np.flatnonzero(dark[1:] != dark[:-1]) + 1
        widths = np.diff(np.concatenate([[0], edges, [len(grey)]]))
        first = 0 if dark[0] else 1
        if len(widths) >= RUNS + first:
            windows = np.lib.stride_tricks.sliding_window_view(widths, RUNS)[first::2]
            found |= _codes(windows) | _codes(windows[:, ::-1])
    return found


def scan_lines(images: DataFrame, every: int = 1) -> DataFrame:
    """Grey lines of pictures (path, width, height, content: 8-bit RGB), across and down, every so many: each different one of a
    picture once, with the number `n` of those like it.  Broken pictures have none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes, int]]:
        for batch in batches:
            contents = batch.column("content")
            for k, (path, w, h) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("path", "width", "height")], strict=True)):
                content = contents[k].as_buffer()
                if content is None or not w or not h or w < 0 or h < 0 or content.size < 3 * w * h:
                    continue
                grey = np.rint(np.frombuffer(content, np.uint8, 3 * w * h).reshape(h, w, 3) @ _GREY).astype(np.uint8)
                # A module is a pixel wide or more, so shorter lines can't hold a code.
                for line, n in Counter(line.tobytes() for way in (grey, grey.T) if way.shape[1] >= MODULES for line in way[::every]).items():
                    yield path, line, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batched(rows(batches), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.binary(), pa.int64()), strict=True)], ["path", "line", "n"])

    return images.select("path", "width", "height", "content").mapInArrow(run, "path string, line binary, n long")


def votes(lines: DataFrame) -> DataFrame:
    """(path, code, n) for each code that a line shows, n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(path, code, n) for path, line, n in zip(*[batch.column(c).to_pylist() for c in ("path", "line", "n")], strict=True) for code in codes_of_line(np.frombuffer(line, np.uint8))]
            paths, codes, ns = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(codes, pa.string()), pa.array(ns, pa.int64())], ["path", "code", "n"])

    return lines.mapInArrow(run, "path string, code string, n long")


def barcodes(images: DataFrame, every: int = 1) -> DataFrame:
    """path, code and votes: of each picture the code that most lines show, of equals the least; pictures without one have no row."""
    counted = votes(scan_lines(images, every)).groupBy("path", "code").agg(F.sum("n").alias("votes"))
    # The least of equals: the code's complement to nines grows as it falls.
    best = F.max_by(F.struct("code", "votes"), F.struct("votes", F.translate("code", "0123456789", "9876543210")))
    return counted.groupBy("path").agg(best.alias("b")).select("path", "b.code", "b.votes")
