"""Headers of MP4/QuickTime and AVI files, read in ranges: kilobytes of a file of any size.

An MP4 is a tree of boxes (length, four-letter name, content).  The moov box holds, for
each track, its clock, size, codec and the sample tables: durations (stts), sync samples
(stss), sizes (stsz), and chunks (stsc, stco/co64), from which the place of each frame
follows.  Other boxes (the media themselves) are stepped over by their lengths.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

Read = Callable[[int, int], bytes]


@dataclass
class Track:
    """The first video track of a file; `offsets`, `sizes` and `times` (in ticks of `timescale`) are by frame."""

    codec: str
    width: int
    height: int
    timescale: int
    duration: int
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Numbers of frames that decode on their own, None where all do.
    sync: np.ndarray | None = None
    #: Duration of a frame where the file says no more (fragmented files).
    tick: int = 0

    @property
    def rate(self) -> tuple[int, int]:
        """Frames a second as a fraction; (0, 1) where unknown."""
        n = len(self.times)
        pair = (n * self.timescale, self.duration) if n and self.duration else (self.timescale, self.tick) if self.tick else (0, 1)
        g = int(np.gcd(*pair)) or 1
        return pair[0] // g, pair[1] // g

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    @property
    def frames(self) -> int:
        """Frames by the tables, else what duration and rate come to."""
        a, b = self.rate
        return len(self.times) or round(self.seconds * a / b)


def _boxes(read: Read, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """(name, begin, end of content) of the boxes of a range."""
    while start + 8 <= end:
        size, name = struct.unpack(">I4s", read(start, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", read(start + 8, 8))[0], 16
        size = size or end - start  # the last box may reach to the end
        if size < head:
            raise ValueError(f"box of {size} bytes at {start}")
        yield name.decode("latin-1"), start + head, min(start + size, end)
        start += size


def _table(data: bytes, at: int, columns: int, dtype: str = ">u4") -> np.ndarray:
    """A counted table of a full box: version and flags, a count, and that many rows."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    width = columns * np.dtype(dtype).itemsize
    n = min(n, (len(data) - at - 8) // width)
    return np.frombuffer(data, dtype, n * columns, at + 8).astype(np.int64).reshape(n, columns)


def _clock(data: bytes, at: int) -> tuple[int, int]:
    """Timescale and duration of an mvhd or mdhd box, in either version."""
    return struct.unpack_from(">IQ", data, at + 20) if data[at] == 1 else struct.unpack_from(">II", data, at + 12)


def _offsets(chunks: np.ndarray, runs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Place of each sample: chunks by place, runs of (first chunk, samples a chunk, description), sizes by sample."""
    if not len(runs) or not len(chunks):
        return np.zeros(0, np.int64)
    reach = np.diff(np.append(runs[:, 0] - 1, len(chunks)))
    in_chunk = np.repeat(runs[:, 1], np.maximum(reach, 0))[: len(chunks)]
    first = np.repeat(np.cumsum(in_chunk) - in_chunk, in_chunk)[: len(sizes)]
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else sizes
    place = np.repeat(chunks[: len(in_chunk)], in_chunk)[: len(sizes)]
    return place + before[: len(place)] - before[first]


def _mp4(read: Read, size: int) -> Track:
    movie = next(((a, b) for name, a, b in _boxes(read, 0, size) if name == "moov"), None)
    if movie is None:
        raise ValueError("no moov box")
    data = read(movie[0], movie[1] - movie[0])
    inside = lambda a, b: _boxes(lambda at, n: data[at : at + n], a, b)
    top = list(inside(0, len(data)))
    header = next(_clock(data, a) for name, a, _ in top if name == "mvhd")
    tick = next((struct.unpack_from(">I", data, c + 12)[0] for name, a, b in top if name == "mvex" for inner, c, _ in inside(a, b) if inner == "trex"), 0)
    for name, a, b in top:
        if name != "trak":
            continue
        found: dict[str, tuple[int, int]] = {}
        stack = [(a, b)]
        while stack:
            for inner, c, d in inside(*stack.pop()):
                found[inner] = (c, d)
                if inner in ("mdia", "minf", "stbl"):
                    stack.append((c, d))
        if "hdlr" not in found or data[found["hdlr"][0] + 8 : found["hdlr"][0] + 12] != b"vide":
            continue
        at = found["tkhd"][0]
        wide, high = struct.unpack_from(">II", data, at + (88 if data[at] == 1 else 76))
        track = Track("", wide >> 16, high >> 16, *(_clock(data, found["mdhd"][0]) if "mdhd" in found else header), tick=tick)
        if "stsd" in found:
            at = found["stsd"][0]
            track.codec = data[at + 12 : at + 16].decode("latin-1")
            coded = struct.unpack_from(">HH", data, at + 8 + 32)
            track.width, track.height = (track.width or coded[0]), (track.height or coded[1])
        if "stts" in found:
            runs = _table(data, found["stts"][0], 2)
            steps = np.repeat(runs[:, 1], runs[:, 0])
            track.times = np.concatenate([[0], np.cumsum(steps)[:-1]]).astype(np.int64) if len(steps) else steps
        if "stsz" in found:
            at = found["stsz"][0]
            same, n = struct.unpack_from(">II", data, at + 4)
            track.sizes = np.full(n, same, np.int64) if same else _table(data, at + 4, 1)[:, 0]
        if "stss" in found:
            track.sync = _table(data, found["stss"][0], 1)[:, 0] - 1
        chunks = _table(data, found["co64"][0], 1, ">u8") if "co64" in found else _table(data, found["stco"][0], 1) if "stco" in found else np.zeros((0, 1), np.int64)
        track.offsets = _offsets(chunks[:, 0], _table(data, found["stsc"][0], 3) if "stsc" in found else np.zeros((0, 3), np.int64), track.sizes)
        return track
    raise ValueError("no video track")


def _avi(read: Read, size: int) -> Track:
    head = read(0, 1024)
    at = head.find(b"avih")
    if at < 0 or len(head) < at + 48:
        raise ValueError("no avih chunk")
    micros, _, _, _, frames, _, _, _, width, height = struct.unpack_from("<10I", head, at + 8)
    codec = head[head.find(b"strh") + 12 : head.find(b"strh") + 16].decode("latin-1") if b"strh" in head else ""
    return Track(codec, width, height, 1_000_000, frames * micros, tick=micros)


def parse(read: Read, size: int) -> Track:
    """The video track of a file; ValueError where there is none or the file is damaged."""
    try:
        magic = read(0, 12)
        return _avi(read, size) if magic[:4] == b"RIFF" and magic[8:] == b"AVI " else _mp4(read, size)
    except (struct.error, IndexError, StopIteration, KeyError) as e:
        raise ValueError(f"damaged header: {e}") from e


def _box(name: str, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, name.encode()) + body


def write_mp4(frames: list[bytes], width: int, height: int, timescale: int, tick: int, codec: str = "raw ", chunk: int = 4, header_first: bool = True, sync: list[int] | None = None) -> bytes:
    """A file of frames, `chunk` of them a chunk, each `tick` of `timescale` long; those in `sync`, or all, decode on their own."""
    n, sizes = len(frames), [len(f) for f in frames]
    kind = _box("ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")
    full, unity = struct.pack(">I", 0), struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[::chunk].astype(np.int64) if n else np.zeros(0, np.int64)

    def movie(base: int) -> bytes:
        runs = ([(1, chunk, 1)] if n >= chunk else []) + ([(n // chunk + 1, n % chunk, 1)] if n % chunk else [])
        entry = struct.pack(">I4s6xH16xHH", 86, codec.encode(), 1, width, height) + struct.pack(">IIIH32xHh", 72 << 16, 72 << 16, 0, 1, 24, -1)
        tables = _box("stbl",
            _box("stsd", full, struct.pack(">I", 1), entry), _box("stts", full, struct.pack(">III", 1, n, tick) if n else struct.pack(">I", 0)),
            _box("stsc", full, struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]), _box("stsz", full, struct.pack(">II", 0, n), *[struct.pack(">I", s) for s in sizes]),
            *([_box("stss", full, struct.pack(">I", len(sync)), *[struct.pack(">I", i + 1) for i in sync])] if sync is not None else []),
            _box("stco", full, struct.pack(">I", len(starts)), (starts + base).astype(">u4").tobytes()))
        media = _box("mdia", _box("mdhd", full, struct.pack(">IIIIHH", 0, 0, timescale, n * tick, 0, 0)), _box("hdlr", full, b"\0\0\0\0vide", bytes(13)), _box("minf", tables))
        head = _box("tkhd", full, struct.pack(">5I8xHHHH", 0, 0, 1, 0, n * tick, 0, 0, 0, 0), unity, struct.pack(">II", width << 16, height << 16))
        return _box("moov", _box("mvhd", full, struct.pack(">IIII", 0, 0, timescale, n * tick), bytes(80)), _box("trak", head, media))

    data = _box("mdat", *frames)
    if header_first:
        base = len(kind) + len(movie(0)) + 8
        return kind + movie(base) + data
    return kind + data + movie(len(kind) + 8)
