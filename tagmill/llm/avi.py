"""AVI motion-JPEG as a column type: write, parse, decode and cut into timed clips.

Frames are written as lossless JPEG (ISO 10918-1 annex H: SOF3, 8-bit samples,
one component, predictor 1, one Huffman table, a restart marker after every row),
so stored samples come back bit for bit.  Every restart interval can be decoded
on its own; the decoder walks the rows of many frames in lockstep, one sample of
each row at a time, in numpy.  Frames of other writers are decoded too: lossless
ones of any table, predictor and width, and baseline ones (SOF0 and SOF1, with
the standard tables where a frame holds none, as is usual in AVI), of which the
first component, luminance, is returned.

Texts are encoded and files decoded some hundred frames at a time, so memory
beyond the text, its payload and its file is bounded.

The container is RIFF AVI 1.0 with ``avih``/``strh``/``strf`` headers, ``00dc``
chunks in ``movi`` and an ``idx1`` index, through which frames are found; a file
without a usable index is read by walking ``movi``.

Shots: histograms of neighbouring frames are compared (half their L1 distance,
0 to 1).  A cut falls where a difference is above ``FLOOR`` and above mean plus
``SIGMAS`` standard deviations of the differences of the ``REACH`` frames on
either side.  Clips are the runs between cuts, timed by the frame rate.

Results for odd input: a null or empty text becomes one row of blanks; repeated
rows give equal results; bytes that are no AVI (or null) give no frames and no
clips; a rate of zero counts as ``FPS``.  A damaged row of a lossless frame
repeats its last good sample to its end (128 without any).  A frame that cannot
be decoded (progressive or arithmetic coding, broken headers or tables) is an
empty array; it keeps its time, and shots see the frame before it in its place.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import batched, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tagmill.llm.common import slices, table

WIDTH = 192
ROWS = 16
FPS = 25
FLOOR, SIGMAS, REACH = 0.25, 1.5, 4
#: Frames and rows that are worked at once.
CHUNK_FRAMES, CHUNK_ROWS = 512, 4096

# Code lengths by category (bits of the difference between neighbouring samples, 0 to 8); a prefix code.
CODE_LENGTHS = (6, 5, 5, 4, 3, 2, 2, 3, 6)


def _codes() -> np.ndarray:
    """Canonical codes: by length, then category."""
    codes, code, last = np.zeros(len(CODE_LENGTHS), np.uint32), 0, 0
    for length, category in sorted((n, c) for c, n in enumerate(CODE_LENGTHS)):
        code <<= length - last
        codes[category], code, last = code, code + 1, length
    return codes


CODES = _codes()
PEEK = max(CODE_LENGTHS)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a difference + 255: its code with extra bits, and their number. For PEEK bits: the category."""
    diff = np.arange(-255, 256)
    category = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int64)
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff).astype(np.uint32)
    lengths = np.array(CODE_LENGTHS)[category]
    word = (CODES[category] << category.astype(np.uint32)) | extra
    lookup = np.full(1 << PEEK, 255, np.uint8)
    for c, n in enumerate(CODE_LENGTHS):
        lookup[int(CODES[c]) << (PEEK - n) : (int(CODES[c]) + 1) << (PEEK - n)] = c
    return word, (lengths + category).astype(np.int64), lookup


WORD, WORD_BITS, CATEGORY = _tables()
_DHT = bytes(sum(n == k for n in CODE_LENGTHS) for k in range(1, 17)) + bytes(c for _, c in sorted((n, c) for c, n in enumerate(CODE_LENGTHS)))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode_rows(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes, stuffed, of each row."""
    x = samples.astype(np.int64)
    diff = x.copy()
    diff[:, 1:] -= x[:, :-1]
    diff[:, 0] -= 128
    diff += 255
    word, bits = WORD[diff].astype(np.uint64), WORD_BITS[diff]
    row_bytes = (bits.sum(1) + 7) // 8
    begin = np.concatenate([[0], np.cumsum(row_bytes)])
    at = np.cumsum(bits, axis=1) - bits + 8 * begin[:-1, None]
    byte, room = at >> 3, 32 - (at & 7) - bits
    spread = word << room.astype(np.uint64)
    # A code is at most 14 bits, so with a shift of up to 7 it meets three bytes.
    out = np.zeros(begin[-1] + 4, np.int64)
    for k in range(3):
        out += np.bincount((byte + k).ravel(), ((spread >> np.uint64(24 - 8 * k)) & np.uint64(255)).ravel(), len(out)).astype(np.int64)
    used = bits.sum(1)
    out[begin[1:] - 1] |= (1 << ((8 - used % 8) % 8)) - 1  # the last byte is filled with ones
    raw = out.astype(np.uint8).tobytes()
    return [raw[a:b].replace(b"\xff", b"\xff\x00") for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]


def jpeg(rows: list[bytes], width: int = WIDTH) -> bytes:
    head = b"\xff\xd8" + _segment(0xC4, b"\x00" + _DHT) + _segment(0xC3, struct.pack(">BHHBBBB", 8, len(rows), width, 1, 1, 0x11, 0))
    head += _segment(0xDD, struct.pack(">H", width)) + _segment(0xDA, struct.pack(">BBBBBB", 1, 1, 0, 1, 0, 0))
    scan = b"".join(row + bytes((0xFF, 0xD0 + i % 8)) for i, row in enumerate(rows[:-1])) + rows[-1]
    return head + scan + b"\xff\xd9"


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], width: int = WIDTH, height: int = ROWS, fps: int = FPS) -> bytes:
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    movi, index = [b"movi"], []
    at = 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def parse(data: bytes) -> tuple[float, list[memoryview]]:
    """Frames a second, and the frames by the index (or by walking movi if the index doesn't hold)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        return 0.0, []
    fps, movi, index = float(FPS), None, []
    stack = [(12, len(data))]
    walked = []
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = at + 8
            if name == b"LIST":
                if data[body : body + 4] == b"movi":
                    movi = body
                stack.append((body + 4, min(end, body + size)))
            elif name == b"strh" and data[body : body + 4] == b"vids" and size >= 28:
                scale, rate = struct.unpack_from("<II", data, body + 20)
                fps = rate / scale if scale and rate else fps
            elif name == b"idx1":
                index = [struct.unpack_from("<4sIII", data, k) for k in range(body, min(end, body + size) - 15, 16)]
            elif name[2:] in (b"dc", b"db"):
                walked.append((body, size))
            at = body + size + size % 2
    if movi is not None and index:
        found = [(movi + off + 8, n) for tag, _, off, n in index if tag[2:] in (b"dc", b"db") and data[movi + off : movi + off + 4] == tag]
        if len(found) == sum(tag[2:] in (b"dc", b"db") for tag, *_ in index):
            walked = found
    view = memoryview(data)
    return fps, [view[a : a + n] for a, n in walked]


# The tables of ISO 10918-1 annex K.3, by class (0 DC, 1 AC) and number; codes of each length, then values.
_STANDARD = {
    (0, 0): ("00010501010101010100000000000000", bytes(range(12))),
    (0, 1): ("00030101010101010101010000000000", bytes(range(12))),
    (1, 0): ("0002010303020403050504040000017d", bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")),
    (1, 1): ("00020102040403040705040400010277", bytes.fromhex("0001020311040521310612415107617113223281081442 91a1b1c109233352f0156272d10a162434e125f1".replace(" ", ""))),
}
_ZIGZAG = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))


@lru_cache(256)
def _decoder(lengths: bytes, values: bytes) -> list[int]:
    """For the next 16 bits: length of the code times 256 plus its value, or 0 for no code."""
    out, code, at = [0] * 65536, 0, 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            first, last = code << (16 - n), (code + 1) << (16 - n)
            if last > 65536:
                raise ValueError("a Huffman table with too many codes")
            out[first:last] = [n << 8 | values[at]] * (last - first)
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _standard(kind: int, number: int) -> list[int]:
    lengths, values = _STANDARD[kind, number & 1]
    if kind:  # the rest of the values in ascending order: every run of zeros with every size up to ten bits
        values += bytes(r << 4 | n for r in range(16) for n in range(1, 11) if r << 4 | n not in values)
    return _decoder(bytes.fromhex(lengths), values)


@dataclass
class Head:
    """What the segments before a frame's scan say."""

    kind: int = 0
    height: int = 0
    width: int = 0
    restart: int = 0
    predictor: int = 1
    shift: int = 0
    precision: int = 8
    scan: int = 0
    components: dict[int, tuple[int, int, int]] = field(default_factory=dict)  # number: samplings and quantiser
    order: list[tuple[int, int, int]] = field(default_factory=list)  # number, DC and AC table
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[bytes, bytes]] = field(default_factory=dict)

    def decoder(self, kind: int, number: int) -> list[int]:
        return _decoder(*self.tables[kind, number]) if (kind, number) in self.tables else _standard(kind, number)

    @property
    def own(self) -> bool:
        return self.kind == 0xC3 and self.width == self.restart == WIDTH and len(self.components) == 1 and (self.predictor, self.shift, self.precision) == (1, 0, 8) and self.tables.get((0, 0), (b"", b""))[0] + self.tables.get((0, 0), (b"", b""))[1] == _DHT


def read_head(frame: bytes) -> Head:
    head, at = Head(), 2
    while at + 4 <= len(frame) and frame[at] == 0xFF:
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC4:
            k = 0
            while k + 17 <= len(body):
                lengths = body[k + 1 : k + 17]
                n = sum(lengths)
                head.tables[body[k] >> 4, body[k] & 15] = lengths, body[k + 17 : k + 17 + n]
                k += 17 + n
        elif marker == 0xDB:
            k = 0
            while k + 65 <= len(body):
                wide = body[k] >> 4
                n = 128 if wide else 64
                head.quantisers[body[k] & 15] = np.frombuffer(body[k + 1 : k + 1 + n], ">u2" if wide else "u1").astype(np.float64)
                k += 1 + n
        elif marker == 0xDD:
            head.restart = int.from_bytes(body[:2], "big")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            head.kind, (head.precision, head.height, head.width, n) = marker, struct.unpack_from(">BHHB", body)
            head.components = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
        at += 2 + size
        if marker == 0xDA:
            n = body[0]
            head.order = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(n)]
            head.predictor, head.shift, head.scan = body[1 + 2 * n], body[3 + 2 * n] & 15, at
            break
    return head


def own_rows(frame: bytes, head: Head) -> list[bytes]:
    """The unstuffed restart intervals, one a row, of a frame written by jpeg(); rows that are missing are empty."""
    scan, rows, begin = frame[head.scan :].removesuffix(b"\xff\xd9"), [], 0
    for k in range(head.height):
        # A restart marker cannot occur inside a row: there every FF is followed by 00.
        end = scan.find(bytes((0xFF, 0xD0 + k % 8)), begin) if k < head.height - 1 else len(scan)
        end = len(scan) if end < 0 else end
        rows.append(scan[begin:end].replace(b"\xff\x00", b"\xff"))
        begin = min(end + 2, len(scan))
    return rows


class _Bits:
    """Bits of one restart interval; beyond its end they are zeros, and reading far beyond it is an error."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data) + 32

    def code(self, table: list[int]) -> int:
        k = self.at >> 3
        if self.at > self.end:
            raise ValueError("a scan that ends early")
        entry = table[int.from_bytes(self.data[k : k + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF]
        if not entry:
            raise ValueError("no such code")
        self.at += entry >> 8
        return entry & 255

    def signed(self, n: int) -> int:
        """A difference or coefficient of n bits."""
        if n in (0, 16):
            return 32768 if n else 0
        k = self.at >> 3
        if self.at > self.end:
            raise ValueError("a scan that ends early")
        value = int.from_bytes(self.data[k : k + 4], "big") >> (32 - n - (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return value if value >> (n - 1) else value - (1 << n) + 1


def _intervals(frame: bytes, head: Head) -> list[bytes]:
    scan = frame[head.scan :]
    return [x.replace(b"\xff\x00", b"\xff") for x in re.split(b"\xff[\xd0-\xd7]", re.split(b"\xff[\x01-\xcf\xd8-\xfe]", scan, maxsplit=1)[0])]


_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.125**0.5) for u in range(8)] for x in range(8)])


def decode_baseline(frame: bytes, head: Head) -> np.ndarray:
    """The first component of a sequential Huffman frame of 8 bits."""
    across, down = (max(c[k] for c in head.components.values()) for k in (0, 1))
    plan = [(k, *head.components[number][:2], head.decoder(0, dc), head.decoder(1, ac)) for k, (number, dc, ac) in enumerate(head.order)]
    if len(plan) == 1:
        plan = [(0, 1, 1, *plan[0][3:])]  # a scan of one component is not interleaved
        h, v = head.components[head.order[0][0]][:2]
        wide, high = -(-head.width * h // (8 * across)), -(-head.height * v // (8 * down))
    else:
        wide, high = -(-head.width // (8 * across)), -(-head.height // (8 * down))
    _, h0, v0, *_ = plan[0]
    blocks = np.zeros((high * v0, wide * h0, 64))
    intervals = _intervals(frame, head)
    every = head.restart or wide * high
    for n, data in enumerate(intervals):
        bits, last = _Bits(data), [0] * len(plan)
        for unit in range(n * every, min((n + 1) * every, wide * high)):
            row, column = divmod(unit, wide)
            for k, h, v, dc, ac in plan:
                for i in range(h * v):
                    last[k] += bits.signed(bits.code(dc))
                    block = blocks[row * v0 + i // h, column * h0 + i % h] if k == 0 else None
                    if block is not None:
                        block[0] = last[k]
                    at = 1
                    while at < 64:
                        entry = bits.code(ac)
                        run, n_bits = entry >> 4, entry & 15
                        if not n_bits:
                            if run < 15:
                                break
                            at += 16
                            continue
                        at += run
                        value = bits.signed(n_bits)
                        if at < 64 and block is not None:
                            block[_ZIGZAG[at]] = value
                        at += 1
    number = head.order[0][0]
    scale = np.zeros(64)
    scale[_ZIGZAG] = head.quantisers[head.components[number][2]]
    square = (blocks * scale).reshape(*blocks.shape[:2], 8, 8)
    samples = np.rint(_COSINES @ square @ _COSINES.T + 128).clip(0, 255).astype(np.uint8)
    h, v = head.components[number][:2]
    whole = samples.transpose(0, 2, 1, 3).reshape(8 * blocks.shape[0], 8 * blocks.shape[1])
    return whole[: -(-head.height * v // down), : -(-head.width * h // across)]


def decode_lossless(frame: bytes, head: Head) -> np.ndarray:
    """A lossless frame of one component, by any of the seven predictors."""
    height, width, table = head.height, head.width, head.decoder(0, head.order[0][1])
    out = [[0] * width for _ in range(height)]
    first, modulus = 1 << (head.precision - head.shift - 1), 1 << 16
    every = (head.restart or width * height) // width
    for n, data in enumerate(_intervals(frame, head)):
        bits = _Bits(data)
        for y in range(n * every, min((n + 1) * every, height)):
            row, above = out[y], out[y - 1]
            for x in range(width):
                if y == n * every:
                    guess = row[x - 1] if x else first
                elif not x:
                    guess = above[0]
                else:
                    a, b, c = row[x - 1], above[x], above[x - 1]
                    guess = (a, b, c, a + b - c, a + ((b - c) >> 1), b + ((a - c) >> 1), (a + b) >> 1)[head.predictor - 1]
                row[x] = (guess + bits.signed(bits.code(table))) % modulus
    return ((np.array(out, np.int64) << head.shift) >> max(0, head.precision - 8)).clip(0, 255).astype(np.uint8)


def decode_foreign(frame: bytes, head: Head) -> np.ndarray:
    """A frame of another writer, or an empty array where it cannot be decoded."""
    try:
        # A block of 64 samples takes two bits or more, a lossless sample one: a larger size is no size of this frame.
        if not 0 < head.height * head.width <= 256 * len(frame) or not head.scan:
            return np.empty((0, 0), np.uint8)
        if head.kind in (0xC0, 0xC1) and head.precision == 8:
            return decode_baseline(frame, head)
        if head.kind == 0xC3 and len(head.components) == 1 and 1 <= head.predictor <= 7 and head.height * head.width <= 8 * len(frame):
            return decode_lossless(frame, head)
    except (ValueError, IndexError, KeyError, struct.error):
        pass
    return np.empty((0, 0), np.uint8)


def decode_rows(rows: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Samples of rows of jpeg(), decoded in lockstep."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    data = np.frombuffer(b"".join(rows) + bytes(8), np.uint8).astype(np.uint32)
    words = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    end = 8 * np.cumsum(sizes)
    bit = end - 8 * sizes
    out = np.zeros((width, len(rows)), np.uint8)
    value = np.full(len(rows), 128, np.int64)
    length_of = np.array([*CODE_LENGTHS, *[0] * (256 - len(CODE_LENGTHS))], np.int64)
    for k in range(width):
        have = words[np.minimum(bit, end) >> 3] << (bit & 7).astype(np.uint32)
        category = CATEGORY[have >> np.uint32(32 - PEEK)].astype(np.int64)
        category[bit >= end] = 255  # a row that ends early repeats its last sample
        n = length_of[category]
        category[category == 255] = 0
        # Shifted left by the code, the extra bits lead; two shifts, as a shift by 32 is undefined.
        extra = ((have << n.astype(np.uint32)) >> np.uint32(16) >> (16 - category).astype(np.uint32)).astype(np.int64)
        full = np.int64(1) << category
        value += np.where(extra < full >> 1, extra - full + 1, extra)
        out[k] = value & 255
        bit += n + category
    return out.T


def decode_frames(frames: Iterable[bytes | memoryview]) -> Iterator[np.ndarray]:
    """The samples of every frame, in order; some hundred frames are worked at once."""
    for group in batched(frames, CHUNK_FRAMES):
        rows, found = [], []
        for frame in map(bytes, group):
            try:
                head = read_head(frame)
            except (ValueError, IndexError, struct.error):
                head = Head()
            if head.own:
                found.append(head.height)
                rows += own_rows(frame, head)
            else:
                found.append(decode_foreign(frame, head))
        samples = np.concatenate([decode_rows(rows[k : k + 2 * CHUNK_ROWS]) for k in range(0, len(rows), 2 * CHUNK_ROWS)]) if rows else None
        at = 0
        for x in found:
            if isinstance(x, int):
                yield samples[at : at + x] if samples is not None else np.empty((0, WIDTH), np.uint8)
                at += x
            else:
                yield x


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw)), len(raw)


def histogram_cuts(histograms: np.ndarray) -> list[int]:
    """First frames of all shots but the first."""
    if len(histograms) < 2:
        return []
    share = histograms / histograms.sum(1, keepdims=True).clip(1)
    diff = np.abs(np.diff(share, axis=0)).sum(1) / 2
    cuts = []
    for i, d in enumerate(diff):
        near = diff[max(0, i - REACH) : i + REACH + 1]
        around = np.delete(near, min(i, REACH))
        level = around.mean() + SIGMAS * around.std() if len(around) else 0.0
        if d > FLOOR and d > level:
            cuts.append(i + 1)
    return cuts


def write_media(payloads: list[bytes]) -> list[bytes]:
    """The AVI file of each payload (a multiple of WIDTH bytes)."""
    samples = np.frombuffer(b"".join(payloads) if len(payloads) != 1 else payloads[0], np.uint8).reshape(-1, WIDTH)
    rows = [row for k in range(0, len(samples), CHUNK_ROWS) for row in encode_rows(samples[k : k + CHUNK_ROWS])]
    out, at = [], 0
    for p in payloads:
        n = len(p) // WIDTH
        frames = [jpeg(rows[k : min(k + ROWS, at + n)]) for k in range(at, at + n, ROWS)]
        out.append(avi(frames, height=min(ROWS, n)))
        at += n
    return out


def read_media(files: list[bytes]) -> Iterator[tuple[float, Iterator[np.ndarray]]]:
    """Frames a second and the decoded frames of each file; a file's frames are to be read before the next file."""
    parsed = [parse(f) for f in files]
    decoded = decode_frames(frame for _, frames in parsed for frame in frames)
    for fps, frames in parsed:
        yield fps, islice(decoded, len(frames))


def histogram(frame: np.ndarray) -> np.ndarray:
    return np.bincount((frame >> 2).ravel(), minlength=64)


def histograms(frames: Iterable[np.ndarray]) -> np.ndarray:
    """One row a frame; a frame without samples repeats the row before."""
    out = []
    for f in frames:
        out.append(histogram(f) if f.size or not out else out[-1])
    return np.stack(out) if out else np.zeros((0, 64))


def clips(fps: float, seen: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(first frame, frames, start and end in milliseconds) of each shot, from the histograms of all frames."""
    edges = [0, *histogram_cuts(seen), len(seen)]
    return [(a, b - a, 1000 * a / fps, 1000 * b / fps) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


SHOT = pa.struct([("first_frame", pa.int32()), ("n_frames", pa.int32()), ("start_ms", pa.float64()), ("end_ms", pa.float64())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("clips", pa.list_(SHOT))])


def digest_documents(docs: DataFrame) -> DataFrame:
    """Each whole text stored as an AVI, read back and described, with its timed clips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=1 << 20):
            sizes, payloads = [], []
            for text in part.column("text"):
                payload, n = payload_of(text.as_py())
                payloads.append(payload)
                sizes.append(n)
            files = write_media(payloads)
            payloads.clear()
            out = {name: [] for name in DIGEST.names}
            for doc_id, n, media, (fps, frames) in zip(part.column("doc_id").to_pylist(), sizes, files, read_media(files), strict=True):
                read, size, tail, seen = hashlib.sha256(), 0, b"", []
                for f in frames:
                    back = f.tobytes()
                    read.update(back)
                    size, tail = size + len(back), (tail + back)[-16:]
                    seen.append(histogram(f))
                shots = clips(fps, np.stack(seen))
                row = (doc_id, n, size, read.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), f"{len(seen)} frames; shots at ms " + ",".join(f"{s[2]:.0f}" for s in shots), [dict(zip((f.name for f in SHOT), s, strict=True)) for s in shots])
                for name, value in zip(DIGEST.names, row, strict=True):
                    out[name].append(value)
            yield table(out, DIGEST)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<first_frame:int,n_frames:int,start_ms:double,end_ms:double>>")


CLIPS = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), *SHOT])


def timed_clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, n_frames, start_ms, end_ms of each shot of the files in column media (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media"):
            out = {name: [] for name in CLIPS.names}
            for doc_id, (fps, frames) in zip(part.column("doc_id").to_pylist(), read_media([m or b"" for m in part.column("media").to_pylist()]), strict=True):
                for k, shot in enumerate(clips(fps, histograms(frames))):
                    for name, value in zip(CLIPS.names, (doc_id, k, *shot), strict=True):
                        out[name].append(value)
            yield table(out, CLIPS)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip int, first_frame int, n_frames int, start_ms double, end_ms double")


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and the AVI file of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=1 << 20):
            files = write_media([payload_of(t)[0] for t in part.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, media binary")
