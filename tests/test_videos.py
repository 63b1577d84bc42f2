"""Headers of recordings, frames as a scan, and pictures as arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagmill.functions import pixels
from tagmill.sources import container, frames, storage


def picture(k, wide=6, high=4):
    return np.random.default_rng(k).integers(0, 256, (high, wide, 3), dtype=np.uint8)


def stored(tmp_path, files):
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def movie(n, **more):
    return container.write_mp4([picture(k).tobytes() for k in range(n)], 6, 4, 1000, 40, **more)


def counted(data):
    taken = []

    def read(at, n):
        taken.append(n)
        return data[at : at + n]

    return read, taken


@pytest.mark.parametrize("header_first", [True, False])
@pytest.mark.parametrize("n", [0, 1, 4, 7, 50])
def test_header_gives_size_rate_and_places(header_first, n):
    data = movie(n, header_first=header_first)
    read, _ = counted(data)
    t = container.parse(read, len(data))
    assert (t.codec, t.width, t.height, t.frames, t.seconds) == ("raw ", 6, 4, n, n * 0.04)
    assert t.rate == ((25, 1) if n else (0, 1))
    assert [data[o : o + s] for o, s in zip(t.offsets, t.sizes, strict=True)] == [picture(k).tobytes() for k in range(n)]


def test_a_large_file_costs_its_header(spark, tmp_path):
    big = container.write_mp4([bytes(1 << 20)] * 20, 8, 8, 30000, 1001, header_first=False)
    read, taken = counted(big)
    assert container.parse(read, len(big)).rate == (30000, 1001) and sum(taken) < 2000
    wide = big.replace(b"mdat", b"mdat", 1)
    at = wide.index(b"mdat") - 4
    wide = wide[:at] + (1).to_bytes(4, "big") + b"mdat" + (20 * (1 << 20) + 16).to_bytes(8, "big") + wide[at + 8 :]  # a 64-bit length
    read, taken = counted(wide)
    assert container.parse(read, len(wide)).frames == 20 and sum(taken) < 2000


def test_fragmented_and_avi_headers():
    head = movie(0)
    at = head.index(b"mvhd") + 16
    trex = container._box("mvex", container._box("trex", bytes(12), (40).to_bytes(4, "big"), bytes(8)))
    moov = head.index(b"moov") - 4
    size = int.from_bytes(head[moov : moov + 4], "big")
    data = bytearray(head[:moov] + (size + len(trex)).to_bytes(4, "big") + head[moov + 4 : moov + size] + trex)
    at = data.index(b"mdhd") + 20
    data[at : at + 4] = (2020).to_bytes(4, "big")
    t = container.parse(lambda a, n: bytes(data[a : a + n]), len(data))
    assert (t.rate, t.frames) == ((25, 1), round(2.02 * 25))  # no table: duration times rate
    avi = b"RIFF" + bytes(4) + b"AVI LIST" + bytes(4) + b"hdrlavih" + (56).to_bytes(4, "little") + b"".join(v.to_bytes(4, "little") for v in (40000, 0, 0, 0, 75, 0, 1, 0, 640, 480)) + bytes(16)
    t = container.parse(lambda a, n: avi[a : a + n], len(avi))
    assert (t.width, t.height, t.frames, t.rate, t.seconds) == (640, 480, 75, (25, 1), 3.0)


def test_probe_of_damaged_files(spark, tmp_path):
    good = movie(5)
    cut = {f"cut_{k}.mp4": good[:k] for k in (0, 5, 30, 60, 200, 400)}
    folder = stored(tmp_path, {"a b.mp4": good, "no.mp4": b"\0\0\0\2moov", **cut})
    files = spark.createDataFrame(storage.files(folder), "path string, length long")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in frames.probe(files).collect()}
    assert rows["a b.mp4"].frame_count == 5 and rows["a b.mp4"].error is None and rows["a b.mp4"].fps == 25
    assert all(rows[k].error and rows[k].width is None for k in ("no.mp4", "cut_0.mp4", "cut_5.mp4", "cut_30.mp4", "cut_60.mp4"))
    assert frames.read_frames(spark, folder).groupBy("path").count().count() >= 1


def content(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.frame, r.nth, bytes(r.content)) for r in df.collect())


def test_frames_alike_for_every_split(spark, tmp_path):
    folder = stored(tmp_path, {"a.mp4": movie(30), "b.mp4": movie(7, header_first=False), "empty.mp4": movie(0), "note.txt": b"x"})
    whole = content(frames.read_frames(spark, folder))
    assert whole == [(f, k, k, picture(k).tobytes()) for f, n in (("a.mp4", 30), ("b.mp4", 7)) for k in range(n)]
    small = frames.read_frames(spark, folder, splitBytes=300)
    assert content(small) == whole and small.rdd.getNumPartitions() > 10
    some = frames.read_frames(spark, folder, stride=4, maxFrames=5, splitBytes=500)
    assert content(some) == [(f, k, k // 4, picture(k).tobytes()) for f, n in (("a.mp4", 20), ("b.mp4", 7)) for k in range(0, n, 4)]


def test_filters_prune_files_and_frames(spark, tmp_path):
    folder = stored(tmp_path, {f"{k}.mp4": movie(9) for k in range(6)})
    third = picture(3).tobytes()

    def failing_beyond_two(samples, track):  # local, so that it travels by value
        import numpy

        for s in samples:
            if s == third:
                raise RuntimeError("decoded what nobody asked for")
            yield numpy.frombuffer(s, numpy.uint8).reshape(track.height, track.width, 3)

    every = frames.read_frames(spark, folder, decoder=failing_beyond_two)
    assert every.rdd.getNumPartitions() == 6
    one = every.filter((F.col("path") == f"{folder}/3.mp4") & (F.col("frame") <= 2))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 3  # frames beyond the filter are never decoded
    assert every.filter(F.col("path").isin(f"{folder}/1.mp4", f"{folder}/2.mp4") & (F.col("nth") == 1)).count() == 2
    assert frames.read_frames(spark, folder, content=False).filter("frame = 8").count() == 6


def test_frames_that_need_earlier_ones(spark, tmp_path):
    def differences(samples, track):
        """Frames that add to the one before."""
        import numpy

        total = numpy.zeros((track.height, track.width, 3), numpy.uint8)
        for s in samples:
            total = total + numpy.frombuffer(s, numpy.uint8).reshape(total.shape)
            yield total

    sync, parts = [0, 5, 6], [picture(k) for k in range(11)]
    data = container.write_mp4([p.tobytes() for p in parts], 6, 4, 1000, 40, sync=sync)
    folder = stored(tmp_path, {"a.mp4": data})
    want = []
    for k in range(11):
        first = max(s for s in sync if s <= k)
        want.append(sum((p.astype(int) for p in parts[first : k + 1]), np.zeros((4, 6, 3), int)).astype(np.uint8).tobytes())
    for split in (200, 1 << 20):
        got = content(frames.read_frames(spark, folder, decoder=differences, splitBytes=split))
        assert [g[3] for g in got] == want
        assert [(g[1], g[3]) for g in content(frames.read_frames(spark, folder, decoder=differences, stride=4, splitBytes=split))] == [(k, want[k]) for k in (0, 4, 8)]


def test_constant_rate_and_times(spark, tmp_path):
    folder = stored(tmp_path, {"a.mp4": movie(10)})  # 25 a second
    at = lambda **o: [r.frame for r in frames.read_frames(spark, folder, **o).orderBy("nth").collect()]
    assert at(fps=25) == list(range(10))
    assert at(fps=50) == [k // 2 for k in range(20)]
    assert at(fps="25/2") == [max(n for n in range(10) if (n + 1) // 2 <= k) for k in range(5)]
    assert at(timestamps="0,20,21,100,5000") == [0, 0, 1, 2, 9]
    turned = frames.read_frames(spark, folder, rotation="ccw", maxWidth=2).first()
    assert (turned.width, turned.height, len(turned.content)) == (2, 4, 24)


def test_files_are_written_whole(spark, tmp_path):
    rows = spark.createDataFrame([("x/a.bin", b"abc"), ("b.bin", None), ("c.bin", b"")], "name string, content binary")
    written = storage.write_files(rows, str(tmp_path / "out"))
    assert {r.path.rsplit("out/", 1)[-1]: r.length for r in written.collect()} == {"x/a.bin": 3, "b.bin": 0, "c.bin": 0}
    assert [(p.rsplit("out/", 1)[-1], n) for p, n in storage.files(str(tmp_path / "out"))] == [("b.bin", 0), ("c.bin", 0), ("x/a.bin", 3)]
    assert (tmp_path / "out/x/a.bin").read_bytes() == b"abc"


def plain_linear(p, wide, high):
    out = np.zeros((high, wide, 3))
    for y in range(high):
        for x in range(wide):
            sy, sx = (y + 0.5) * p.shape[0] / high - 0.5, (x + 0.5) * p.shape[1] / wide - 0.5
            for dy in (0, 1):
                for dx in (0, 1):
                    iy, ix = int(np.floor(sy)) + dy, int(np.floor(sx)) + dx
                    w = (1 - abs(sy - iy)) * (1 - abs(sx - ix))
                    out[y, x] += w * p[min(max(iy, 0), p.shape[0] - 1), min(max(ix, 0), p.shape[1] - 1)]
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def test_resampling():
    p = picture(1, 7, 5)
    for wide, high in ((7, 5), (14, 10), (3, 2), (1, 1), (20, 3)):
        assert np.abs(pixels.resize(p, wide, high).astype(int) - plain_linear(p, wide, high)).max() <= 1
        for kind in ("linear", "cubic", "lanczos", "area"):
            assert np.allclose(pixels.resampling(7, wide, kind).sum(axis=1), 1)
    for kind in ("linear", "cubic", "lanczos", "area"):
        assert (pixels.resize(p, 7, 5, kind) == p).all()
        assert (pixels.resize(np.stack([p, p]), 9, 4, kind)[1] == pixels.resize(p, 9, 4, kind)).all()
    even = np.repeat(np.repeat(picture(2, 3, 2), 2, axis=0), 2, axis=1)
    assert (pixels.resize(even, 3, 2, "area") == picture(2, 3, 2)).all()
    assert (pixels.rotate(pixels.rotate(p, "cw"), "ccw") == p).all() and (pixels.rotate(p, "cw")[0, -1] == p[0, 0]).all()
    assert pixels.at_most_wide(p, 10) is p and pixels.at_most_wide(picture(3, 64, 36), 32).shape == (18, 32, 3)
    assert pixels.crop(p, -3, 1.5, 3.2, 99).shape == (4, 4, 3) and pixels.crop(p, 9, 9, 12, 12).shape == (1, 1, 3)
    assert pixels.crop(p, 2, 2, 4, 4, 0.5).shape == (4, 4, 3) and (pixels.crop(p, 1, 1, 3, 2) == p[1:2, 1:3]).all()
    assert pixels.at_least_high(p, 5) is p and pixels.at_least_high(p, 20).shape == (20, 28, 3) and pixels.at_least_high(p[:0], 20).size == 0
    assert (pixels.at_least_high(np.full((3, 3, 3), 77, np.uint8), 50) == 77).all()
