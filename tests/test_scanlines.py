"""Codes drawn and read again."""

import random

import numpy as np

from tagmill.operators import scanlines


def ean(twelve):
    return twelve + str(-sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(twelve)) % 10)


def line(code, unit=2, quiet=9, dark=20, light=230):
    bars = np.repeat(np.tile([dark, light], 30)[:59], np.array(scanlines.modules(code)) * unit)
    return np.concatenate([np.full(quiet, light), bars, np.full(quiet, light)]).astype(np.uint8)


def test_a_code_has_95_modules_and_is_read_from_either_end():
    r = random.Random(1)
    for _ in range(150):
        code = ean("".join(r.choice("0123456789") for _ in range(12)))
        assert sum(scanlines.modules(code)) == 95 and len(scanlines.modules(code)) == 59
        for unit in (1, 2, 3):
            for quiet in (0, 7):
                x = line(code, unit, quiet)
                assert scanlines.codes_of_line(x) == {code} == scanlines.codes_of_line(x[::-1])
        wrong = code[:12] + str((int(code[12]) + 1) % 10)
        assert scanlines.codes_of_line(line(wrong)) == set()
    assert scanlines.codes_of_line(np.zeros(0, np.uint8)) == scanlines.codes_of_line(np.full(500, 9, np.uint8)) == set()


def test_blurred_and_uneven_lines():
    r, read = random.Random(2), 0
    for _ in range(60):
        code = ean("".join(r.choice("0123456789") for _ in range(12)))
        x = np.convolve(line(code, 4, 20).astype(float), np.ones(3) / 3, "same") + np.random.default_rng(r.randrange(99)).normal(0, 6, 95 * 4 + 40)
        got = scanlines.codes_of_line(np.clip(x, 0, 255).astype(np.uint8))
        assert got <= {code}
        read += got == {code}
    assert read >= 55


def test_votes_over_pictures(spark):
    r = random.Random(3)
    a, b = (ean("".join(r.choice("0123456789") for _ in range(12))) for _ in range(2))
    grey = np.vstack([np.tile(line(a), (5, 1)), np.tile(line(b), (3, 1)), np.full((2, len(line(a))), 230, np.uint8)])
    rows = []
    for name, picture in (("up", grey), ("turned", np.rot90(grey)), ("back", grey[:, ::-1]), ("none", np.full((9, 300), 200, np.uint8))):
        rgb = np.ascontiguousarray(np.repeat(picture[:, :, None], 3, axis=2))
        rows.append((name, rgb.shape[1], rgb.shape[0], rgb.tobytes()))
    rows += [("null", 5, 5, None), ("short", 500, 500, b"abc"), ("zero", 0, 0, b"")]
    images = spark.createDataFrame(rows, "path string, width int, height int, content binary")
    assert {r.path: (r.code, r.votes) for r in scanlines.barcodes(images).collect()} == {k: (a, 5) for k in ("up", "turned", "back")}
    tied = spark.createDataFrame([("t", len(line(a)), 2, np.ascontiguousarray(np.repeat(np.vstack([line(a), line(b)])[:, :, None], 3, axis=2)).tobytes())], images.schema)
    assert scanlines.barcodes(tied).first().code == min(a, b)
    assert scanlines.barcodes(images.limit(0)).count() == 0


def test_equal_lines_of_a_picture_are_read_once(spark, monkeypatch):
    a = ean("460000000791")
    picture = np.ascontiguousarray(np.repeat(np.tile(line(a), (12, 1))[:, :, None], 3, axis=2))
    images = spark.createDataFrame([("p", picture.shape[1], picture.shape[0], picture.tobytes())], "path string, width int, height int, content binary")
    assert [(r.path, r.n) for r in scanlines.scan_lines(images).collect()] == [("p", 12)]
    assert [(r.code, r.votes) for r in scanlines.barcodes(images).collect()] == [(a, 12)]


def test_pictures_of_one_small_file_are_drawn_by_many_tasks(spark, sf_dir):
    from tagmill.plans import colors

    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert parts.rdd.getNumPartitions() < 4 <= colors.dealt(parts, "p_partkey").rdd.getNumPartitions()
    assert colors.udf_barcode_pixels(spark, sf_dir)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1
