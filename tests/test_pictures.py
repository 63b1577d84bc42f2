"""Masks, colours and one-file CSV against plain versions."""

import csv

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagmill.functions import masks
from tagmill.operators import colors, evaluation
from tagmill.sources import onefile


def flood(mask, diagonal=True):
    """Components by flood fill: lists of pixels, by their first in raster order."""
    seen, out = set(), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if (y, x) in seen:
            continue
        stack, part = [(y, x)], []
        seen.add((y, x))
        while stack:
            a, b = stack.pop()
            part.append((a, b))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    n = (a + dy, b + dx)
                    if (diagonal or not dy * dx) and 0 <= n[0] < mask.shape[0] and 0 <= n[1] < mask.shape[1] and mask[n] and n not in seen:
                        seen.add(n)
                        stack.append(n)
        out.append(part)
    return out


def drawn_masks():
    g = np.random.default_rng(4)
    yield from (g.random((int(g.integers(1, 14)), int(g.integers(1, 14)))) < p for p in (0.1, 0.3, 0.5, 0.6, 0.8) for _ in range(40))
    yield np.zeros((3, 4), bool)
    yield np.ones((3, 4), bool)


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_are_those_of_a_flood_fill(diagonal):
    for mask in drawn_masks():
        want = []
        for part in flood(mask, diagonal):
            ys, xs = zip(*part, strict=True)
            want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
        assert [tuple(c) for c in masks.components(mask, diagonal).tolist()] == want


def test_holes_and_morphology():
    for mask in drawn_masks():
        around = np.ones((mask.shape[0] + 2, mask.shape[1] + 2), bool)
        around[1:-1, 1:-1] = ~mask
        outside = np.zeros_like(around)
        for y, x in next(p for p in flood(around, False) if (0, 0) in p):
            outside[y, x] = True
        assert (masks.filled(mask) == ~outside[1:-1, 1:-1]).all()
        high, wide = mask.shape
        near = lambda y, x, r, m=mask: m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
        for r in (1, 2):
            assert (masks.dilate(mask, r) == [[near(y, x, r).any() for x in range(wide)] for y in range(high)]).all()
            assert (masks.erode(mask, r) == [[near(y, x, r).all() for x in range(wide)] for y in range(high)]).all()


def test_outline_areas():
    mask = np.zeros((20, 30), bool)
    mask[2:10, 3:15] = True
    mask[4:6, 5:8] = False  # a hole counts as inside
    mask[12:13, 20:29] = True  # a line has no area
    mask[5, 6] = True  # an island in a hole is no outline
    assert masks.outlines(mask)[0].tolist() == [3, 2, 12, 8, 77]


def image(paint, wide=160, high=120):
    p = np.full((high, wide, 3), 60, np.uint8)
    for x, y, w, h, c in paint:
        p[y : y + h, x : x + w] = c
    return p


RED, WHITE = (220, 30, 20), (235, 235, 235)
SMALL = colors.Settings(kernel=5, min_area=600, min_short=20, least_ratio=1.0, most_share=0.5)


def test_tags_need_colour_light_and_layout(spark):
    tag = [(38, 20, 64, 32, WHITE), (40, 52, 60, 28, RED)]
    pictures = {"good": image(tag), "dark": image(tag[1:]), "speck": image([(40, 52, 6, 6, RED)]), "upside": image([(40, 20, 60, 28, RED), (38, 48, 64, 32, WHITE)]), "blank": image([])}
    rows = [(k, p.shape[1], p.shape[0], p.tobytes()) for k, p in pictures.items()] + [("null", 160, 120, None), ("short", 160, 120, b"abc"), ("size", None, 120, b"abc"), ("none", 0, 0, b"")]
    images = spark.createDataFrame(rows, "path string, width int, height int, content binary")
    found = {r.path: (r.x1, r.y1, r.x2, r.y2) for r in colors.detect_tags(images, SMALL).collect()}
    assert found == {"good": (32, 18, 107, 82)}
    assert {r.path: r.panel is not None for r in colors.panels(images).collect()} == {k: k in ("good", "dark", "upside") for k, *_ in rows}
    panel = next(r.panel for r in colors.panels(images).collect() if r.path == "good")
    assert (panel.x1, panel.y1, panel.x2, panel.y2) == (40 / 160, 52 / 120, 100 / 160, 80 / 120)
    assert colors.detect_tags(images.limit(0)).count() == 0


def test_overlapping_tags_leave_the_largest(spark):
    p = image([(20, 10, 60, 30, WHITE), (20, 42, 60, 30, RED), (96, 30, 50, 20, WHITE), (96, 52, 50, 24, RED)])
    images = spark.createDataFrame([("a", 160, 120, p.tobytes())], "path string, width int, height int, content binary")
    boxes = [(r.x1, r.y1, r.x2, r.y2) for r in colors.detect_tags(images, SMALL).collect()]
    every = colors.candidates(p, SMALL)
    assert set(boxes) <= set(every) and len(boxes) == 2


def read_back(path):
    with open(path, newline="", encoding="utf-8") as f:
        return list(csv.reader(f))


def test_one_file_with_one_header(spark, tmp_path):
    path = str(tmp_path / "x/rows.csv")
    df = spark.range(40, numPartitions=5).selectExpr("id", "concat('a \"', id, ',\n') AS name", "1 AS other")
    onefile.write_csv(df, path, ["id", "name", "gone"])
    want = [[str(k), f'a "{k},\n', ""] for k in range(40)]
    assert read_back(path) == [["id", "name", "gone"], *want]
    onefile.write_csv(df.limit(1), path, ["id", "name", "gone"], append=True)
    onefile.write_csv(df.limit(0), path, ["id", "name", "gone"], append=True)
    assert read_back(path) == [["id", "name", "gone"], *want, want[0]]
    onefile.write_csv(df.limit(2), path)
    assert len(read_back(path)) == 3 and [p.name for p in (tmp_path / "x").iterdir()] == ["rows.csv"]


def test_header_of_no_rows(spark, tmp_path):
    none = spark.range(0).selectExpr("id", "id AS `a,b`")
    onefile.write_csv(none, str(tmp_path / "a.csv"))
    onefile.write_csv(none, str(tmp_path / "b.csv"), header_when_empty=False)
    assert (tmp_path / "a.csv").read_bytes() == b'id,"a,b"\r\n' and (tmp_path / "b.csv").read_bytes() == b""
    onefile.write_csv(spark.range(1), str(tmp_path / "b.csv"), append=True)  # an empty file is new
    assert (tmp_path / "b.csv").read_bytes() == b"id\r\n0\r\n"


def test_a_failed_job_leaves_the_file_as_it_was(spark, tmp_path):
    path = str(tmp_path / "rows.csv")
    onefile.write_csv(spark.range(3), path)
    before = (tmp_path / "rows.csv").read_bytes()
    bad = spark.range(100, numPartitions=4).selectExpr("CASE WHEN id = 99 THEN raise_error('no') ELSE id END AS id")
    for append in (True, False):
        with pytest.raises(Exception, match="no"):
            onefile.write_csv(bad, path, append=append)
    assert (tmp_path / "rows.csv").read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["rows.csv"]


def test_counters_come_from_the_writing_job(spark, tmp_path):
    sc = spark.sparkContext
    sc.setJobGroup("counted", "one write")
    seen = evaluation.counted(spark.range(1000, numPartitions=3), lambda df: df.write.parquet(str(tmp_path / "out")), written=F.lit(True), even=F.col("id") % 2 == 0)
    assert seen == {"written": 1000, "even": 500} and len(sc.statusTracker().getJobIdsForGroup("counted")) == 1
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_crops_of_odd_pictures_and_boxes(spark):
    p = np.random.default_rng(1).integers(0, 256, (10, 12, 3), dtype=np.uint8)
    rows = [("a", 12, 10, p.tobytes()), ("null", 12, 10, None), ("short", 99, 99, b"abc"), ("unboxed", 12, 10, p.tobytes())]
    images = spark.createDataFrame(rows, "path string, width int, height int, content binary")
    boxes = [("a", "x", 1.0, 2.0, 5.0, 6.0), ("a", "x", 1.0, 2.0, 5.0, 6.0), ("a", "out", 50.0, 50.0, 60.0, 60.0), ("null", "n", 0.0, 0.0, 5.0, 5.0), ("short", "s", 0.0, 0.0, 5.0, 5.0), ("gone", "g", 0.0, 0.0, 1.0, 1.0)]
    table = spark.createDataFrame(boxes, "path string, box string, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r.path, r.box, r.width, r.height, bytes(r.content)) for r in colors.crops(images, table).collect())
    assert got == sorted([("a", "out", 1, 1, p[9:, 11:].tobytes()), *[("a", "x", 4, 4, p[2:6, 1:5].tobytes())] * 2])
    assert colors.crops(images, table.limit(0)).count() == 0


def test_pictures_and_boxes_meet_without_a_broadcast(spark):
    """Pictures made in tasks look small to the planner; broadcast, all of them would pass through the driver."""
    images = spark.range(3).mapInArrow(lambda batches: batches, "id long").selectExpr("string(id) AS path", "1 AS width", "1 AS height", "unhex('636261') AS content")
    boxes = spark.range(6).selectExpr("string(id % 3) AS path", "id AS box", "0D AS x1", "0D AS y1", "1D AS x2", "1D AS y2")
    cut = colors.crops(images, boxes)
    assert "Broadcast" not in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["path"], r["box"], bytes(r["content"])) for r in cut.collect()) == [(str(k % 3), k, b"cba") for k in (0, 3, 1, 4, 2, 5)]


def test_the_crops_query_broadcasts_no_picture(spark, sf_dir):
    from tagmill.plans.colors import udf_crops

    assert "Broadcast" not in udf_crops(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_hues_and_saturations_are_those_of_the_formula():
    from tagmill.operators.inference import _hsv

    rgb = np.random.default_rng(5).integers(0, 256, (4000, 3), np.uint8) // np.array([1, 1, 16], np.uint8) * np.array([1, 1, 16], np.uint8)
    h, s, v = _hsv(rgb)
    for (r, g, b), hue, saturation, value in zip(rgb.tolist(), h.tolist(), s.tolist(), v.tolist(), strict=True):
        span = max(r, g, b) - min(r, g, b)
        want = 0.0 if not span else 30 * ((g - b) / span if r == max(r, g, b) else 2 + (b - r) / span if g == max(r, g, b) else 4 + (r - g) / span)
        assert (hue, saturation, value) == (round(want % 180) % 180, round(255 * span / max(r, g, b, 1)), max(r, g, b))


def test_pictures_drawn_from_a_small_table_and_their_panels_come_in_many_tasks_and_few_batches(spark, sf_dir):
    from tagmill.plans import colors as plans

    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    drawn = plans._drawn(customers, "c_custkey", lambda k: [])
    assert customers.rdd.getNumPartitions() < 4 <= drawn.rdd.getNumPartitions()
    sizes = [b.num_rows for b in colors._batched(((str(k), bytes(5)) for k in range(7)), pa.schema([("path", pa.string()), ("content", pa.binary())]), 4, 12)]
    assert sizes == [3, 3, 1]


def test_tags_and_labels_of_one_small_file_are_drawn_by_many_tasks(spark, sf_dir):
    from tagmill.plans import colors as plans

    for made in (plans.udf_color_tags, plans.udf_deskew):
        assert "REPARTITION_BY_NUM" in made(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
