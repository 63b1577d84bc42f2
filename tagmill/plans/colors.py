"""Queries over pictures that are drawn from the tables: tags and panels by their colours, and one-file CSV sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.operators import colors, evaluation, rows, scanlines
from tagmill.plans.proxies import DET, EAN, det, ean, read
from tagmill.plans.registry import query
from tagmill.sources import onefile, readers
from tagmill.sources.scratch import dealt, new_folder

WIDE, HIGH = 160, 120
_SETTINGS = colors.Settings(kernel=5, min_area=600, min_short=20, least_ratio=1.0, most_share=0.5)


def _drawn(df: DataFrame, key: str, boxes) -> DataFrame:  # noqa: ANN001
    """A dark picture for each row, with boxes(key) of (x, y, width, height, colour) painted over it in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 64):
                out = []
                for k in keys[at : at + 64]:
                    picture = np.full((HIGH, WIDE, 3), 60, np.uint8)
                    for x, y, w, h, colour in boxes(k):
                        picture[y : y + h, x : x + w] = colour
                    out.append(picture.tobytes())
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([str(k) for k in keys[at : at + 64]]), pa.array([WIDE] * n, pa.int32()), pa.array([HIGH] * n, pa.int32()), pa.array(out, pa.binary())], ["path", "width", "height", "content"])

    return dealt(df.select(key), key).mapInArrow(run, "path string, width int, height int, content binary")


# Blobs grow by two pixels on each side; the strip above a tag is as high as the tag; a margin of 8 % goes on each side.
_TAGS = """t AS (SELECT s_suppkey AS k, 20 + s_suppkey % 10 AS x, 50 + s_suppkey % 7 AS y, 60 + s_suppkey % 13 AS w, 26 + s_suppkey % 5 AS h FROM supplier),
b AS (SELECT k, x - 2 AS x, y - 2 AS y, w + 4 AS w, h + 4 AS h FROM t WHERE k % 4 <> 0)"""


@query(f"WITH {_TAGS} SELECT k, CAST(floor(x - w * 0.08) AS BIGINT) AS x1, y - h AS y1, CAST(floor(x + w + w * 0.08) AS BIGINT) AS x2, y + h AS y2 FROM b")
def udf_color_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF02, UDF20: tags by colour with the bright strip beside them; every fourth picture's tag has none, and specks are no tags."""

    def boxes(k: int) -> list[tuple]:
        x, y, w, h = 20 + k % 10, 50 + k % 7, 60 + k % 13, 26 + k % 5
        strip = [(x - 2, y - h - 10, w + 4, h + 8, (235, 235, 235))] if k % 4 else []
        return [*strip, (x, y, w, h, (220, 30, 20)), (140, 5 + k % 9, 6, 6, (220, 30, 20))]

    found = colors.detect_tags(_drawn(read(spark, sf_dir, "supplier"), "s_suppkey", boxes), _SETTINGS)
    return found.select(F.col("path").cast("long").alias("k"), "x1", "y1", "x2", "y2")


@query(f"WITH p AS (SELECT c_custkey AS k, 10 + c_custkey % 20 AS x, 30 + c_custkey % 11 AS y, 20 + c_custkey % 60 AS w, 15 + c_custkey % 40 AS h FROM customer), q AS (SELECT k, x::DOUBLE / {WIDE} AS x, y::DOUBLE / {HIGH} AS y, w::DOUBLE / {WIDE} AS w, h::DOUBLE / {HIGH} AS h, w * h >= 0.04 * {WIDE * HIGH} AS found FROM p) SELECT k, CASE WHEN found THEN round(greatest(0.0, x + 0.03 * w), 6) ELSE 0.28 END AS x1, CASE WHEN found THEN round(least(0.98, x + 0.42 * w), 6) ELSE 0.9 END AS x2, found FROM q")
def udf_red_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF10, GEO10, GEO11: the red panel of a picture, if it is large enough, and the card price's region from it."""

    def boxes(k: int) -> list[tuple]:
        red = (200, 20, 30)
        return [(10 + k % 20, 30 + k % 11, 20 + k % 60, 15 + k % 40, red), (100, 2, 4, 20, red), (2, 100, 12, 10, red)]

    found = colors.panels(_drawn(read(spark, sf_dir, "customer"), "c_custkey", boxes))
    card = F.filter(rows.regions(F.col("panel")), lambda r: r["field"] == "price_card")[0]
    at = found.select(F.col("path").cast("long").alias("k"), card.alias("r"), F.col("panel").isNotNull().alias("found"))
    return at.select("k", F.round("r.x1", 6).alias("x1"), F.round("r.x2", 6).alias("x2"), "found")


@query("SELECT c_custkey AS k, c_name || CASE WHEN c_custkey % 3 = 0 THEN ' \"a, b\"' ELSE '' END AS name, '' AS none, 1 AS headers FROM customer")
def snk_one_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK01, SNK17, SNK21: one file in three appends, its header once, extra columns left out and missing ones blank."""
    path = f"{new_folder(spark)}/rows.csv"
    c = read(spark, sf_dir, "customer")
    name = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, ' "a, b"').otherwise(""))
    every = c.select(F.col("c_custkey").alias("k"), name.alias("name"), F.lit("extra").alias("other"))
    for part in range(3):
        onefile.write_csv(every.filter(F.col("k") % 3 == part), path, ["k", "name", "none"], append=True)
    headers = spark.read.text(path).filter(F.trim(F.col("value")) == "k,name,none").count()
    back = readers.csv(spark, path, crlf=True)
    return back.select(F.col("k").cast("long").alias("k"), "name", "none", F.lit(headers).cast("int").alias("headers"))


@query(f"WITH {DET} SELECT count(*) AS written, count_if(image_id % 10 = 7)::BIGINT AS val, count_if(x2 - x1 < 80)::BIGINT AS narrow FROM det")
def agg_observed_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: counters of a dataset as it is written, by the writing job itself."""
    c = F.col
    counts = evaluation.counted(det(spark, sf_dir), lambda df: df.write.parquet(new_folder(spark)), written=F.lit(True), val=c("image_id") % 10 == 7, narrow=c("x2") - c("x1") < 80)
    return spark.createDataFrame([counts], "written long, val long, narrow long")


@query(f"WITH {EAN} SELECT n AS part, code FROM ean WHERE n % 5 <> 0")
def udf_barcode_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF09: EAN-13 read from pixels: drawn upright, reversed or on its side, with stains; a wrong check digit is no code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, codes = (batch.column(c).to_pylist() for c in ("part", "code"))
            for at in range(0, len(keys), 64):
                out = []
                for k, code in zip(keys[at : at + 64], codes[at : at + 64], strict=True):
                    line = np.concatenate([np.full(14, 230), np.repeat(np.tile([20, 230], 30)[:59], np.array(scanlines.modules(code)) * 2), np.full(14, 230)]).astype(np.uint8)
                    picture = np.repeat(np.tile(line, (12, 1))[:, :, None], 3, axis=2)
                    picture[k % 12 : k % 12 + 3, 40:60] = 20  # a stain over a few lines
                    picture = np.rot90(picture, k % 4)
                    out.append((str(k), picture.shape[1], picture.shape[0], np.ascontiguousarray(picture).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["path", "width", "height", "content"])

    part = F.col("p_partkey")
    drawn = read(spark, sf_dir, "part").select(part.alias("part"), ean(part).alias("code"))
    drawn = dealt(drawn, "part").mapInArrow(run, "path string, width int, height int, content binary")
    return scanlines.barcodes(drawn).select(F.col("path").cast("long").alias("part"), "code")


@query("SELECT s_suppkey AS k, true AS ok, CASE WHEN s_suppkey % 3 = 0 THEN 159 ELSE 99 + s_suppkey % 17 END AS width, CASE WHEN s_suppkey % 3 = 0 THEN 119 ELSE 69 + s_suppkey % 13 END AS height FROM supplier")
def udf_deskew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF07: bright labels cut out along their outlines; where the label is too small the picture itself is what stands out from the margin."""

    def boxes(k: int) -> list[tuple]:
        small = k % 3 == 0
        return [(20, 15, 12 if small else 100 + k % 17, 9 if small else 70 + k % 13, (240, 240, 230))]

    found = colors.straightened(_drawn(read(spark, sf_dir, "supplier"), "s_suppkey", boxes))
    return found.select(F.col("path").cast("long").alias("k"), "ok", "width", "height")


@query(f"""WITH b AS (SELECT s_suppkey AS k, unnest(range(3)) AS box FROM supplier), c AS (SELECT k, box, 10 + 40 * box AS x, 20 + k % 9 AS y, 20 + k % 11 AS w, 30 + k % 13 AS h FROM b)
SELECT k, box, h + 6 AS width, least({WIDE}, x + w + 2) - (x - 2) AS height, (50 + 60 * box)::BIGINT AS red FROM c""")
def udf_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF06: three boxes of each picture, with a margin, turned to the right."""

    def boxes(k: int) -> list[tuple]:
        return [(8 + 40 * b, 10, 40, 80, (50 + 60 * b, 9, 9)) for b in range(3)]

    k = F.col("s_suppkey")
    suppliers = read(spark, sf_dir, "supplier")
    cut = suppliers.select(k.cast("string").alias("path"), k.alias("k"), F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")).alias("box"))
    x, y, w, h = 10 + 40 * F.col("box"), 20 + F.col("k") % 9, 20 + F.col("k") % 11, 30 + F.col("k") % 13
    cut = cut.select("path", "box", *[v.cast("double").alias(n) for n, v in (("x1", x - 2), ("y1", y - 3), ("x2", x + w + 2), ("y2", y + h + 3))])
    found = colors.crops(_drawn(suppliers, "s_suppkey", boxes), cut, turn="cw")
    middle = F.conv(F.hex(F.substring(F.col("content"), 1, 1)), 16, 10).cast("long")
    return found.select(F.col("path").cast("long").alias("k"), "box", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), middle.alias("red"))


@query("SELECT s_suppkey AS k, CASE WHEN 20 + s_suppkey % 30 >= 32 THEN 20 + s_suppkey % 30 ELSE 32 END AS height, CASE WHEN 20 + s_suppkey % 30 >= 32 THEN 64 ELSE CAST(round_even(64 * (32::DOUBLE / (20 + s_suppkey % 30)), 0) AS BIGINT) END AS width FROM supplier")
def udf_upscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF05: crops scaled up to a least side, larger ones as they are."""
    k = F.col("s_suppkey")
    suppliers = read(spark, sf_dir, "supplier")
    box = suppliers.select(k.cast("string").alias("path"), k.alias("box"), F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"), F.lit(74.0).alias("x2"), (30 + k % 30).cast("double").alias("y2"))
    found = colors.crops(_drawn(suppliers, "s_suppkey", lambda k: [(0, 0, WIDE, HIGH, (99, 98, 97))]), box, least_side=32)
    return found.filter(F.col("content") == F.expr("unhex(repeat('636261', width * height))")).select(F.col("box").alias("k"), F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"))
