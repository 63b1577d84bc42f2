"""Queries over the boundary to models, with small functions of bytes as models, and over listings and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import barcodes, geometry, text
from tagmill.operators import contract, inference, rows
from tagmill.plans.proxies import DET, EAN, det, ean, read, video
from tagmill.plans.registry import query
from tagmill.sources import readers
from tagmill.streaming import jobs


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images: the path is the part's number, the bytes its name."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_name").cast("binary").alias("content"))


def _detector():  # noqa: ANN202
    """A box for each word, as wide as the word."""
    return lambda image: [(k, word, 0.5, float(k), 0.0, float(k + len(word)), 10.0) for k, word in enumerate(image.decode().split())]


@query("WITH w AS (SELECT p_partkey::VARCHAR AS image_path, unnest(string_split(p_name, ' ')) AS class_name, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS k FROM part) SELECT image_path, k::INTEGER AS class_id, class_name, (k + length(class_name))::BIGINT AS x_max FROM w")
def udf_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF01, UDF17: any number of boxes for each image, from a model that a worker loads once."""
    return inference.detect(_images(spark, sf_dir), _detector).select("image_path", "class_id", "class_name", F.col("x_max").cast("long").alias("x_max"))


def _long_only():  # noqa: ANN202
    def read_line(image: bytes) -> list[tuple[str, float]]:
        if len(image) < 9:
            raise ValueError("short")
        return [(image.decode().upper(), 0.9)]

    return read_line


def _any():  # noqa: ANN202
    return lambda image: [(image.decode(), 0.5), ("?", 0.1)]


_fallback = inference.with_fallback(_long_only, _any)


@query("SELECT p_partkey::VARCHAR AS image_path, engine, CASE WHEN length(p_name) >= 9 AND engine <> 'any' THEN upper(p_name) WHEN engine = 'long' THEN '' ELSE p_name || ' | ?' END AS full_text, CASE WHEN length(p_name) < 9 AND engine = 'long' THEN 'ValueError: short' END AS error FROM part, (VALUES ('long'), ('any'), ('either')) AS e(engine)")
def udf_recognize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF04, UDF18, SRC31, STM08: engines on each image, an engine's failure as a value, and a second engine behind the first."""
    read_by = inference.recognize(_images(spark, sf_dir), {"long": _long_only, "any": _any, "either": _fallback})
    return read_by.select("image_path", "engine", "full_text", "error")


def _upscale():  # noqa: ANN202
    def double(image: bytes) -> bytes:
        if len(image) % 2:
            raise ValueError("odd")
        return image * 2

    return double


def _codes():  # noqa: ANN202
    def decode(image: bytes) -> list[str]:
        if image.startswith(b"s"):
            raise ValueError("no code")
        return image.decode().split()

    return decode


@query("SELECT p_partkey::VARCHAR AS path, CASE WHEN length(p_name) % 2 = 0 THEN p_name || p_name ELSE p_name END AS content, length(p_name) % 2 = 0 AS ok, CASE WHEN p_name LIKE 's%' THEN '' ELSE array_to_string(string_split(p_name, ' '), '+') END AS codes FROM part")
def udf_transform_and_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF08, UDF09: an image through a function that may fail, which keeps the image; payloads, none where decoding fails."""
    content = F.col("content")
    out = _images(spark, sf_dir).select("path", inference.transform(content, _upscale).alias("t"), inference.decode_codes(content, _codes).alias("codes"))
    return out.select("path", F.col("t.content").cast("string").alias("content"), "t.ok", F.array_join("codes", "+").alias("codes"))


def _counter():  # noqa: ANN202
    """A new track for each detection of the first frame, and for each that is one more than any before."""
    most = 0

    def step(payload: int) -> list[tuple[int, str]]:
        nonlocal most
        most = max(most, payload)
        return [(k, str(most)) for k in range(payload)]

    return step


@query(f"WITH {DET}, f AS (SELECT image_id % 50 AS video, image_id // 50 AS frame, count(*) AS n FROM det GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY video ORDER BY frame) AS most FROM f) SELECT video, frame, unnest(range(n)) AS track_id, most::VARCHAR AS detection FROM m")
def udf_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF03: a tracker with state, frame after frame of each recording."""
    key = [(F.col("image_id") % 50).alias("video"), F.floor(F.col("image_id") / 50).cast("long").alias("frame")]
    frames = det(spark, sf_dir).groupBy(*key).agg(F.count("*").alias("n"))
    return inference.track(frames, "video", "frame", "n", _counter)


@query("SELECT p_partkey AS part, (10 + p_size % 7)::DOUBLE AS brightness_mean, (p_size % 7)::DOUBLE AS contrast_std, (p_size % 7 = 0)::BOOLEAN AS flat FROM part")
def udf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF12: sharpness, brightness and contrast of images of six by four pixels, light and dark columns by turns."""
    pair = F.concat(F.lit("0A"), F.lpad(F.hex(10 + F.col("p_size") % 7 * 2), 2, "0"))
    q = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), inference.quality(F.unhex(F.repeat(pair, 12)), F.lit(6), F.lit(4)).alias("q"))
    return q.select("part", "q.brightness_mean", "q.contrast_std", (F.col("q.blur_score") == 0).alias("flat"))


@query("WITH l AS (SELECT p_partkey % 3 AS folder, 'd' || (p_partkey % 3)::VARCHAR || '/' || p_name || (p_partkey % 40)::VARCHAR || '.jpg' AS path, p_name || (p_partkey % 40)::VARCHAR || '.jpg' AS name FROM part) SELECT name, folder::INTEGER AS folder, path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY folder, path) AS rn FROM l) WHERE rn = 1")
def src_first_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC10: files of several folders, one for each name, of the first folder that has it."""
    part = read(spark, sf_dir, "part")
    path = F.concat(F.lit("d"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), "p_name", (F.col("p_partkey") % 40).cast("string"), F.lit(".jpg"))
    return readers.first_by_name([part.filter(F.col("p_partkey") % 3 == k).select(path.alias("path")) for k in range(3)]).select("name", "folder", "path")


@query("SELECT o_orderkey AS cell, CASE WHEN o_orderkey % 2 = 0 THEN 'a/' WHEN o_orderkey % 3 = 0 THEN 'b/' ELSE 'c/' END || o_orderkey::VARCHAR AS path FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def src_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19, SRC33: the first of ordered candidates that exists."""
    k = F.col("o_orderkey")
    named = lambda d: F.concat(F.lit(d + "/"), k.cast("string"))
    orders = read(spark, sf_dir, "orders")
    tried = orders.select(k.alias("cell"), F.posexplode(F.array(*[named(d) for d in "abc"])).alias("priority", "path"))
    files = orders.select(F.explode(F.array_compact(F.array(*[F.when(k % n == 0, named(d)) for d, n in zip("abc", (2, 3, 5), strict=True)]))).alias("path"))
    return readers.by_priority(tried, "cell", "path", "priority", files)


@query("SELECT c_nationkey AS log, max(c_custkey) AS epoch, arg_max(c_name, c_custkey) AS loss FROM customer GROUP BY 1")
def src_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC25: the last row of each training log."""
    log = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("log"), F.col("c_custkey").alias("epoch"), F.col("c_name").alias("loss"))
    return readers.last_row(log, "epoch", "log")


@query(f"WITH {DET} SELECT image_id, line, part, supp, x1 + supp AS x1, y1 + line AS y1, x2 + supp AS x2, y2 + line AS y2, image_id * 100 + part % 100 AS number, CASE WHEN supp % 3 = 0 THEN 0.0 ELSE part::DOUBLE / (supp % 3) END AS rate, [x1, x2, x2, x1]::VARCHAR AS xs, [y1, y1, y2, y2]::VARCHAR AS ys FROM det")
def geo_shift_and_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO13, GEO16, GEO20, GEO21: a tile's boxes in the frame, rates, numbers of names, corners in order."""
    c = F.col
    point = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    order = rows.corners(F.array(point("x2", "y2"), point("x1", "y2"), point("x1", "y1"), point("x2", "y1")))
    number = geometry.frame_number(F.concat(F.lit("f"), c("image_id").cast("string"), F.lit("_"), F.lpad((c("part") % 100).cast("string"), 2, "0"), F.lit("x")))
    rate = geometry.fraction(F.concat_ws("/", c("part").cast("string"), (c("supp") % 3).cast("string")))
    place = [F.transform(order, lambda p: p[n]).cast("string").alias(f"{n}s") for n in ("x", "y")]
    return det(spark, sf_dir).select("image_id", c("line"), "part", "supp", *rows.shift_tile(("x1", "y1", "x2", "y2"), "supp", "line"), number.alias("number"), rate.alias("rate"), *place)


@query(f"WITH {EAN} SELECT n, CASE WHEN n % 4 = 0 THEN false ELSE n % 3 <> 0 END AS held FROM ean")
def str_barcode_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR26: a barcode of eight digits or more inside the digits of a text."""
    n = F.col("p_partkey")
    rows_ = read(spark, sf_dir, "part").select(n.alias("n"), ean(n).alias("code"))
    code = F.when(F.col("n") % 4 == 0, F.substring("code", 1, 7)).otherwise(F.col("code"))
    said = F.when(F.col("n") % 3 == 0, "1 2 3").otherwise(F.concat(F.lit("no 5: "), F.substring("code", 1, 6), F.lit("-"), F.substring("code", 7, 9)))
    return rows_.select("n", barcodes.barcode_in_text(code, said).alias("held"))


@query("SELECT p_partkey AS part, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' | ' || p_brand ELSE p_brand || ' | ' || p_name END AS line FROM part")
def str_pipe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR33: recognised lines by place, x first; lines without a place or text are left out."""
    line = lambda t, x, y: F.struct(t.alias("text"), x.alias("cx"), y.alias("cy"))
    k, none = F.col("p_partkey"), F.lit(None).cast("long")
    lines = F.array(line(F.col("p_name"), k % 2, F.lit(0).cast("long")), line(F.col("p_brand"), F.lit(0).cast("long") + (1 - k % 2), F.lit(9).cast("long")), line(F.col("p_type"), none, k), line(F.lit(" "), k, k))
    return read(spark, sf_dir, "part").select(k.alias("part"), text.pipe_text(lines).alias("line"))


@query("SELECT s_suppkey AS supp, s_name AS product_name, '' AS barcode, 29::BIGINT AS n_columns FROM supplier")
def prj_select_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ06, PRJ11: the contract's columns from rows that have few of them, and other ones."""
    given = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("frame_timestamp"), F.col("s_name").alias("product_name"), F.lit(None).cast("string").alias("barcode"), F.lit("x").alias("other"))
    out = contract.select_contract(given)
    exact, missing, extra = contract.header_check(out.columns)
    n = len(out.columns) if exact and not missing and not extra else -1
    return out.select(F.col("frame_timestamp").cast("long").alias("supp"), "product_name", "barcode", F.lit(n).cast("long").alias("n_columns"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 4 = 3 THEN 'completed' ELSE 'queued' END AS status, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 5 = 0 THEN 'detect' ELSE 'classify' END WHEN 1 THEN CASE WHEN event_id % 5 = 0 THEN 'classify' ELSE 'ocr' END WHEN 2 THEN CASE WHEN event_id % 5 = 0 THEN 'ocr' ELSE 'finalize' END ELSE 'finalize' END AS current_stage FROM events")
def stm_handled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM03, SNK13: the state that a handler leaves: failed where it is, or queued for the stage after it."""
    e = F.col("event_id")
    stage = F.element_at(F.array(*[F.lit(s) for s in jobs.STAGES]), (e % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", jobs.handled(stage, e % 5 == 0).alias("h")).select("event_id", "h.*")


@query(f"WITH {DET}, f AS (SELECT DISTINCT image_id % 1000 AS video, image_id // 1000 AS frame FROM det), s AS (SELECT DISTINCT video, frame * 40 + 25 AS ms FROM f WHERE frame % 3 = 0), j AS (SELECT s.video, s.ms, f.frame, row_number() OVER (PARTITION BY s.video, s.ms ORDER BY abs(f.frame * 40 - s.ms), f.frame) AS rn FROM s JOIN f USING (video)) SELECT video, ms, frame FROM j WHERE rn = 1")
def src_nearest_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC16: the frame nearest in time to each sample of its recording."""
    frames = video(det(spark, sf_dir)).select("video", "frame").distinct().withColumn("ms", F.col("frame") * 40)
    samples = frames.filter("frame % 3 = 0").select("video", (F.col("ms") + 25).alias("ms"))
    return readers.nearest_frame(samples, frames, "video").select("video", "ms", "frame")


@query("SELECT s_suppkey AS supp, stage FROM supplier, (VALUES ('filled'), ('doubled')) AS t(stage) WHERE s_acctbal > 0")
def stm_run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM04, STM10: stages one after the other in one batch run."""
    start = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supp"), "s_acctbal")
    stages = [("filter", lambda d: d.filter("s_acctbal > 0").select("supp")), ("double", lambda d: d.select("supp", F.explode(F.array(F.lit("filled"), F.lit("doubled"))).alias("stage")))]
    return jobs.run_stages(start, stages, [f"{sf_dir}/supplier.parquet"])
