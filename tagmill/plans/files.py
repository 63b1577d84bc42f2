"""Queries over files: each writes what a sink writes, into the session's shared folder, and reads it back by its scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions.geometry import Box, yolo_box, yolo_line
from tagmill.operators import splits
from tagmill.plans.proxies import DET, det, read
from tagmill.plans.registry import query
from tagmill.sources import readers, sinks, storage
from tagmill.sources.scratch import new_folder


@query(f"WITH {DET} SELECT 'img/' || image_id::VARCHAR || '.jpg' AS image_path, line AS class_id, 'tag, \"' || supp::VARCHAR || '\"' AS class_name, conf % 1000 AS permille, x1, y1, x2, y2 FROM det WHERE part % 10 <> 0")
def src_detections_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC01, SRC02, SNK02: detections as CSV; rows without an image path are dropped."""
    c, path = F.col, new_folder(spark)
    rows = det(spark, sf_dir).select(
        F.when(c("part") % 10 == 0, " ").otherwise(F.concat(F.lit("img/"), c("image_id").cast("string"), F.lit(".jpg"))).alias("image_path"), c("line").alias("class_id"),
        F.concat(F.lit('tag, "'), c("supp").cast("string"), F.lit('"')).alias("class_name"), (c("conf") % 1000 / 1000).alias("confidence"),
        c("x1").alias("x_min"), c("y1").alias("y_min"), c("x2").alias("x_max"), c("y2").alias("y_max"),
    )
    sinks.write_detections(rows, path)
    back = readers.detections(spark, path)
    box = [c(a).cast("double").cast("long").alias(b) for a, b in (("x_min", "x1"), ("y_min", "y1"), ("x_max", "x2"), ("y_max", "y2"))]
    return back.select("image_path", c("class_id").cast("long").alias("class_id"), "class_name", F.round(c("confidence").cast("double") * 1000).cast("long").alias("permille"), *box)


@query("SELECT c_custkey::VARCHAR AS key, c_name AS name, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END AS phone FROM customer")
def src_csv_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC04: the CSV files of a folder tree, whose headers differ in order and in columns."""
    path, c = new_folder(spark), read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("phone"))
    for k, columns in enumerate((["key", "name"], ["phone", "key", "name"], ["name", "key"])):
        sinks.write_csv(c.filter(F.col("key") % 3 == k).select(*columns), f"{path}/deep/{'x/' * k}part{k}")
    return readers.csv(spark, path, ["key", "name", "phone"], recursive=True)


@query("SELECT c_custkey AS key, c_name || CASE c_custkey % 4 WHEN 0 THEN ' \"x\"' WHEN 1 THEN ', y' WHEN 2 THEN chr(13) || chr(10) || 'z' ELSE '' END AS name FROM customer")
def snk_client_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK15: CSV with byte order mark and CRLF, quotes, commas and line breaks inside cells."""
    key, path = F.col("c_custkey"), new_folder(spark)
    tail = F.when(key % 4 == 0, ' "x"').when(key % 4 == 1, ", y").when(key % 4 == 2, "\r\nz").otherwise("")
    sinks.write_client_csv(read(spark, sf_dir, "customer").select(key.alias("key"), F.concat("c_name", tail).alias("name")), path)
    return readers.csv(spark, path, crlf=True).select(F.col("key").cast("long").alias("key"), "name")


@query("SELECT p_partkey AS part, p_name AS name, " + ", ".join(f"CASE WHEN p_partkey % 3 = {k} THEN p_size::VARCHAR ELSE '' END AS k{k}" for k in range(3)) + " FROM part")
def snk_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK05: maps with other keys in other rows, as one table under the union of keys."""
    c, path = F.col, new_folder(spark)
    key = F.concat(F.lit("k"), (c("p_partkey") % 3).cast("string"))
    cells = F.create_map(F.lit("part"), c("p_partkey").cast("string"), key, c("p_size").cast("string"), F.lit("name"), c("p_name"))
    sinks.write_diagnostics(read(spark, sf_dir, "part").select("p_partkey", cells.alias("cells")), "p_partkey", "cells", path)
    return readers.csv(spark, path).select(c("part").cast("long").alias("part"), "name", "k0", "k1", "k2")


@query("SELECT o_orderkey AS id, o_custkey AS tag FROM orders WHERE o_orderkey % 7 <> 0")
def src_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC06: JSON lines that hold JSON as text; lines where it can't be read are dropped."""
    c, path = F.col, new_folder(spark)
    inner = F.when(c("o_orderkey") % 7 == 0, "no json").otherwise(F.to_json(F.struct(c("o_custkey").alias("tag"))))
    sinks.write_json(read(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), inner.alias("output")), path)
    return readers.json_lines(spark, path, "output", "tag long").select(c("id").cast("long").alias("id"), "output.tag")


@query("SELECT 'crop_' || p_partkey::VARCHAR || '.jpg' AS filename, p_size::VARCHAR AS confidence FROM part")
def src_crop_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC07: a folder's crop manifest, named by the base of the crop's path."""
    path = new_folder(spark)
    crop = F.concat(F.lit("a\\b/crop_"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    sinks.write_csv(read(spark, sf_dir, "part").select(crop.alias("crop_path"), F.col("p_size").alias("confidence")), f"{path}/crops_manifest.csv")
    return readers.manifest(spark, path).select("filename", "confidence")


@query("SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'val' ELSE 'train' END AS split, 'crops/' || s_suppkey::VARCHAR || '.jpg' AS file, s_name AS label FROM supplier")
def snk_split_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC22, SNK06, SNK10: recognition lists, a folder for each split."""
    path, key = new_folder(spark), F.col("s_suppkey")
    rows = read(spark, sf_dir, "supplier").select(F.concat(F.lit("crops/"), key.cast("string"), F.lit(".jpg")).alias("file"), F.col("s_name").alias("label"), F.when(key % 4 == 0, "val").otherwise("train").alias("split"))
    sinks.write_split_lists(rows, "file", "label", "split", path)
    lists = [readers.rec_list(spark, f"{path}/split={s}").select(F.lit(s).alias("split"), "file", "label") for s in ("train", "val")]
    return lists[0].unionByName(lists[1])


@query("WITH q AS (SELECT doc_id, unnest(list_filter([CASE WHEN n_chars < 700 THEN 'short' END, CASE WHEN doc_id % 3 = 0 THEN 'third' END, 'all'], lambda x: x IS NOT NULL)) AS queue FROM documents) SELECT queue, count(*) AS n, sum(doc_id)::BIGINT AS total FROM q GROUP BY queue")
def snk_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK06: one pass writes rows into every queue they belong to."""
    path = new_folder(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    sinks.write_queues(docs, splits.route(short=F.col("n_chars") < 700, third=F.col("doc_id") % 3 == 0, all=F.lit(True)), path)
    return spark.read.parquet(path).groupBy("queue").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))


@query("SELECT doc_id FROM documents WHERE doc_id % 5 NOT IN (1, 3)")
def snk_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK16, SNK17: two runs append what they did; what is left to do."""
    path, docs = new_folder(spark), read(spark, sf_dir, "documents").select("doc_id")
    for rest in (1, 3):
        sinks.append(docs.filter(F.col("doc_id") % 5 == rest), path)
    return sinks.not_done(docs, spark.read.parquet(path), "doc_id")


@query("SELECT count(*) AS n_rows, 'v1' AS model, '0.25' AS confidence, (SELECT count(*) FROM supplier WHERE s_acctbal > 0) AS read_back FROM supplier WHERE s_acctbal > 0")
def snk_result_with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK03: result rows as JSON, and a line with their number and the run's settings."""
    path = new_folder(spark)
    sinks.write_result_with_meta(read(spark, sf_dir, "supplier").filter("s_acctbal > 0").select("s_suppkey", "s_name"), {"model": "v1", "confidence": "0.25"}, path)
    meta = spark.read.schema("n_rows long, settings struct<model:string,confidence:string>").json(f"{path}/meta")
    return meta.select("n_rows", "settings.*", F.lit(spark.read.json(f"{path}/rows").count()).alias("read_back"))


_KEPT = "image_id % 3 = 0 OR n > 0"
_STEM = "'v' || (image_id % 10)::VARCHAR || '_' || lpad((image_id // 10)::VARCHAR, 6, '0') || '_' || substr(sha1('/d/v' || (image_id % 10)::VARCHAR || '/x.mp4:' || (image_id // 10)::VARCHAR), 1, 10)"


@query(f"WITH {DET}, b AS (SELECT image_id, count(*) FILTER (WHERE part % 4 = 0) AS n FROM det GROUP BY image_id), f AS (SELECT o_orderkey AS image_id, coalesce(n, 0) AS n FROM orders LEFT JOIN b ON image_id = o_orderkey) SELECT {_STEM} AS stem, CASE WHEN image_id % 10 = 7 THEN 'val' ELSE 'train' END AS split, n AS n_lines FROM f WHERE {_KEPT}")
def snk_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK09, AGG18, GEO09: training frames with label lines by split; boxes under two pixels give no line, frames without one stay if negative."""
    c, path = F.col, new_folder(spark)
    place = [F.concat(F.lit("/d/v"), (c("image_id") % 10).cast("string"), F.lit("/x.mp4")).alias("path"), F.floor(c("image_id") / 10).cast("long").alias("frame")]
    frames = read(spark, sf_dir, "orders").select(c("o_orderkey").alias("image_id")).select("image_id", *place)
    # Boxes of three parts in four are a pixel wide.
    boxes = det(spark, sf_dir).withColumn("x2", F.when(c("part") % 4 == 0, c("x2")).otherwise(c("x1") + 1)).select(*place, "x1", "y1", "x2", "y2")
    line = yolo_line(F.lit(0), yolo_box(Box.columns(), F.lit(640), F.lit(640)))
    line = F.when(yolo_box(Box.columns(), F.lit(640), F.lit(640)).isNotNull(), line)
    rows = sinks.dataset_rows(boxes, frames, line, c("image_id") % 3 == 0, F.when(c("image_id") % 10 == 7, "val").otherwise("train"))
    sinks.write_dataset(rows, ["price_tag"], path)
    folders = [readers.yaml_value(spark, f"{path}/data.yaml", s) for s in ("train", "val")]
    back = [spark.read.parquet(f"{path}/{f}").select("stem", F.lit(s).alias("split"), F.size("lines").cast("long").alias("n_lines")) for f, s in zip(folders, ("train", "val"), strict=True)]
    return back[0].unionByName(back[1])


@query("WITH w AS (SELECT o_orderkey % 100 AS video, o_orderkey // 100 AS frame, o_orderkey AS k FROM orders) SELECT video, frame, CASE WHEN k % 2 = 0 THEN 'f' || k::VARCHAR ELSE 'v' || k::VARCHAR END AS content, CASE WHEN k % 2 = 0 THEN 'file' ELSE 'video' END AS origin FROM w WHERE k % 2 = 0 OR k % 3 = 0")
def src_frames_or_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC18: extracted frames, and the missing ones from their recording."""
    k = F.col("o_orderkey")
    keys = read(spark, sf_dir, "orders").select(k, (k % 100).alias("video"), F.floor(k / 100).cast("long").alias("frame"))
    content = lambda mark: F.concat(F.lit(mark), k.cast("string")).alias("content")
    extracted, decoded = (keys.filter(k % n == 0).select("video", "frame", content(mark)) for n, mark in ((2, "f"), (3, "v")))
    return readers.frames_or_video(keys.select("video", "frame"), extracted, decoded, ["video", "frame"])


@query("SELECT CASE WHEN doc_id % 4 = 0 THEN 'val' ELSE 'train' END AS split, '25_' || (doc_id % 12)::VARCHAR || '-' || (doc_id % 3)::VARCHAR AS source, count(*) AS n FROM documents GROUP BY ALL")
def src_label_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC20, AGG19, STR31: label files by split and source."""
    d = F.col("doc_id")
    split = F.when(d % 4 == 0, "val").otherwise("train")
    stem = F.concat(F.lit("tag__materials_data_25_"), (d % 12).cast("string"), F.lit("-"), (d % 3).cast("string"), F.lit("_"), F.lpad(d.cast("string"), 6, "0"), F.lit("_0f3a.txt"))
    return readers.split_sources(read(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("data/labels"), split, stem).alias("path")))


@query("SELECT c_custkey AS key, c_custkey % 5 < 3 AS accepted, CASE WHEN c_custkey % 5 < 3 THEN 'data/uploads/' || c_custkey::VARCHAR END AS folder FROM customer")
def flt_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT14, SRC29, SNK20: uploads by suffix, and the folder where one lands."""
    key = F.col("c_custkey")
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".MP4", ".mov", ".x.avi", ".txt", "mp4")]), (key % 5 + 1).cast("int"))
    ok = readers.accepted_upload(F.concat("c_name", suffix))
    return read(spark, sf_dir, "customer").select(key.alias("key"), ok.alias("accepted"), F.when(ok, sinks.job_folder("data", key.cast("string"))).alias("folder"))


@query("SELECT CASE WHEN c_custkey % 10 = 7 THEN 'val' ELSE 'train' END AS split, count(*) AS files, sum(n)::BIGINT AS n_lines, count_if(n = 0)::BIGINT AS negatives FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) GROUP BY 1")
def snk_label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK09: label text files by split, one a frame, those of negative frames empty."""
    c, path = F.col, new_folder(spark)
    place = lambda key: [F.lit("/d/v/x.mp4").alias("path"), key.alias("frame")]
    frames = read(spark, sf_dir, "customer").select(*place(c("c_custkey")))
    x, y = c("o_orderkey") % 300, c("o_orderkey") % 200
    boxes = read(spark, sf_dir, "orders").select(*place(c("o_custkey")), x.alias("x1"), y.alias("y1"), (x + 60).alias("x2"), (y + 50).alias("y2"))
    rows = sinks.dataset_rows(boxes, frames, yolo_line(F.lit(0), yolo_box(Box.columns(), F.lit(640), F.lit(640))), F.lit(True), F.when(c("frame") % 10 == 7, "val").otherwise("train"))
    written = sinks.write_label_files(rows, ["price_tag"], path)
    # Read by name inside tasks: Spark's own scans skip empty files, and list a folder at the driver.
    back = storage.read_files(written.filter(c("path").endswith(".txt"))).select(F.regexp_extract("path", "labels/([a-z]+)/", 1).alias("split"), "length", F.decode("content", "UTF-8").alias("value"))
    n_lines = F.sum(F.size(F.array_remove(F.split("value", "\n"), "")).cast("long"))
    return back.groupBy("split").agg(F.count("*").alias("files"), n_lines.alias("n_lines"), F.count_if(c("length") == 0).alias("negatives"))
