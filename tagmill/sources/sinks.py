"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import text
from tagmill.operators.contract import COLUMNS, select_contract


def csv_cell(value: Column) -> Column:
    """Quoted when it holds a quote, comma or line break."""
    cell = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(cell.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in df.columns]).alias("value"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Part files with a header each; a table without rows still gets its header."""
    spark = df.sparkSession
    if df.isEmpty():
        header = spark.range(1, numPartitions=1).select(F.lit(",".join(df.columns)).alias("value"))
        header.write.mode(mode).text(path)
    else:
        df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_client_csv(df: DataFrame, path: str) -> None:
    """CSV for spreadsheets: byte order mark, header and CRLF in each part file; a table without rows still gets its header."""
    spark = df.sparkSession
    head = F.lit("\ufeff" + ",".join(df.columns))
    if df.isEmpty():
        lines = spark.range(1, numPartitions=1).select(head.alias("value"))
    else:
        first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # of its task, so of its file
        lines = csv_lines(df).select(F.explode(F.when(first, F.array(head, "value")).otherwise(F.array("value"))).alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_diagnostics(df: DataFrame, order: str, cells: str, path: str) -> None:
    """Maps of cells as a table, its columns the union of keys by first appearance; no rows give no header.

    Keys are names of settings and measures: their distinct values, not the rows, reach the driver.
    """
    seen = df.select(order, F.posexplode(F.map_keys(cells)).alias("_at", "_key")).groupBy("_key").agg(F.min(F.struct(order, "_at")).alias("_first"))
    keys = [r["_key"] for r in seen.orderBy("_first").collect()]
    if keys:
        write_csv(df.select(*[F.coalesce(F.try_element_at(cells, F.lit(k)), F.lit("")).alias(k) for k in keys]), path)
    else:
        df.sparkSession.range(0).select(F.lit("").alias("value")).write.mode("overwrite").text(path)


def write_result(df: DataFrame, path: str) -> None:
    """The 29-column contract. Rows stay in part files; nothing gathers them on one machine."""
    write_csv(select_contract(df), path)


def write_detections(df: DataFrame, path: str) -> None:
    """Confidence with 6 decimals, boxes with 2."""
    box = [F.round(F.col(c), 2).alias(c) for c in ("x_min", "y_min", "x_max", "y_max")]
    write_csv(df.select("image_path", "class_id", "class_name", F.round("confidence", 6).alias("confidence"), *box), path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_result_with_meta(df: DataFrame, settings: dict[str, str], path: str) -> None:
    """Result rows as JSON lines, and beside them one line with their number and the settings of the run."""
    write_json(df, f"{path}/rows")
    meta = df.agg(F.count("*").alias("n_rows")).select("n_rows", F.struct(*[F.lit(v).alias(k) for k, v in settings.items()]).alias("settings"))
    write_json(meta, f"{path}/meta")


def dataset_rows(boxes: DataFrame, frames: DataFrame, line: Column, negative: Column, split: Column) -> DataFrame:
    """Training frames with their file stem, split and label lines.

    boxes and frames share (path, frame).  A frame without a line stays only where it is a negative one; lines are null
    where a box is too small to be labelled.
    """
    lines = boxes.select("path", "frame", line.alias("_line")).groupBy("path", "frame").agg(F.array_sort(F.collect_list("_line")).alias("lines"))
    rows = frames.join(lines, ["path", "frame"], "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
    stem = text.unique_file_name(text.parent_name(F.col("path")), F.col("frame"), F.col("path"))
    return rows.filter((F.size("lines") > 0) | negative).select("path", "frame", stem.alias("stem"), split.alias("split"), "lines")


def write_dataset(rows: DataFrame, names: list[str], path: str) -> None:
    """Rows of dataset_rows() in a folder for each split, and data.yaml, which names folders and classes."""
    rows.write.mode("overwrite").partitionBy("split").parquet(f"{path}/labels")
    yaml = [f"path: {path}", "train: labels/split=train", "val: labels/split=val", f"nc: {len(names)}", "names:", *[f"  {k}: {n}" for k, n in enumerate(names)]]
    rows.sparkSession.range(1, numPartitions=1).select(F.lit("\n".join(yaml)).alias("value")).write.mode("overwrite").text(f"{path}/data.yaml")


def write_label_files(rows: DataFrame, names: list[str], path: str) -> DataFrame:
    """Rows of dataset_rows() as files: labels/<split>/<stem>.txt, images/<split>/<stem>.jpg where they carry content, and data.yaml.

    Gives path and length of what was written.  Frames without a line have an empty label file, as trainers expect.
    """
    from tagmill.sources.scratch import dealt
    from tagmill.sources.storage import write_files

    lines = F.array_join("lines", "\n")
    labels = rows.select(F.concat(F.lit("labels/"), "split", F.lit("/"), "stem", F.lit(".txt")).alias("name"), F.when(F.size("lines") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary").alias("content"))
    labels = dealt(labels, "name")
    if "content" in rows.columns:
        pictures = rows.filter("content is not null").select(F.concat(F.lit("images/"), "split", F.lit("/"), "stem", F.lit(".jpg")).alias("name"), "content")
        labels = labels.unionByName(pictures)
    yaml = "\n".join([f"path: {path}", "train: images/train", "val: images/val", f"nc: {len(names)}", "names:", *[f"  {k}: {n}" for k, n in enumerate(names)], ""])
    settings = rows.sparkSession.range(1, numPartitions=1).select(F.lit("data.yaml").alias("name"), F.lit(yaml).cast("binary").alias("content"))
    return write_files(labels.unionByName(settings), path)


def job_folder(root: str, job: Column, kind: str = "uploads") -> Column:
    """Landing or result folder of a job."""
    return F.concat_ws("/", F.lit(root), F.lit(kind), job)


def write_queues(df: DataFrame, queues: Column, path: str) -> None:
    """Rows into all queues they belong to, in one pass."""
    df.withColumn("queue", F.explode(queues)).write.mode("overwrite").partitionBy("queue").parquet(path)


def write_split_lists(df: DataFrame, file: str, label: str, split: str, path: str) -> None:
    """file<tab>label lines, a folder for each split."""
    df.select(F.concat_ws("\t", file, label).alias("value"), F.col(split).alias("split")).write.mode("overwrite").partitionBy("split").text(path)


def crop_name(image: Column, position: Column, rotate: Column) -> Column:
    """parent_stem_index_rotation.jpg"""
    parts = F.split(image, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.concat(F.concat_ws("_", F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit("")), stem, F.lpad(position.cast("string"), 4, "0"), rotate), F.lit(".jpg"))


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What an interrupted run has still to do."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def job_table(spark: SparkSession, name: str) -> None:
    """The job event log, made once."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id STRING, filename STRING, status STRING, current_stage STRING, upload_path STRING, result_json_path STRING, result_csv_path STRING, error_message STRING, payload_json STRING, at TIMESTAMP) USING parquet")


def header() -> str:
    return ",".join(COLUMNS)
