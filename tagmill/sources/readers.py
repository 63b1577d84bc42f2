"""Scans. Tables at rest are text; types are given where a column is used (see functions.coerce)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagmill.functions import text
from tagmill.functions.coerce import blank, trimmed
from tagmill.sources import storage

# Suffixes of images, of videos and of uploads.
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")
VIDEOS = ("mp4", "mov", "avi", "mkv", "webm", "m4v")
UPLOADS = ("mp4", "mov", "avi", "mkv")
DETECTIONS = ["image_path", "class_id", "class_name", "confidence", "x_min", "y_min", "x_max", "y_max"]
MANIFEST = ["source_image", "crop_path", "rotate", "x_min", "y_min", "x_max", "y_max", "class_name", "confidence"]
TRACKS = "track_id int, filename string, frame_idx int, bbox array<int>, conf double, area double, sharpness double, score double"
PARSED = "image_path string, source_image string, confidence double, smart_deskewed boolean, hybrid map<string,string>, parsed map<string,string>, baseline map<string,string>, readable boolean"


def texts(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _headers(files: DataFrame) -> DataFrame:
    """(header, paths): the first lines of text files, read by ranges, and the files that have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path in batch.column("path").to_pylist():
                source, head, open_quote = storage.Ranges(path), b"", True
                # A line may be longer than a range, and a quoted name may hold a line break.
                while open_quote and len(head) < source.size:
                    head += source(len(head), 1 << 16)
                    ends = [i for i in range(len(head)) if head[i : i + 1] in (b"\n", b"\r") and head[:i].count(b'"') % 2 == 0][:1]
                    open_quote = not ends
                    head = head[: ends[0]] if ends else head
                source.close()
                heads.append(head.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(heads, pa.string())], ["path", "header"])

    return files.select("path").mapInArrow(run, "path string, header string").groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def csv(spark: SparkSession, path: str, columns: list[str] | None = None, recursive: bool = False, crlf: bool = False) -> DataFrame:
    """CSV with a header, all cells text: quotes doubled, line breaks of any kind, short rows padded, blank lines dropped.

    Where rows end in CRLF, a CRLF inside a cell is read as LF unless `crlf` says that all rows do.  With `recursive`, the *.csv
    files of a folder and those below it, each by its own header: columns meet by name, those that a file lacks are blank.
    """
    if recursive:
        found = None
        for row in sorted(_headers(listing(spark, path, ("csv",))).collect(), key=lambda r: r["paths"][0]):  # a row for each header
            if row["header"].strip("\ufeff \r\n"):
                part = _csv(spark, row["paths"], None, crlf)
                found = part if found is None else found.unionByName(part, allowMissingColumns=True)
        if found is None:
            return spark.createDataFrame([], texts(columns or []))
        found = found.na.fill("")
        return found.select(*[(F.col(f"`{c}`") if c in found.columns else F.lit("")).alias(c) for c in columns]) if columns else found
    return _csv(spark, path, columns, crlf)


def _csv(spark: SparkSession, path: str | list[str], columns: list[str] | None, crlf: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8")
    if crlf:
        reader = reader.option("lineSep", "\r\n")
    df = reader.csv(path)  # names come from the header; without inferSchema all cells are text
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    if columns:
        df = df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])
    return df.filter(F.coalesce(*[F.col(f"`{c}`") for c in df.columns]).isNotNull()).na.fill("")


def detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections; rows without an image path are dropped."""
    return csv(spark, path, DETECTIONS).filter(~blank(F.col("image_path")))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON array a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, nested: str, nested_schema: str) -> DataFrame:
    """JSON lines whose column `nested` holds JSON as text; rows where it can't be read are dropped."""
    df = spark.read.option("primitivesAsString", True).json(path)
    read = F.from_json(F.col(nested), nested_schema, {"mode": "PERMISSIVE"})
    valid = F.get_json_object(F.col(nested), "$").isNotNull()
    return df.filter(valid).withColumn(nested, read)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Crops of a folder: its tracking manifest, or else its crop manifest, in one form."""
    if exists(spark, f"{folder}/tracking_manifest.json"):
        t = json_array(spark, f"{folder}/tracking_manifest.json", TRACKS)
        box = [F.try_element_at("bbox", F.lit(k + 1)).cast("string").alias(c) for k, c in enumerate(("x_min", "y_min", "x_max", "y_max"))]
        return t.select(F.col("filename"), F.col("filename").alias("crop_path"), F.lit("").alias("source_image"), *box, F.col("conf").cast("string").alias("confidence"), "track_id")
    if exists(spark, f"{folder}/crops_manifest.csv"):
        df = csv(spark, f"{folder}/crops_manifest.csv")
        return normalize_manifest(df)
    raise FileNotFoundError(f"{folder} has neither tracking_manifest.json nor crops_manifest.csv")


def normalize_manifest(df: DataFrame) -> DataFrame:
    """filename from filename, crop_filename or the base of crop_path, whichever is filled first."""
    have = [F.nullif(trimmed(F.col(c)), F.lit("")) for c in ("filename", "crop_filename") if c in df.columns]
    base = [F.element_at(F.split("crop_path", r"[/\\]"), -1)] if "crop_path" in df.columns else []
    return df.withColumn("filename", F.coalesce(*have, *base, F.lit("")))


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = IMAGES, content: bool = False, recursive: bool = True, first: int | None = None) -> DataFrame:
    """Files of a folder, and those below it if recursive, by suffix in any case; `first`: only so many, by suffix as listed, then path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    keep = ["path", "length", "modificationTime", *(["content"] if content else [])]
    found = files.filter(_suffix(F.col("path")).isin(*suffixes))
    if first is not None:
        found = found.orderBy(F.array_position(F.array(*[F.lit(s) for s in suffixes]), _suffix(F.col("path"))), "path").limit(first)
    return found.select(*keep)


def accepted_upload(name: Column) -> Column:
    """Suffix of a video that the service takes."""
    return _suffix(name).isin(*UPLOADS)


def split_sources(labels: DataFrame) -> DataFrame:
    """Label files (path) by split, their folder, and source, from their stem: how many each."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return labels.select(text.parent_name(F.col("path")).alias("split"), text.label_source(stem).alias("source")).groupBy("split", "source").agg(F.count("*").alias("n"))


def frames_or_video(wanted: DataFrame, extracted: DataFrame, decoded: DataFrame, key: list[str]) -> DataFrame:
    """Wanted frames with their content: the extracted file, else the frame of the recording; those found in neither go.

    Only frames without a file are looked up in the recording. Keys are expected once on each side.
    """
    had = wanted.join(extracted, key, "left")
    files = had.filter("content is not null").withColumn("origin", F.lit("file"))
    missing = had.filter("content is null").select(*key)
    return files.unionByName(missing.join(decoded, key).withColumn("origin", F.lit("video")))


def first_by_name(listings: list[DataFrame]) -> DataFrame:
    """Files of several folders, one for each name: the first folder's, then the least path."""
    every = None
    for k, df in enumerate(listings):
        one = df.select("path").withColumn("folder", F.lit(k))
        every = one if every is None else every.unionByName(one)
    named = every.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.groupBy("name").agg(F.min(F.struct("folder", "path")).alias("f")).select("name", "f.path", "f.folder")


def videos(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder, VIDEOS).dropDuplicates(["path"])


def by_priority(candidates: DataFrame, key: str, path: str, priority: str, files: DataFrame) -> DataFrame:
    """First of the ordered candidates that exists among files (path)."""
    found = candidates.join(files.select(F.col("path").alias(path)).distinct(), path, "left_semi")
    return found.groupBy(key).agg(F.min_by(path, priority).alias(path))


def rec_list(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """file<tab>label lines; lines without a tab are skipped, and files that don't exist if a listing is given."""
    lines = spark.read.text(path).filter(F.contains("value", F.lit("\t")))
    rows = lines.select(F.substring_index("value", "\t", 1).alias("file"), F.regexp_replace("value", r"^[^\t]*\t", "").alias("label"))
    if files is None:
        return rows
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("_name")).distinct()
    return rows.withColumn("_name", F.element_at(F.split("file", "/"), -1)).join(names, "_name", "left_semi").drop("_name")


def yaml_value(spark: SparkSession, path: str, key: str) -> str | None:
    """A top-level `key: value` line of a small settings file."""
    row = spark.read.text(path).select(F.regexp_extract("value", rf"^{key}:\s*(.*?)\s*$", 1).alias("v")).filter("v <> ''").first()
    return row["v"].strip("'\"") if row else None


def row_count(spark: SparkSession, path: str, missing: int | None = 0) -> int | None:
    """Rows of a CSV; `missing` where there is no such file."""
    try:
        return csv(spark, path).count() if exists(spark, path) else missing
    except AnalysisException:
        return missing


def last_row(df: DataFrame, order: str, log: str | None = None) -> DataFrame:
    """The row with the highest value: of a training log, or of each, its last epoch."""
    rows = df.groupBy(log) if log else df.groupBy()
    return rows.agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def frame_indices(files: DataFrame) -> DataFrame:
    """Numbers of extracted frames; names that are no number are skipped."""
    n = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).try_cast("long")
    return files.withColumn("frame", n).filter("frame is not null")


def nearest_frame(samples: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Each sample (key, ms), once, with the frame (key, frame, ms) nearest in time, the lower number of equals.

    Samples and frames are sorted together, and the frame before and the frame after are carried along: no pairs are
    listed.  Samples of a recording without frames are dropped.
    """
    at = frames.groupBy(key, "ms").agg(F.min("frame").alias("frame"))
    found = F.struct("ms", "frame").alias("f")
    both = at.select(key, "ms", found, F.lit(False).alias("sample")).unionByName(samples.select(key, "ms").distinct().withColumns({"f": F.lit(None).cast("struct<ms:long,frame:long>"), "sample": F.lit(True)}))
    near = []
    for order in (F.col("ms").asc(), F.col("ms").desc()):
        last = F.last("f", ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
        near.append(last)
    beside = both.select(key, "ms", "sample", near[0].alias("a"), near[1].alias("b")).filter("sample")
    cost = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.ms") - F.col("ms")).alias("d"), F.col(f"{c}.frame").alias("frame"), F.col(f"{c}.ms").alias("frame_ms")))
    return beside.select(key, "ms", F.least(cost("a"), cost("b")).alias("f")).filter("f is not null").select(key, "ms", "f.frame", "f.frame_ms")


def keep_stride(frames: DataFrame, key: str, frame: str, stride: int) -> DataFrame:
    """Frames 0, stride, 2 stride ... by their own number, which they keep; `nth` counts what is kept."""
    kept = frames.filter(F.col(frame) % stride == 0)
    return kept.withColumn("nth", (F.row_number().over(Window.partitionBy(key).orderBy(frame)) - 1).cast("long"))
