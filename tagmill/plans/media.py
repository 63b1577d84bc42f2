"""Queries over readings, boxes and frames as they come from models, and over a job's figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import barcodes, coerce, geometry, text
from tagmill.operators import evaluation, inference, matching, suppression
from tagmill.plans.detections import _NEAR, _SEED, _TAKE, _sql_first_match
from tagmill.plans.proxies import DET, FIELDS, VIDEO, det, read, video
from tagmill.plans.registry import query


@query("SELECT p_partkey AS part, CASE p_partkey % 6 WHEN 0 THEN p_name || ' ' || p_brand WHEN 1 THEN p_name WHEN 2 THEN p_brand WHEN 3 THEN p_name || ' ' || p_brand WHEN 4 THEN p_type ELSE '' END AS read FROM part")
def str_nested_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR34: the text of recognition results of five shapes, and of one that is no JSON."""
    c = F.col
    name, brand, kind = (F.to_json(F.array(c(x))) for x in ("p_name", "p_brand", "p_type"))
    shapes = [
        F.concat(F.lit('[{"rec_texts": ['), F.concat_ws(",", F.substring(name, 2, F.length(name) - 2), F.substring(brand, 2, F.length(brand) - 2)), F.lit(']}]')),
        F.concat(F.lit('[{"rec_text": '), F.substring(name, 2, F.length(name) - 2), F.lit(', "text": "no"}]')),
        F.concat(F.lit('[{"rec_res": [['), F.substring(brand, 2, F.length(brand) - 2), F.lit(', 0.5]]}]')),
        F.concat(F.lit('[[[[[0, 0], [1, 1]], ['), F.substring(name, 2, F.length(name) - 2), F.lit(", 0.9]], [[[0, 2], [1, 3]], ["), F.substring(brand, 2, F.length(brand) - 2), F.lit(", 0.8]], [1]]]")),
        F.concat(F.lit('[{"place": "x", "some_Text": '), kind, F.lit("}]")),
        F.lit("not json"),
    ]
    result = F.element_at(F.array(*shapes), (c("p_partkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(c("p_partkey").alias("part"), text.result_text(result).alias("read"))


@query("WITH v AS (SELECT p_partkey AS part, p_name AS a, p_brand AS b, p_size::VARCHAR || p_partkey::VARCHAR AS c FROM part), s AS (SELECT *, length(a) * 10 + length(regexp_replace(a, '[^0-9]', '', 'g')) * 3 AS sa, length(b) * 10 + length(regexp_replace(b, '[^0-9]', '', 'g')) * 3 AS sb, length(c) * 13 AS sc FROM v) SELECT part, CASE WHEN sa >= sb AND sa >= sc THEN a WHEN sb >= sc THEN b ELSE c END AS best FROM s")
def str_best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR36: the best of several readings of one region."""
    c = F.col
    texts = F.array("p_name", "p_brand", F.concat(c("p_size").cast("string"), c("p_partkey").cast("string")))
    return read(spark, sf_dir, "part").select(c("p_partkey").alias("part"), text.best_variant(texts).alias("best"))


@query("SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 3 = 0 THEN '[\"' || s_name || '\"]' ELSE '[\"' || s_name || '\",\"' || s_nationkey::VARCHAR || '\"]' END AS payloads, '[{\"text\":\"' || s_name || '\",\"score\":' || s_nationkey::VARCHAR || '}]' AS lines FROM supplier")
def bar_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BAR09, BAR10: payloads of several decoders as one list; lines as JSON."""
    c = F.col
    other = F.when(c("s_suppkey") % 3 == 0, F.array(F.lit("  "))).otherwise(F.array(F.lit(""), c("s_nationkey").cast("string")))
    nested = F.array(F.array(F.concat(F.lit(" "), c("s_name"))), F.lit(None).cast("array<string>"), other)
    lines = F.array(F.struct(c("s_name").alias("text"), c("s_nationkey").alias("score")))
    return read(spark, sf_dir, "supplier").select(c("s_suppkey").alias("supp"), F.to_json(barcodes.decoded_strings(nested)).alias("payloads"), text.lines_json(lines).alias("lines"))


@query("SELECT p_partkey AS part, p_partkey % 3 <> 2 AND p_partkey % 10 > 8 AS matches, p_partkey % 10 * 10 >= 75 AS sure FROM part")
def flt_pseudo_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12: readings that agree with a true text, in whole or in part, and are sure enough."""
    c, score = F.col, F.col("p_partkey") % 10 / 10
    line = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("a "), c("p_name"))).when(c("p_partkey") % 3 == 1, F.substring("p_name", 2, 3)).otherwise("~")
    near = text.pseudo_label(line, score, F.array(F.lit("#"), F.upper("p_name")))
    return read(spark, sf_dir, "part").select(c("p_partkey").alias("part"), near.alias("matches"), (score >= 0.75).alias("sure"))


@query(f"WITH {DET} SELECT image_id, line, part, supp, CASE WHEN part % 5 <> 0 AND supp % 3 > 1 THEN x2 - x1 ELSE NULL END AS width FROM det")
def flt_box_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT10, CST01: boxes from text cells; null where a cell can't be read or the box is a pixel high."""
    c = F.col
    high = F.when(c("supp") % 3 == 0, 0).when(c("supp") % 3 == 1, 1).otherwise(c("y2") - c("y1"))
    rows = det(spark, sf_dir).withColumn("y2", c("y1") + high)
    box = geometry.cells_to_box(F.when(c("part") % 5 == 0, "нет").otherwise(F.concat(c("x1").cast("string"), F.lit(",0"))), *[c(n).cast("string") for n in ("y1", "x2", "y2")])
    return rows.select("image_id", "line", "part", "supp", (box["x2"] - box["x1"]).cast("long").alias("width"))


@query("SELECT o_orderkey AS k, o_orderkey % 17 <= 8 AS guarded, true AS free FROM orders")
def flt_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13: frames that moved too little to matter, by their mean difference to a base frame."""
    k = F.col("o_orderkey")
    base = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i * 7 + k) % 200)
    near = F.transform(base, lambda v, i: v + F.when(i % 2 == 0, 1).otherwise(-1) * (k % 17))
    return read(spark, sf_dir, "orders").select(k.alias("k"), geometry.still(base, near, 8).alias("guarded"), geometry.still(base, near, 0).alias("free"))


@query(f"WITH {DET}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id, x1 ORDER BY conf DESC, line, part, supp) AS nth FROM (SELECT * FROM det)), s AS (SELECT *, row_number() OVER (PARTITION BY image_id, x1 ORDER BY line, part, supp) AS nth FROM det WHERE line % 2 = 0) SELECT s.image_id, s.x1, s.line * 100000000000 + s.part * 1000 + s.supp % 1000 AS row, o.conf AS given FROM s LEFT JOIN o ON o.image_id = s.image_id AND o.x1 = s.x1 AND o.nth = s.nth")
def joi_realign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI13: selected rows get the metadata of the best original of their identity that none has taken."""
    c = F.col
    rows = det(spark, sf_dir).withColumn("row", c("line") * 100000000000 + c("part") * 1000 + c("supp") % 1000)
    originals = rows.select("image_id", "x1", "row", "conf", c("conf").alias("given"))
    return matching.realign(rows.filter("line % 2 = 0").select("image_id", "x1", "row"), originals, ["image_id", "x1"], "row", "conf", ["given"])


@query(f"WITH RECURSIVE {DET}, {_sql_first_match('image_id', 'line, part, supp', _NEAR.replace('256', '6400'), _TAKE, _SEED, 'det')} SELECT image_id, c.best.line, c.best.part, c.best.supp, c.best.conf FROM (SELECT image_id, unnest(acc) AS c FROM f)")
def dup_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP09: seeds absorb later rows by distance alone."""
    out = suppression.in_frame(det(spark, sf_dir), ["image_id"], [F.col(c) for c in ("line", "part", "supp")], FIELDS, "conf", radius=40, numerator=None)
    return out.select("image_id", "line", "part", "supp", "conf")


@query("WITH r AS (SELECT l_orderkey AS job, count(*) AS n, count_if(l_partkey % 2 = 0)::BIGINT AS codes, (count(*) + count_if(l_partkey % 2 = 0) + count_if(l_suppkey % 3 = 0))::BIGINT AS filled FROM lineitem GROUP BY 1) SELECT o_orderkey AS job, CASE WHEN o_orderkey % 2 = 0 THEN 100 + o_orderkey WHEN o_orderkey % 3 = 0 THEN 7 ELSE 0 END AS frames_processed, CASE WHEN o_orderkey % 5 = 0 THEN 9 WHEN o_orderkey % 3 = 0 THEN 8 ELSE coalesce(n, 0) END AS price_tags_found, coalesce(codes, 0) AS qr_codes_decoded, coalesce(filled, 0) AS fields_filled FROM orders LEFT JOIN r ON job = o_orderkey")
def prj_result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ10: figures of a job from its result, else from the next source, else from its rows."""
    c, k = F.col, F.col("o_orderkey")
    struct = lambda test, value, name: F.when(test, F.struct(value.alias(name)))
    result = F.to_json(F.struct(
        F.struct(struct(k % 2 == 0, k + 100, "frames_extracted").alias("detection")).alias("pipeline"), struct(k % 3 == 0, F.lit(7), "frame_count").alias("video_metadata"),
        struct(k % 5 == 0, F.lit(9), "after_final_dedupe").alias("crop_stats"), struct(k % 3 == 0, F.lit(8), "rows_after_dedupe").alias("bundle_meta"),
    ))
    jobs = read(spark, sf_dir, "orders").select(k.alias("job"), result.alias("result"))
    rows = read(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("job"), F.when(c("l_partkey") % 2 == 0, "q").otherwise(" ").alias("qr"), F.when(c("l_suppkey") % 3 == 0, "n").alias("name"), F.lit("x").alias("file"))
    return evaluation.result_summary(jobs, rows, "job", F.col("result"), "qr", ["qr", "name", "file"])


_FRAMES = "(SELECT count(*) FROM (SELECT DISTINCT video, frame FROM vid))"


@query(f"WITH {DET}, {VIDEO} SELECT supp % 3 AS detector, {_FRAMES} AS frames, count(DISTINCT (video, frame)) AS with_any, count(*) AS total, CAST(floor(count(*)::DOUBLE * 1000 / {_FRAMES} + 0.5) AS BIGINT) AS mean, min(conf) AS least, max(conf) AS most, CAST(floor(sum(conf)::DOUBLE * 1000 / count(*) + 0.5) AS BIGINT) AS mean_confidence FROM vid GROUP BY 1")
def agg_detector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: detectors by frames, detections and confidence."""
    d = video(det(spark, sf_dir)).withColumn("detector", F.col("supp") % 3)
    return evaluation.detector_stats(d, d, "detector", ["video", "frame"], "conf")


@query("SELECT l_suppkey % 8 AS video, count(*) AS n, round(sum(l_partkey % 1000)::DOUBLE / count(*), 3) AS blur_mean, round(median((l_partkey % 1000)::DOUBLE), 3) AS blur_median, round(sum(l_orderkey % 256)::DOUBLE / count(*), 3) AS brightness_mean FROM lineitem GROUP BY 1")
def agg_frame_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: blur and brightness of a recording's frames."""
    c = F.col
    frames = read(spark, sf_dir, "lineitem").select((c("l_suppkey") % 8).alias("video"), (c("l_partkey") % 1000).alias("blur"), (c("l_orderkey") % 256).alias("brightness"))
    return evaluation.frame_summary(frames, ["video"], "blur", "brightness")


@query("SELECT l_suppkey % 8 AS video, count(*) AS n, round(sum(l_partkey % 1000)::DOUBLE / count(*), 3) AS blur_mean, quantile_disc(l_partkey % 1000, 0.5)::BIGINT AS blur_median, round(sum(l_orderkey % 256)::DOUBLE / count(*), 3) AS brightness_mean FROM lineitem GROUP BY 1")
def agg_frame_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: the same with medians from sketches, whose rank is off by a hundred-thousandth at most."""
    c = F.col
    frames = read(spark, sf_dir, "lineitem").select((c("l_suppkey") % 8).alias("video"), (c("l_partkey") % 1000).alias("blur"), (c("l_orderkey") % 256).alias("brightness"))
    return evaluation.frame_summary(frames, ["video"], "blur", "brightness", rank_error=1e-5)


@query(f"WITH {DET} SELECT count(*) AS all_rows, count_if(image_id % 10 = 7)::BIGINT AS val, count_if(x2 - x1 < 80)::BIGINT AS narrow, count_if(conf IS NULL)::BIGINT AS unread FROM det")
def agg_builder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG18: counters of a dataset builder, all in one scan."""
    c = F.col
    return evaluation.tally(det(spark, sf_dir), all_rows=F.lit(True), val=c("image_id") % 10 == 7, narrow=c("x2") - c("x1") < 80, unread=c("conf").isNull())


@query(f"WITH {DET} SELECT image_id, list_slice(list(line * 1000000 + part ORDER BY line * 1000000 + part), 1, 2)::VARCHAR AS first_two FROM det GROUP BY image_id")
def ord_first_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD11: the first two elements of each list."""
    c = F.col
    lists = det(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list(c("line") * 1000000 + c("part"))).alias("items"))
    return lists.select("image_id", F.slice("items", 1, 2).cast("string").alias("first_two"))


_CELL = "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'нет' WHEN 2 THEN ' -' WHEN 3 THEN 'nan' WHEN 4 THEN ' ' || p_size::VARCHAR || ',5 ' WHEN 5 THEN p_size::VARCHAR || '.5' ELSE p_size::VARCHAR || 'x' END"


@query("WITH p AS (SELECT p_partkey AS part, p_partkey % 7 AS k, p_size * 10 + 5 AS v FROM part) SELECT part, CASE WHEN k IN (4, 5) THEN v END AS or_null, CASE WHEN k = 5 THEN v END AS or_drop, CASE WHEN k = 5 THEN v ELSE 0 END AS or_zero, CASE WHEN k IN (4, 5) THEN v ELSE 0 END AS or_zero_comma, CASE WHEN k IN (4, 5) THEN v ELSE -10 END AS or_minus_one, CASE WHEN k IN (4, 5) THEN v::VARCHAR WHEN k = 6 THEN (v // 10)::VARCHAR ELSE '' END AS digits FROM p")
def cst_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CST01 to CST06: five policies for the same cells, in tenths, and their digits."""
    cell = F.expr(_CELL.replace("::VARCHAR", "::STRING"))
    tenths = lambda c: (c * 10).cast("long")
    policies = {"or_null": coerce.or_null(cell), "or_drop": coerce.or_drop(cell), "or_zero": coerce.or_zero(cell), "or_zero_comma": coerce.or_zero(cell, comma=True), "or_minus_one": coerce.or_minus_one(cell)}
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), *[tenths(c).alias(n) for n, c in policies.items()], coerce.digits(cell).alias("digits"))


@query("SELECT s_suppkey AS supp, CASE WHEN s_suppkey % 25 >= 13 AND s_suppkey % 25 >= s_suppkey % 20 THEN 'red' WHEN s_suppkey % 20 > 8 THEN 'yellow' ELSE '' END AS color FROM supplier")
def udf_panel_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF10: the colour of a panel from its pixels."""
    k = F.col("s_suppkey")
    n_red, n_yellow = (k % 25).cast("int"), (k % 20).cast("int")
    pixels = F.unhex(F.concat(F.repeat(F.lit("DC1414"), n_red), F.repeat(F.lit("F0D010"), n_yellow), F.repeat(F.lit("808080"), 100 - n_red - n_yellow)))
    shares = read(spark, sf_dir, "supplier").select(k.alias("supp"), inference.color_shares(pixels).alias("s"))
    return shares.select("supp", inference.panel_color(F.col("s.red"), F.col("s.yellow")).alias("color"))
