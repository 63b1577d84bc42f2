"""Queries over detections: rules, suppression, clusters, geometry, and the result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import geometry as geo
from tagmill.functions import prices
from tagmill.functions.geometry import Box
from tagmill.operators import contract, suppression
from tagmill.plans.proxies import DET, FIELDS, GT, ID, OCR, VIDEO, det, gt, ocr, read, video
from tagmill.plans.registry import query
from tagmill.sources.scratch import dealt

RANKED = "o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, line, part, supp) AS rn FROM {src})"
OVER = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
AREA = "(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1))"
BOXED = "struct_pack(x1 := {t}.x1, y1 := {t}.y1, x2 := {t}.x2, y2 := {t}.y2, conf := {t}.conf, line := {t}.line, part := {t}.part, supp := {t}.supp)"


def order() -> list[Column]:
    return [-F.col("conf"), F.col("line"), F.col("part"), F.col("supp")]


def sql_iou(a: str, b: str, num: int, den: int) -> str:
    inter = OVER.format(a=a, b=b)
    return f"({inter} > 0 AND {den} * ({inter}) >= {num} * ({AREA.format(a=a)} + {AREA.format(a=b)} - ({inter})))"


def sql_nms(src: str) -> str:
    """CTEs o and k: greedy suppression as a recursion over ranks; the last state of an image holds all it keeps."""
    clash = f"len(list_filter(s.kept, lambda k: {sql_iou('k', 'o', 1, 2)})) > 0"
    return f"""{RANKED.format(src=src)},
s AS (SELECT image_id, rn, [{BOXED.format(t="o")}] AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.image_id, o.rn, CASE WHEN {clash} THEN s.kept ELSE list_append(s.kept, {BOXED.format(t="o")}) END FROM s JOIN o ON o.image_id = s.image_id AND o.rn = s.rn + 1),
f AS (SELECT image_id, arg_max(kept, rn) AS kept FROM s GROUP BY image_id)"""


KEPT = "SELECT image_id, k.line, k.part, k.supp, k.x1, k.y1, k.x2, k.y2, k.conf FROM (SELECT image_id, unnest(kept) AS k FROM f)"
RULES = "r AS (SELECT * FROM det WHERE conf >= 20000 AND x2 - x1 > 1 AND y2 - y1 > 1 AND 5 * (x2 - x1) >= (y2 - y1) AND (x2 - x1) <= 5 * (y2 - y1) AND least(x2 - x1, y2 - y1) >= 55)"


def rules(df: DataFrame, min_conf: int = 20000, min_short: int = 55) -> DataFrame:
    box = Box.columns()
    return df.filter((F.col("conf") >= min_conf) & (box.width > 1) & (box.height > 1) & (box.width * 5 >= box.height) & (box.width <= box.height * 5) & (box.short_side >= min_short))


@query(f"WITH {DET}, {RULES} SELECT image_id, line, part, supp, x1, y1, x2, y2, conf FROM r")
def flt_detection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT01: confidence, size and aspect rules."""
    return rules(det(spark, sf_dir))


@query(f"WITH {DET} SELECT image_id, line, part, supp FROM det WHERE (x2-x1)*(y2-y1) >= 9000 AND least(x2-x1, y2-y1) >= 80")
def flt_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT02, FLT04, FLT05: area and short side."""
    box = Box.columns()
    return det(spark, sf_dir).filter((box.area >= 9000) & (box.short_side >= 80)).select(*ID)


@query(f"WITH {DET} SELECT image_id, line, part, supp FROM det WHERE (x2-x1)*(y2-y1) >= 5000 AND 100*greatest(x2-x1,y2-y1) BETWEEN 115*least(x2-x1,y2-y1) AND 520*least(x2-x1,y2-y1) AND 100*(x2-x1)*(y2-y1) <= 6*480*640 AND conf % 100 >= 18")
def flt_color_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT03: area, side ratio in either direction, share of the frame, saturation difference of the layout."""
    box = Box.columns()
    long_side, short_side = F.greatest(box.width, box.height), box.short_side
    fits = (box.area >= 5000) & (long_side * 100).between(short_side * 115, short_side * 520) & (box.area * 100 <= 6 * 480 * 640) & (F.col("conf") % 100 >= 18)
    return det(spark, sf_dir).filter(fits).select(*ID)


@query(f"WITH RECURSIVE {DET}, {sql_nms('det')} {KEPT}")
def dup_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP01, DUP02: greedy suppression in an image."""
    return suppression.nms(det(spark, sf_dir), ["image_id"], order(), FIELDS).select("image_id", *FIELDS)


@query(f"WITH RECURSIVE {DET}, a AS (SELECT * REPLACE ((x2 - x1) * (y2 - y1) AS conf) FROM det), {sql_nms('a')} SELECT image_id, k.line, k.part, k.supp, k.conf AS area FROM (SELECT image_id, unnest(kept[1:2]) AS k FROM f)")
def dup_nms_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP03: suppression by area, then the two largest."""
    by_area = det(spark, sf_dir).withColumn("conf", Box.columns().area)
    return suppression.nms(by_area, ["image_id"], order(), FIELDS, top=2).select(*ID, F.col("conf").alias("area"))


def _sql_first_match(group: str, rank: str, fits: str, update: str, new: str, src: str, names: str = "osf") -> str:
    """First matching cluster, by creation, takes a row; else a new one begins. CTEs of ranked rows (aliased o), states (s) and results."""
    ranked, states, out = names if isinstance(names, tuple) else tuple(names)
    at = f"list_position(list_transform(s.acc, lambda c: {fits}), true)"
    return f"""{ranked} AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {rank}) AS rn FROM {src}),
{states} AS (SELECT {group}, rn, [{new}] AS acc FROM {ranked} o WHERE rn = 1
  UNION ALL SELECT {", ".join("o." + g for g in group.split(", "))}, o.rn, CASE WHEN coalesce({at}, 0) = 0 THEN list_append(s.acc, {new})
    ELSE list_transform(s.acc, lambda c, i: CASE WHEN i = {at} THEN {update} ELSE c END) END
  FROM {states} s JOIN {ranked} o ON {" AND ".join(f"o.{g} = s.{g}" for g in group.split(", "))} AND o.rn = s.rn + 1),
{out} AS (SELECT {group}, arg_max(acc, rn) AS acc FROM {states} GROUP BY {group})"""


_B = "x1 := {t}.x1, y1 := {t}.y1, x2 := {t}.x2, y2 := {t}.y2, conf := {t}.conf, line := {t}.line, part := {t}.part, supp := {t}.supp"
_NEW_CLUSTER = f"struct_pack(last := o.frame, {_B.format(t='o')}, frame := o.frame)"
_JOIN_CLUSTER = f"CASE WHEN o.conf > c.conf THEN {_NEW_CLUSTER} ELSE struct_pack(last := o.frame, {_B.format(t='c')}, frame := c.frame) END"


@query(f"WITH RECURSIVE {DET}, {VIDEO}, {_sql_first_match('video', 'frame, conf DESC, line, part, supp', 'o.frame - c.last <= 4 AND ' + sql_iou('c', 'o', 1, 4), _JOIN_CLUSTER, _NEW_CLUSTER, 'vid')} SELECT video, c.frame, c.line, c.part, c.supp, c.conf FROM (SELECT video, unnest(acc) AS c FROM f)")
def dup_precluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP04: clusters over neighbouring frames of a video."""
    df = video(det(spark, sf_dir))
    out = suppression.precluster(df, ["video"], "frame", [F.col("frame"), *order()], ["frame", *FIELDS], "conf", gap=4)
    return out.select("video", "frame", "line", "part", "supp", "conf")


_SEED = "struct_pack(x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2, best := struct_pack(conf := o.conf, line := o.line, part := o.part, supp := o.supp))"
_TAKE = "struct_pack(x1 := c.x1, y1 := c.y1, x2 := c.x2, y2 := c.y2, best := CASE WHEN o.conf > c.best.conf THEN struct_pack(conf := o.conf, line := o.line, part := o.part, supp := o.supp) ELSE c.best END)"
_NEAR = "(c.x1 + c.x2 - o.x1 - o.x2) * (c.x1 + c.x2 - o.x1 - o.x2) + (c.y1 + c.y2 - o.y1 - o.y2) * (c.y1 + c.y2 - o.y1 - o.y2) <= 256"


@query(f"WITH RECURSIVE {DET}, {_sql_first_match('image_id', 'line, part, supp', sql_iou('c', 'o', 9, 20) + ' OR ' + _NEAR, _TAKE, _SEED, 'det')} SELECT image_id, c.best.line, c.best.part, c.best.supp, c.best.conf FROM (SELECT image_id, unnest(acc) AS c FROM f)")
def dup_inframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP05, DUP09: seeds absorb later rows by overlap or distance; the best row stays."""
    out = suppression.in_frame(det(spark, sf_dir), ["image_id"], [F.col(c) for c in ("line", "part", "supp")], FIELDS, "conf")
    return out.select("image_id", "line", "part", "supp", "conf")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as formatted rows of a recording: a unique row number, barcode, prices and name (each missing at times), quality."""
    c = F.col
    row = c("image_id") * 1_000_000_000 + c("line") * 100_000_000 + (c("part") * 131 + c("supp")) % 100_000_000
    types = read(spark, sf_dir, "part").select(c("p_partkey").alias("part"), c("p_type").alias("type"))
    return det(spark, sf_dir).join(types, "part").select(
        "image_id", "line", "part", "supp", "x1", "y1", "x2", "y2", (c("image_id") % 2000).alias("video"), F.floor(c("image_id") / 2000).cast("long").alias("frame"), row.alias("row"),
        F.when(c("part") % 3 == 0, F.concat(F.lit("46000000"), (c("part") % 50).cast("string"))).when(c("part") % 3 == 1, "4600").otherwise("").alias("barcode"),
        F.when(c("part") % 4 == 0, "").otherwise(F.concat((c("part") % 20).cast("string"), F.lit(",00"))).alias("price_default"),
        F.when(c("part") % 5 == 0, " ").otherwise(F.concat((c("supp") % 20).cast("string"), F.lit(",50"))).alias("price_card"),
        F.when(c("part") % 7 == 0, "").otherwise(c("type")).alias("product_name"), (c("conf") * 10_000_000_000 + row % 10_000_000_000).alias("quality"),
    )


# Types are less alike than 0.35 unless equal, so equality stands for the similarity of names.
_TAG = """tagged AS (SELECT image_id, line, part, supp, x1, y1, x2, y2, image_id % 2000 AS video, image_id // 2000 AS frame, image_id * 1000000000 + line * 100000000 + (part * 131 + supp) % 100000000 AS row,
 CASE WHEN part % 3 = 0 THEN '46000000' || (part % 50)::VARCHAR WHEN part % 3 = 1 THEN '4600' ELSE '' END AS barcode, CASE WHEN part % 4 = 0 THEN '' ELSE (part % 20)::VARCHAR || ',00' END AS price_default,
 CASE WHEN part % 5 = 0 THEN '' ELSE (supp % 20)::VARCHAR || ',50' END AS price_card, CASE WHEN part % 7 = 0 THEN '' ELSE p_type END AS product_name,
 conf * 10000000000 + (image_id * 1000000000 + line * 100000000 + (part * 131 + supp) % 100000000) % 10000000000 AS quality FROM det JOIN part ON p_partkey = part)"""


def _sql_identities(src: str, scope: str, row: str, spatial: int) -> str:
    """CTE ident: the least row of all that are reached over equal barcodes, overlaps, or near centers with equal prices."""
    apart = "((a.x1 + a.x2 - b.x1 - b.x2) * (a.x1 + a.x2 - b.x1 - b.x2) + (a.y1 + a.y2 - b.y1 - b.y2) * (a.y1 + a.y2 - b.y1 - b.y2))"
    prices_agree = "((a.price_default <> '' AND a.price_default = b.price_default) OR (a.price_card <> '' AND a.price_card = b.price_card))"
    near = f"({apart} <= {4 * spatial * spatial} AND {prices_agree} AND ((a.product_name <> '' AND a.product_name = b.product_name) OR (a.barcode = '' AND b.barcode = '')))"
    return f"""p AS (SELECT a.{row} AS u, b.{row} AS v FROM {src} a JOIN {src} b ON a.{scope} = b.{scope} AND a.{row} <> b.{row} AND ((a.barcode = b.barcode AND length(a.barcode) >= 8) OR {sql_iou('a', 'b', 9, 20)} OR {near if spatial else 'false'})),
reach AS (SELECT {row} AS u, {row} AS v FROM {src} UNION SELECT r.u, p.v FROM reach r JOIN p ON p.u = r.v),
ident AS (SELECT u AS {row}, min(v) AS identity FROM reach GROUP BY u)"""


@query(f"WITH RECURSIVE {DET}, {_TAG}, {_sql_identities('tagged', 'video', 'row', 40)} SELECT t.image_id, t.row, i.identity FROM tagged t JOIN ident i USING (row)")
def dup_identity_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP06, DUP07: transitive identity by barcode, overlap, or place and price, in a video."""
    return suppression.identities(_tagged(spark, sf_dir), ["video"], ["row"], "quality", spatial=40, keep=["image_id", "row"], named="row").drop("best")


_SEED_ROW = "struct_pack(x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2, best := struct_pack(row := o.row, quality := o.quality))"
_TAKE_ROW = "struct_pack(x1 := c.x1, y1 := c.y1, x2 := c.x2, y2 := c.y2, best := CASE WHEN o.quality > c.best.quality THEN struct_pack(row := o.row, quality := o.quality) ELSE c.best END)"


def _full_sql() -> str:
    near = "(c.x1 + c.x2 - o.x1 - o.x2) * (c.x1 + c.x2 - o.x1 - o.x2) + (c.y1 + c.y2 - o.y1 - o.y2) * (c.y1 + c.y2 - o.y1 - o.y2) <= 256"
    in_frame = _sql_first_match("video, frame", "row", f"{sql_iou('c', 'o', 9, 20)} OR {near}", _TAKE_ROW, _SEED_ROW, "tagged")
    winners = "w AS (SELECT t.* FROM tagged t JOIN (SELECT unnest(acc).best.row AS row FROM f) USING (row))"
    return f"""WITH RECURSIVE {DET}, {_TAG}, {in_frame}, {winners}, {_sql_identities('w', 'video', 'row', 40)}
SELECT video, arg_max(w.row, w.quality) AS row, max(w.quality) AS quality FROM w JOIN ident USING (row) GROUP BY video, identity"""


@query(_full_sql())
def dup_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP08, ORD09: the best row of each thing, first in its frame, then over the recording; in input order."""
    return suppression.dedupe(_tagged(spark, sf_dir), ["video"], "frame", ["row"], "quality", spatial=40, keep=["video", "row", "quality"])


@query(f"WITH {DET} SELECT part AS track, max(conf * ((x2-x1)*(y2-y1))) AS score, arg_max(image_id, (conf * ((x2-x1)*(y2-y1)), -image_id, -line, -supp)) AS image_id FROM det GROUP BY part")
def dup_best_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DUP10, GEO17: best observation of a track; the first of equals."""
    df = det(spark, sf_dir).withColumn("score", F.col("conf") * Box.columns().area).withColumnRenamed("part", "track")
    best = suppression.best_by(df.select("track", "score", "image_id", "line", "supp"), ["track"], [F.col("score"), -F.col("image_id"), -F.col("line"), -F.col("supp")])
    return best.select("track", "score", "image_id")


@query(f"WITH {DET}, {GT}, j AS (SELECT d.image_id, d.line, d.part, d.supp, {OVER.format(a='d', b='g')} AS inter, {AREA.format(a='d')} + {AREA.format(a='g')} AS areas FROM det d JOIN gt g USING (image_id)) SELECT image_id, line, part, supp, CASE WHEN inter <= 0 THEN 0.0::DOUBLE ELSE inter::DOUBLE / (areas - inter)::DOUBLE END AS iou FROM j")
def geo_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO01 to GEO03: overlap of detections with the annotated box of their image."""
    d, g = det(spark, sf_dir).alias("d"), gt(spark, sf_dir).alias("g")
    return d.join(g, "image_id").select("image_id", "line", "part", "supp", geo.iou(Box.columns("d."), Box.columns("g.")).alias("iou"))


@query(f"WITH {DET} SELECT image_id, line, part, supp, greatest(0, x1 - 7) AS x1, greatest(0, y1 - 7) AS y1, least(360, x2 + 7) AS x2, least(280, y2 + 7) AS y2 FROM det WHERE greatest(0, x1 - 7) < 359")
def geo_clip_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO07, GEO08: padded crop rectangles clipped to the image."""
    rect = geo.clip_pad(Box.columns(), F.lit(360), F.lit(280), F.lit(7))
    return det(spark, sf_dir).select(*ID, rect.alias("r")).select(*ID, "r.*")


@query(f"WITH {DET}, c AS (SELECT image_id, line, part, supp, least(x1, 384) AS a, least(y1, 256) AS b, least(x2, 384) AS c, least(y2, 256) AS d FROM det) SELECT image_id, line, part, supp, (a + c)::DOUBLE / 2 / 384 AS xc, (b + d)::DOUBLE / 2 / 256 AS yc, (c - a)::DOUBLE / 384 AS w, (d - b)::DOUBLE / 256 AS h FROM c WHERE c - a >= 2 AND d - b >= 2")
def geo_yolo_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO09: normalised boxes of a 384 x 256 image."""
    df = det(spark, sf_dir).withColumn("b", geo.yolo_box(Box.columns(), F.lit(384), F.lit(256))).filter("b is not null")
    return df.select(*ID, "b.xc", "b.yc", "b.w", "b.h")


@query("WITH p AS (SELECT p_partkey AS part, 500 + p_partkey % 700 AS w, 400 + p_partkey % 300 AS h FROM part), xs AS (SELECT DISTINCT part, x FROM (SELECT part, unnest(list_append(range(0, greatest(w - 320, 0) + 1, 240), greatest(w - 320, 0))) AS x FROM p)), ys AS (SELECT DISTINCT part, y FROM (SELECT part, unnest(list_append(range(0, greatest(h - 320, 0) + 1, 240), greatest(h - 320, 0))) AS y FROM p)) SELECT part, x, y FROM xs JOIN ys USING (part)")
def geo_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO12: tiles of 320 at a stride of 240, the last flush with the edge."""
    part = ocr(spark, sf_dir).select("part", (500 + F.col("part") % 700).alias("w"), (400 + F.col("part") % 300).alias("h"))
    return part.select("part", F.inline(geo.tiles(F.col("w"), F.col("h"), 320, 240)))


@query(f"WITH {DET}, {VIDEO} SELECT video, frame, CAST(round_even(frame / 25.0 * 1000, 0) AS BIGINT) AS ms, greatest(0, least(59, CAST(round_even(frame * 1000 / 1000.0 * 0.75, 0) AS BIGINT))) AS back FROM (SELECT DISTINCT video, frame FROM vid)")
def geo_frame_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO15: frame to milliseconds at 25 a second; milliseconds to a frame clamped to the recording."""
    frames = video(det(spark, sf_dir)).select("video", "frame").distinct()
    return frames.select("video", "frame", geo.frame_to_ms(F.col("frame"), F.lit(25)).alias("ms"), geo.ms_to_frame(F.col("frame") * 1000, F.lit(0.75), F.lit(60)).alias("back"))


@query(f"WITH {OCR} SELECT part, percent * 2 + CASE WHEN part % 3 = 0 THEN 80 ELSE 0 END + 40 + CASE WHEN part % 4 = 0 THEN 0 ELSE 40 END + 20 + CASE WHEN percent > 5 THEN 15 ELSE 0 END + CASE WHEN part % 2 = 0 THEN 5 ELSE 0 END AS quality FROM ocr")
def geo_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO18: quality of a result row, in tenths."""
    p = F.col("part")
    quality = geo.row_quality_tenths(
        F.col("percent") * 2, F.when(p % 3 == 0, "4600000000000").otherwise(""), F.lit("305,00"), F.when(p % 4 == 0, " ").otherwise("305,00"), F.col("name"),
        F.when(F.col("percent") > 5, F.lit("-10%")).otherwise(contract.ABSENT), F.when(p % 2 == 0, "red").otherwise(""), contract.ABSENT,
    )
    return ocr(spark, sf_dir).select("part", quality.alias("quality"))


def sql_row(columns: dict[str, str]) -> str:
    return ", ".join(f"{columns.get(c, repr(''))} AS {c}" for c in contract.COLUMNS)


_FLAT = {c: repr("") for c in contract.COLUMNS} | {c: repr(contract.ABSENT) for c in contract.ALWAYS_ABSENT}


def _flagship_sql() -> str:
    from tagmill.plans.labels import NAME_OF_LABEL, PARSED, PLAIN
    from tagmill.plans.proxies import EAN

    shown = lambda c: f"coalesce((CASE WHEN {c} < 500000 THEN {c} ELSE {c} END // 100)::VARCHAR || ',' || lpad(({c} % 100)::VARCHAR, 2, '0'), '')"
    scaled = lambda c: shown(f"(CASE WHEN {c} BETWEEN 1 AND 4999 THEN {c} * 100 ELSE {c} END)")
    cells = _FLAT | {
        "filename": "'video_' || video::VARCHAR || '.mp4'", "product_name": f"coalesce({NAME_OF_LABEL}, '')", "price_default": scaled("coalesce(final, card)"), "price_card": scaled("card"),
        "barcode": "CASE WHEN part % 5 = 0 THEN '' ELSE code END", "discount_amount": "coalesce('-' || pct::VARCHAR || '%', 'нет')", "color": "CASE WHEN part % 2 = 0 THEN 'red' ELSE 'yellow' END",
        "frame_timestamp": "(frame * 40)::VARCHAR", "x_min": "x1::VARCHAR", "y_min": "y1::VARCHAR", "x_max": "x2::VARCHAR", "y_max": "y2::VARCHAR",
    }
    quality = "conf * 1000000 + (80 * (barcode <> '')::BIGINT + 40 * (price_card <> '')::BIGINT + 40 * (price_default <> '')::BIGINT + 20 * (product_name <> '')::BIGINT + 15 * (discount_amount <> 'нет')::BIGINT + 5) * 1000000 + row % 1000000"
    over_frames = _sql_first_match("video", "frame, conf DESC, line, part, supp", "o.frame - c.last <= 4 AND " + sql_iou("c", "o", 1, 4), _JOIN_CLUSTER, _NEW_CLUSTER, "vn", ("co", "cs", "cf"))
    near = "(c.x1 + c.x2 - o.x1 - o.x2) * (c.x1 + c.x2 - o.x1 - o.x2) + (c.y1 + c.y2 - o.y1 - o.y2) * (c.y1 + c.y2 - o.y1 - o.y2) <= 256"
    in_frame = _sql_first_match("video, frame", "row", f"{sql_iou('c', 'o', 9, 20)} OR {near}", _TAKE_ROW, _SEED_ROW, "q", ("fo", "fs", "ff"))
    return f"""WITH RECURSIVE {DET}, {RULES}, {sql_nms('r')}, nk AS ({KEPT}), vn AS (SELECT *, image_id % 1000 AS video, image_id // 1000 AS frame FROM nk), {over_frames},
best AS (SELECT video, c.* FROM (SELECT video, unnest(acc) AS c FROM cf)), {PARSED.replace('p_name', 'p_type')}, {EAN},
j AS (SELECT best.* EXCLUDE (last), z.* EXCLUDE (part), ean.code, row_number() OVER (ORDER BY video, frame, conf DESC, line, part, supp) AS row FROM best JOIN z USING (part) JOIN ean ON ean.n = best.part),
g AS (SELECT video, frame, row, conf, x1, y1, x2, y2, {sql_row(cells)} FROM j), q AS (SELECT *, {quality} AS quality FROM g), {in_frame},
w AS (SELECT q.* FROM q JOIN (SELECT unnest(acc).best.row AS row FROM ff) USING (row)), {_sql_identities('w', 'video', 'row', 200)},
k AS (SELECT arg_max(w.row, w.quality) AS row FROM w JOIN ident USING (row) GROUP BY identity)
SELECT {', '.join(contract.COLUMNS)} FROM w JOIN k USING (row)"""


@query(_flagship_sql)
def flagship_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections to the result table: rules, suppression, clusters over frames, parsed labels, 29 columns, full dedupe."""
    from tagmill.functions.barcodes import valid_ean13
    from tagmill.plans.proxies import ean

    kept = video(suppression.nms(rules(det(spark, sf_dir)), ["image_id"], order(), FIELDS))
    best = suppression.precluster(kept, ["video"], "frame", [F.col("frame"), *order()], ["frame", *FIELDS], "conf", gap=4)
    # A label takes long to parse, so the few bytes of labels go over many tasks.
    labels = dealt(ocr(spark, sf_dir, "p_type"), "part").select("part", prices.parse_text(F.col("text")).alias("p")).select("part", "p.*")
    code = ean(F.col("part"))
    parsed = best.join(labels, "part").select(
        "video", "frame", "line", "part", "supp", "conf", "x1", "y1", "x2", "y2", (-F.col("conf")).alias("down"), "product_name", "price_default", "price_card", "discount_amount",
        F.concat(F.lit("video_"), F.col("video").cast("string"), F.lit(".mp4")).alias("filename"), F.when(valid_ean13(code), code).otherwise("").alias("barcode"),
        F.when(F.col("part") % 2 == 0, "red").otherwise("yellow").alias("color"), geo.frame_to_ms(F.col("frame"), F.lit(25)).cast("string").alias("frame_timestamp"),
        *[F.col(a).cast("string").alias(b) for a, b in zip(("x1", "y1", "x2", "y2"), ("x_min", "y_min", "x_max", "y_max"), strict=True)],
    )
    # What later steps compare are the rendered cells.
    keys = ["video", "frame", "down", "line", "part", "supp", "conf", "x1", "y1", "x2", "y2"]
    rows = contract.result_rows(parsed, keep=keys)
    tenths = geo.row_quality_tenths(F.col("conf"), *[F.col(c) for c in ("barcode", "price_card", "price_default", "product_name", "discount_amount", "color")], contract.ABSENT)
    kept_order = ["frame", "down", "line", "part", "supp"]
    found = suppression.dedupe(rows.withColumn("quality", tenths), ["video"], "frame", kept_order, "quality", spatial=200, keep=contract.COLUMNS)
    return found.select(contract.COLUMNS)
