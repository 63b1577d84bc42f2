"""Queries over tables of predictions and annotations: joins, aggregates, order, sets, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagmill.functions.geometry import Box, doubled_center_distance_squared
from tagmill.operators import matching, splits
from tagmill.plans.detections import RULES, order, rules
from tagmill.plans.proxies import DET, GT, ID, VIDEO, det, gt, read, video
from tagmill.plans.registry import query

DIST = "((a.x1 + a.x2 - b.x1 - b.x2) * (a.x1 + a.x2 - b.x1 - b.x2) + (a.y1 + a.y2 - b.y1 - b.y2) * (a.y1 + a.y2 - b.y1 - b.y2))"


def _distance(a: str, b: str):  # noqa: ANN202
    return doubled_center_distance_squared(Box.columns(f"{a}."), Box.columns(f"{b}."))


@query("WITH m AS (SELECT l_partkey AS part, arg_max(l_suppkey, (l_orderkey, l_linenumber, l_suppkey)) AS supp FROM lineitem GROUP BY l_partkey) SELECT p_partkey AS part, p_name AS name, coalesce(supp, 0) AS supp FROM part LEFT JOIN m ON part = p_partkey")
def joi_left_lastwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI01, JOI17: left join with the last row of a key."""
    m = det(spark, sf_dir).select("part", "image_id", "line", "supp")
    last = matching.last_wins(m, ["part"], [F.col("image_id"), F.col("line"), F.col("supp")])
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    return parts.join(last, "part", "left").select("part", "name", F.coalesce("supp", F.lit(0)).alias("supp"))


@query(f"WITH {DET}, {GT} SELECT image_id, line, part, supp, tag, price FROM det JOIN gt USING (image_id)")
def joi_inner_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI02, JOI15: rows with their image's annotation."""
    return det(spark, sf_dir).join(gt(spark, sf_dir).select("image_id", "tag", "price"), "image_id").select(*ID, "tag", "price")


@query(f"WITH {DET}, {RULES}, a AS (SELECT image_id, count(*) AS n FROM det GROUP BY 1), b AS (SELECT image_id, count(*) AS n FROM r GROUP BY 1) SELECT image_id, coalesce(a.n, 0) AS n_before, coalesce(b.n, 0) AS n_after, coalesce(a.n, 0) - coalesce(b.n, 0) AS lost FROM a FULL JOIN b USING (image_id)")
def joi_full_outer_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI12, AGG01, SET01: counts before and after a filter, with their difference."""
    d = det(spark, sf_dir)
    return matching.count_difference(d, rules(d), ["image_id"])


@query("SELECT count_if(c_custkey IS NOT NULL AND k IS NOT NULL)::BIGINT AS both, count_if(k IS NULL)::BIGINT AS only_left, count_if(c_custkey IS NULL)::BIGINT AS only_right FROM customer FULL JOIN (SELECT DISTINCT o_custkey + 7 AS k FROM orders) ON k = c_custkey")
def joi_anti_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI03: matches and both sides' rest, in one full outer join."""
    left = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l"))
    right = read(spark, sf_dir, "orders").select((F.col("o_custkey") + 7).alias("r")).distinct()
    both = left.join(right, F.col("l") == F.col("r"), "full_outer")
    return both.agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"))


@query(f"WITH {DET}, {GT}, e AS (SELECT b.image_id, b.tag, a.line, a.part, a.supp, {DIST} AS d FROM gt b JOIN det a ON a.image_id BETWEEN b.image_id - 2 AND b.image_id + 2), q AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d, line, part, supp) AS rn FROM e WHERE d <= 4 * 150 * 150) SELECT image_id, tag, line, part, supp, d FROM q WHERE rn = 1")
def joi_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI05, JOI06: nearest detection on the annotation's frame or two frames around it."""
    g = matching.expand(gt(spark, sf_dir), "image_id", 2, F.col("image_id") - 2, F.col("image_id") + 2).alias("g")
    d = det(spark, sf_dir).withColumnRenamed("image_id", "near").alias("d")
    edges = g.join(d, "near").withColumn("d", _distance("d", "g")).filter(F.col("d") <= 4 * 150 * 150)
    return matching.nearest(edges.select("image_id", "tag", "line", "part", "supp", "d"), ["image_id"], [F.col(c) for c in ("d", "line", "part", "supp")], ["tag", "line", "part", "supp", "d"])


_EDGES = f"edges AS (SELECT a.image_id % 500 AS g, a.image_id * 10 + a.line AS l, b.image_id AS r, min({DIST}) AS d FROM det a JOIN gt b ON a.image_id % 500 = b.image_id % 500 WHERE {DIST} <= 2000 GROUP BY 1, 2, 3)"


@query(f"WITH RECURSIVE {DET}, {GT}, {_EDGES}, o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, l, r) AS rn FROM edges), s AS (SELECT g, rn, [struct_pack(l := l, r := r, d := d)] AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.g, o.rn, CASE WHEN len(list_filter(s.kept, lambda k: k.l = o.l OR k.r = o.r)) > 0 THEN s.kept ELSE list_append(s.kept, struct_pack(l := o.l, r := o.r, d := o.d)) END FROM s JOIN o ON o.g = s.g AND o.rn = s.rn + 1), f AS (SELECT g, arg_max(kept, rn) AS kept FROM s GROUP BY g) SELECT g, k.l, k.r, k.d FROM (SELECT g, unnest(kept) AS k FROM f)")
def joi_one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI04, GEO04, GEO05: greedy one-to-one matching by distance in a group."""
    c = F.col
    side = lambda df, name, *keys: df.select((c("image_id") % 500).alias("g"), *keys, (c("x1") + c("x2")).alias(f"{name}_x"), (c("y1") + c("y2")).alias(f"{name}_y"))
    a = side(det(spark, sf_dir), "a", (c("image_id") * 10 + c("line")).alias("l"))
    b = side(gt(spark, sf_dir), "b", c("image_id").alias("r"))
    return matching.one_to_one_near(a, b, "g", "l", "r", 2000)


@query(f"WITH {DET}, {GT}, e AS (SELECT b.image_id, a.line, a.part, a.supp, a.conf - {DIST} AS score FROM gt b JOIN det a USING (image_id) WHERE {DIST} <= 90000), q AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, line, part, supp) AS rn FROM e) SELECT image_id, line, part, supp, score FROM q WHERE rn = 1")
def joi_best_per_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI07: best crop of each annotation by quality less distance; a crop may serve several."""
    edges = gt(spark, sf_dir).alias("b").join(det(spark, sf_dir).alias("a"), "image_id").withColumn("d", _distance("a", "b")).filter("d <= 90000").withColumn("score", F.col("conf") - F.col("d"))
    return matching.nearest(edges.select("image_id", "line", "part", "supp", "score"), ["image_id"], [-F.col("score"), F.col("line"), F.col("part"), F.col("supp")], ["line", "part", "supp", "score"])


@query("WITH f AS (SELECT o_orderkey AS image_id, o_orderkey % 1000 AS video, o_orderkey // 1000 AS frame FROM orders), l AS (SELECT video, max(frame) AS last FROM f GROUP BY video) SELECT image_id, video, unnest(range(greatest(frame - 2, 0), least(frame + 2, last) + 1)) AS near FROM f JOIN l USING (video)")
def joi_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI09: each annotated frame with its neighbours inside its recording."""
    frames = video(gt(spark, sf_dir)).select("image_id", "video", "frame")
    last = frames.groupBy("video").agg(F.max("frame").alias("last"))
    return matching.expand(frames.join(last, "video"), "frame", 2, F.lit(0).cast("long"), F.col("last")).select("image_id", "video", "near")


@query(f"WITH {DET}, {VIDEO}, c AS (SELECT DISTINCT video, frame FROM vid), p AS (SELECT DISTINCT video, frame FROM vid WHERE conf >= 49000) SELECT c.video, c.frame FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.video = c.video AND p.frame BETWEEN c.frame - 3 AND c.frame + 3)")
def joi_range_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI10: frames with no strong detection within three frames."""
    v = video(det(spark, sf_dir))
    return matching.away_from(v.select("video", "frame").distinct(), v.filter("conf >= 49000").select("video", "frame").distinct(), ["video"], "frame", 3)


@query("SELECT DISTINCT source FROM documents WHERE source IN (SELECT DISTINCT 'src' || (doc_id % 7)::VARCHAR FROM labels)")
def joi_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI11, SET04: sources on both sides of a split."""
    train = read(spark, sf_dir, "labels").select(F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("source")).distinct()
    return read(spark, sf_dir, "documents").select("source").distinct().join(train, "source", "left_semi")


@query("SELECT s AS engine, d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d, (SELECT unnest(['a', 'b']) AS s) LEFT JOIN labels l ON l.doc_id = d.doc_id AND (s = 'a' OR l.quality = 1)")
def joi_engine_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI14, JOI16: every row for every engine, with that engine's result or a default."""
    docs = read(spark, sf_dir, "documents").select("doc_id").withColumn("engine", F.explode(F.array(F.lit("a"), F.lit("b"))))
    labels = read(spark, sf_dir, "labels")
    results = labels.select("doc_id", "quality", F.lit("a").alias("engine")).unionByName(labels.filter("quality = 1").select("doc_id", "quality", F.lit("b").alias("engine")))
    return docs.join(results, ["doc_id", "engine"], "left").select("engine", "doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query(f"WITH {DET}, {RULES}, t AS (SELECT image_id, count(*) AS n0 FROM det GROUP BY 1), u AS (SELECT image_id, count(*) AS n1, count(DISTINCT part) AS n2 FROM r GROUP BY 1) SELECT sum(n0)::BIGINT AS n_raw, sum(coalesce(n1, 0))::BIGINT AS n_kept, sum(coalesce(n2, 0))::BIGINT AS n_final, count_if(coalesce(n1, 0) > 1)::BIGINT AS frames_over_one, max(coalesce(n1, 0)) AS most FROM t LEFT JOIN u USING (image_id)")
def agg_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG02, AGG03: what each step of a pipeline loses."""
    d = det(spark, sf_dir)
    after = rules(d).groupBy("image_id").agg(F.count("*").alias("n1"), F.count_distinct("part").alias("n2"))
    frames = d.groupBy("image_id").agg(F.count("*").alias("n0")).join(after, "image_id", "left").na.fill(0)
    return frames.agg(F.sum("n0").alias("n_raw"), F.sum("n1").alias("n_kept"), F.sum("n2").alias("n_final"), F.count_if(F.col("n1") > 1).alias("frames_over_one"), F.max("n1").alias("most"))


@query("SELECT d.lang, count(*) AS n, sum((l.quality = 1)::BIGINT)::BIGINT AS n_right, floor(1000.0 * sum((l.quality = 1)::BIGINT) / count(*) + 0.5)::BIGINT AS permille FROM documents d JOIN labels l USING (doc_id) GROUP BY d.lang")
def agg_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG05, AGG06, AGG22: share of right rows by group."""
    right = F.when(F.col("quality") == 1, 1).otherwise(0).cast("long")
    both = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id")
    out = both.groupBy("lang").agg(F.count("*").alias("n"), F.sum(right).alias("n_right"))
    return out.select("lang", "n", "n_right", F.floor(F.lit(1000.0) * F.col("n_right") / F.col("n") + 0.5).cast("long").alias("permille"))


@query("SELECT event_type AS engine, count(*) AS n, sum((json_extract_string(props, '$.k')::BIGINT % 3 = 0)::BIGINT)::BIGINT AS hits, row_number() OVER (ORDER BY sum((json_extract_string(props, '$.k')::BIGINT % 3 = 0)::BIGINT) DESC, count(*) DESC, event_type)::INTEGER AS place FROM events GROUP BY event_type")
def agg_engine_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG07, ORD04: engines by hits, then rows, then name."""
    hit = F.when(F.get_json_object("props", "$.k").cast("long") % 3 == 0, 1).otherwise(0).cast("long")
    out = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("engine")).agg(F.count("*").alias("n"), F.sum(hit).alias("hits"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hits"), F.desc("n"), "engine")))  # a row for each engine


_REASON = "CASE WHEN n_chars < 200 THEN 'empty_ocr' WHEN coalesce(quality, 0) = 0 AND coalesce(toxic, 0) = 1 THEN 'no_name' WHEN quality IS NULL THEN 'no_price' ELSE 'ok' END"


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    reason = F.when(F.col("n_chars") < 200, "empty_ocr").when((F.coalesce("quality", F.lit(0)) == 0) & (F.coalesce("toxic", F.lit(0)) == 1), "no_name").when(F.col("quality").isNull(), "no_price").otherwise("ok")
    return joined.withColumn("reason", reason)


@query(f"SELECT {_REASON} AS reason, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def agg_fail_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG08: rows by reason of failure, with the range of a measure."""
    return _reasons(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


_SWEEP = [0, 20000, 40000, 60000, 80000]


@query(f"WITH {DET}, t AS (SELECT unnest({_SWEEP}) AS threshold), n AS (SELECT t.threshold, d.image_id, count_if(d.conf >= t.threshold) AS n FROM t, det d GROUP BY 1, 2) SELECT threshold, sum(n)::BIGINT AS total, count(*) AS frames, count_if(n > 0)::BIGINT AS with_any, max(n)::BIGINT AS most, median(n)::DOUBLE AS middle FROM n GROUP BY threshold")
def agg_conf_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG09: boxes of a frame at several thresholds, empty frames too; one scan, one count a threshold, then unpivoted."""
    names = [f"t{t}" for t in _SWEEP]
    frames = det(spark, sf_dir).groupBy("image_id").agg(*[F.count_if(F.col("conf") >= t).alias(n) for t, n in zip(_SWEEP, names, strict=True)])
    long = frames.unpivot("image_id", names, "name", "n").withColumn("threshold", F.substring("name", 2, 9).cast("int"))
    return long.groupBy("threshold").agg(F.sum("n").alias("total"), F.count("*").alias("frames"), F.count_if(F.col("n") > 0).alias("with_any"), F.max("n").alias("most"), F.median("n").alias("middle"))


@query(f"WITH {DET}, {VIDEO}, f AS (SELECT video, frame, count_if(supp % 2 = 0) AS a, count_if(supp % 2 = 1) AS b FROM vid GROUP BY 1, 2) SELECT video, count(*) AS frames, sum(a)::BIGINT AS first, sum(b)::BIGINT AS second, count_if(a > b)::BIGINT AS first_more FROM f GROUP BY ROLLUP (video)")
def agg_two_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10, AGG11: two detectors by frame, then by video and over all."""
    frames = video(det(spark, sf_dir)).groupBy("video", "frame").agg(F.count_if(F.col("supp") % 2 == 0).alias("a"), F.count_if(F.col("supp") % 2 == 1).alias("b"))
    return frames.rollup("video").agg(F.count("*").alias("frames"), F.sum("a").alias("first"), F.sum("b").alias("second"), F.count_if(F.col("a") > F.col("b")).alias("first_more"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total, median(n_chars)::DOUBLE AS middle, count(DISTINCT lang) AS langs FROM documents GROUP BY source")
def agg_frame_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12, AGG19: counts, sums and medians of a measure by source."""
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.median("n_chars").alias("middle"), F.count_distinct("lang").alias("langs"))


@query(f"WITH {DET}, q AS (SELECT *, dense_rank() OVER (ORDER BY image_id) AS f, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, line, part, supp) AS rn FROM det) SELECT image_id, line, part, supp, rn::INTEGER AS place FROM q WHERE f <= 100 AND rn <= 2")
def ord_topk_first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD01, ORD02, ORD03: the two best rows of the first hundred images."""
    d = det(spark, sf_dir)
    first = d.select("image_id").distinct().orderBy("image_id").limit(100)
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(*order()))
    return d.join(F.broadcast(first), "image_id").withColumn("place", place).filter("place <= 2").select(*ID, "place")


@query(f"WITH {DET}, {VIDEO}, q AS (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY frame) - 1 AS nth FROM (SELECT DISTINCT video, frame FROM vid)) SELECT video, frame, nth FROM q WHERE nth % 4 = 0")
def ord_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD05, ORD10, SRC12: every fourth frame of a recording, keeping its own number."""
    nth = (F.row_number().over(Window.partitionBy("video").orderBy("frame")) - 1).cast("long")
    return video(det(spark, sf_dir)).select("video", "frame").distinct().withColumn("nth", nth).filter("nth % 4 = 0")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS position FROM documents")
def ord_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD06, ORD07: consecutive numbers over the whole table."""
    return splits.renumber(read(spark, sf_dir, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "position")


@query("SELECT 'a__' || c_name AS stem, c_nationkey AS label FROM customer UNION ALL SELECT 'b__' || s_name, s_nationkey FROM supplier")
def set_union_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET05 to SET07: data sets put together under tags."""
    a = read(spark, sf_dir, "customer").select(F.concat(F.lit("a__"), "c_name").alias("stem"), F.col("c_nationkey").alias("label"))
    return a.unionByName(read(spark, sf_dir, "supplier").select(F.concat(F.lit("b__"), "s_name").alias("stem"), F.col("s_nationkey").alias("label")))


@query("SELECT c_nationkey AS key FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET02: keys on both sides."""
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).intersect(read(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey * 2 FROM orders")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET03, SET08: keys on one side only."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(read(spark, sf_dir, "orders").select(F.col("o_custkey") * 2))


@query("SELECT doc_id, CASE WHEN source IN ('src0', 'src3') OR source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6') THEN 'val' ELSE 'train' END AS split FROM documents")
def smp_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP03: held sources and sources outside the training list."""
    return read(spark, sf_dir, "documents").select("doc_id", splits.holdout(F.col("source"), ["src0", "src3"], [f"src{k}" for k in range(7)]).alias("split"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'val' ELSE 'train' END AS split FROM documents")
def smp_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP04: every sixth frame."""
    return read(spark, sf_dir, "documents").select("doc_id", splits.modulo(F.col("doc_id"), 0.15).alias("split"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5('3:' || doc_id::VARCHAR), 1, 8))::BIGINT % 1000 < 150 THEN 'val' ELSE 'train' END AS split FROM documents")
def smp_bernoulli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP05: a draw for each row."""
    return read(spark, sf_dir, "documents").select("doc_id", splits.bernoulli(3, F.col("doc_id"), 150).alias("split"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('5:' || doc_id::VARCHAR), doc_id) <= greatest(1, count(*) OVER () // 10) THEN 'val' ELSE 'train' END AS split FROM documents")
def smp_shuffle_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP02, SMP06: an exact tenth of the keys by draw."""
    return splits.shuffle_split(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.1, 5)


@query(f"WITH r AS (SELECT doc_id, {_REASON} AS reason FROM documents LEFT JOIN labels USING (doc_id)), q AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY md5('9:' || doc_id::VARCHAR), doc_id) AS rn FROM r) SELECT doc_id, reason FROM q WHERE rn <= 25")
def smp_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP01: as many rows of each bucket, by draw."""
    return splits.stratified(_reasons(spark, sf_dir).select("doc_id", "reason"), "reason", "doc_id", 25, 9)


@query(f"WITH r AS (SELECT doc_id, n_chars, {_REASON} AS reason FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, unnest([x for x in ['all', CASE WHEN reason = 'empty_ocr' THEN 'empty_ocr' END, CASE WHEN n_chars < 700 THEN 'low_conf' END, CASE WHEN n_chars >= 200 AND reason <> 'ok' THEN 'unparsed' END, CASE WHEN n_chars >= 200 THEN 'any_text' END] if x IS NOT NULL]) AS queue FROM r")
def smp_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP07, SNK06: rows in all queues they belong to."""
    n, reason = F.col("n_chars"), F.col("reason")
    queues = splits.route(all=F.lit(True), empty_ocr=reason == "empty_ocr", low_conf=n < 700, unparsed=(n >= 200) & (reason != "ok"), any_text=n >= 200)
    return _reasons(spark, sf_dir).select("doc_id", F.explode(queues).alias("queue"))
