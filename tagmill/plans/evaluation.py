"""Queries that evaluate: accuracy against ground truth, engines, failures, losses, and samples of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import prices, text
from tagmill.operators import evaluation, splits, suppression
from tagmill.plans.detections import _JOIN_CLUSTER, _NEW_CLUSTER, RULES, _sql_first_match, order, rules, sql_iou
from tagmill.plans.labels import NAME_OF_LABEL, PARSED
from tagmill.plans.proxies import DET, FIELDS, VIDEO, det, ocr, read, video
from tagmill.plans.registry import query


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed labels beside the truth they were printed from; the truth names every fourth label otherwise and shifts some values."""
    c = F.col
    parsed = ocr(spark, sf_dir, "p_type").select("part", "default_cents", "card_cents", "percent", c("name").alias("type"), prices.parse_text(c("text")).alias("p"))
    return parsed.select(
        "part", (c("part") % 3).alias("engine"), "p.product_name", "p.price_default", "p.price_card", "p.discount_amount", F.when(c("part") % 5 == 0, "").otherwise((c("part") + 46000000).cast("string")).alias("barcode"),
        prices.comma(c("default_cents") + F.when(c("part") % 7 == 0, 5000).otherwise(0)).alias("gt_price_default"), prices.comma(c("card_cents")).alias("gt_price_card"),
        F.concat(F.lit("-"), (c("percent") + c("part") % 4).cast("string"), F.lit("%")).alias("gt_discount_amount"),
        F.when(c("part") % 11 == 0, "нет").otherwise((c("part") - c("part") % 2 + 46000000).cast("string")).alias("gt_barcode"),
        F.when(c("part") % 4 == 0, "zzz").otherwise(F.lower(c("type"))).alias("gt_product_name"),
    )


# Types have no letter of zzz, so a name's similarity is 1 or 0; a price also matches as one of its readings.
_READS = "[x for x in [{v}, CASE WHEN {v} < 5000 THEN {v} * 100 END, CASE WHEN {v} < 5000 THEN {v} * 100 + 99 - ({v} * 100) % 100 END, CASE WHEN {v} > 5000 THEN ({v} + 50) // 100 END] if x IS NOT NULL]"
_SAME = "(CASE WHEN {a} IS NULL THEN false ELSE len(list_filter(" + _READS.format(v="{a}") + ", lambda x: len(list_filter(" + _READS.format(v="{b}") + ", lambda y: abs(x - y) <= 200)) > 0)) > 0 END)"
_PAIRS = f"""{PARSED.replace('p_name', 'p_type')}, e AS (SELECT part, part % 3 AS engine, coalesce(final, card) AS a, default_cents + CASE WHEN part % 7 = 0 THEN 5000 ELSE 0 END AS ga, card AS b, card_cents AS gb,
 pct AS d, percent + part % 4 AS gd, part % 5 <> 0 AND part % 11 <> 0 AND part % 2 = 0 AS barcode_ok, CASE WHEN part % 4 <> 0 AND lower({NAME_OF_LABEL}) = lower(name) THEN 1.0 ELSE 0.0 END AS sim FROM z),
t AS (SELECT *, {_SAME.format(a='a', b='ga')} AS default_ok, {_SAME.format(a='b', b='gb')} AS card_ok, d IS NOT NULL AND abs(d - gd) <= 2 AS discount_ok FROM e)"""
_P = "CAST(floor(avg({c}::BIGINT)::DOUBLE * 1000 + 0.5) AS BIGINT)"


@query(f"WITH {_PAIRS} SELECT engine, count(*) AS n, {_P.format(c='default_ok')} AS default_ok, {_P.format(c='card_ok')} AS card_ok, {_P.format(c='discount_ok')} AS discount_ok, {_P.format(c='barcode_ok')} AS barcode_ok, count_if(sim > 0.6)::BIGINT AS names_alike, CAST(floor(avg(sim)::DOUBLE * 1000 + 0.5) AS BIGINT) AS mean_similarity FROM t GROUP BY engine")
def agg_parsed_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG05, AGG06, AGG22: parsed labels against the truth, by field."""
    return evaluation.accuracy(_pairs(spark, sf_dir), ["engine"])


@query(f"WITH {_PAIRS}, s AS (SELECT engine, count(*) AS n, count_if(barcode_ok)::BIGINT AS hits, CAST(floor(avg(sim)::DOUBLE * 1000 + 0.5) AS BIGINT) AS mean_similarity FROM t GROUP BY engine) SELECT *, row_number() OVER (ORDER BY hits DESC, mean_similarity DESC, engine)::INTEGER AS place FROM s")
def agg_engine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG07, ORD04: engines by barcode hits and mean similarity of names."""
    return evaluation.engine_scores(evaluation.compared(_pairs(spark, sf_dir)))


@query("WITH d AS (SELECT p_partkey AS part, CASE WHEN p_partkey % 4 = 0 THEN '12' WHEN p_partkey % 4 = 1 THEN '9' ELSE p_name END AS name, CASE WHEN p_partkey % 6 = 0 THEN '3.05' ELSE '' END AS card, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'x' END AS raw, (p_partkey % 100) / 100.0::DOUBLE AS confidence FROM part), b AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'empty_ocr' WHEN length(name) < 3 AND card = '' THEN 'no_name_and_no_price' WHEN length(name) < 3 THEN 'no_name' ELSE 'no_price' END AS reason FROM d WHERE trim(raw) = '' OR (length(name) < 3 AND card = '')) SELECT reason, count(*) AS n, CAST(floor(min(confidence) * 10000 + 0.5) AS BIGINT) AS least, CAST(floor(max(confidence) * 10000 + 0.5) AS BIGINT) AS most, CAST(floor(avg(confidence) * 10000 + 0.5) AS BIGINT) AS mean FROM b GROUP BY reason")
def agg_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG08, FLT06, FLT07: why labels are unreadable, with their confidence."""
    p = F.col("p_partkey")
    rows = read(spark, sf_dir, "part").select(
        F.when(p % 4 == 0, "12").when(p % 4 == 1, "9").otherwise(F.col("p_name")).alias("product_name"), F.lit("").alias("price_default"), F.when(p % 6 == 0, "3.05").otherwise("").alias("price_card"),
        F.when(p % 5 == 0, " ").otherwise("x").alias("raw_text"), ((p % 100) / 100.0).alias("confidence"),
    )
    return evaluation.fail_summary(rows, "confidence")


_OVER_FRAMES = _sql_first_match("video", "frame, conf DESC, line, part, supp", "o.frame - c.last <= 4 AND " + sql_iou("c", "o", 1, 4), _JOIN_CLUSTER, _NEW_CLUSTER, "rv")


@query(f"WITH RECURSIVE {DET}, {VIDEO}, {RULES}, rv AS (SELECT *, image_id % 1000 AS video, image_id // 1000 AS frame FROM r), {_OVER_FRAMES}, c AS (SELECT video, unnest(acc).frame AS frame FROM f), n AS (SELECT 'raw' AS step, count(*) AS n FROM vid GROUP BY video, frame UNION ALL SELECT 'filtered', count(*) FROM rv GROUP BY video, frame UNION ALL SELECT 'clustered', count(*) FROM c GROUP BY video, frame) SELECT step, sum(n)::BIGINT AS n_rows, count(*) AS frames, CAST(floor(sum(n)::DOUBLE * 1000 / count(*) + 0.5) AS BIGINT) AS mean, count_if(n > 1)::BIGINT AS over_one, max(n) AS most FROM n GROUP BY step")
def agg_loss_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG02, AGG03: rows by frame, as detected, after the rules, after clusters over frames."""
    raw = video(det(spark, sf_dir))
    kept = rules(raw)
    best = suppression.precluster(kept, ["video"], "frame", [F.col("frame"), *order()], ["frame", *FIELDS], "conf", gap=4)
    return evaluation.funnel({"raw": raw, "filtered": kept, "clustered": best}, ["video", "frame"])


@query("WITH u AS (SELECT 'a' AS source, c_name AS file, c_nationkey AS label FROM customer UNION ALL SELECT 'b', s_name, s_nationkey FROM supplier) SELECT source || '_' || lpad((row_number() OVER (ORDER BY source, file) - 1)::VARCHAR, 6, '0') AS file, label FROM u")
def set_merge_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET06: lists of several sources as one, numbered over all, under their source's name."""
    a = read(spark, sf_dir, "customer").select(F.lit("a").alias("source"), F.col("c_name").alias("file"), F.col("c_nationkey").alias("label"))
    both = a.unionByName(read(spark, sf_dir, "supplier").select(F.lit("b").alias("source"), F.col("s_name").alias("file"), F.col("s_nationkey").alias("label")))
    numbered = splits.renumber(both, ["source", "file"])
    return numbered.select(F.concat("source", F.lit("_"), F.lpad(F.col("position").cast("string"), 6, "0")).alias("file"), "label")


@query("WITH u AS (SELECT 's0' AS source, CASE WHEN c_custkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, c_name AS file, c_nationkey AS label FROM customer UNION ALL SELECT 's1', CASE WHEN s_suppkey % 5 = 0 THEN 'val' ELSE 'train' END, s_name, s_nationkey FROM supplier) SELECT split, source || '_' || lpad((row_number() OVER (ORDER BY source, split, file) - 1)::VARCHAR, 6, '0') AS file, label FROM u")
def set_merge_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET06: training and validation lists of several sources merged apart, under one counter over sources and their lists."""
    lists = []
    for k, (table, key, name, label) in enumerate((("customer", "c_custkey", "c_name", "c_nationkey"), ("supplier", "s_suppkey", "s_name", "s_nationkey"))):
        split = F.when(F.col(key) % 5 == 0, "val").otherwise("train")
        lists.append(read(spark, sf_dir, table).select(F.lit(f"s{k}").alias("source"), split.alias("split"), F.col(name).alias("file"), F.col(label).alias("label")))
    numbered = splits.renumber(lists[0].unionByName(lists[1]), ["source", "split", "file"])
    return numbered.select("split", F.concat("source", F.lit("_"), F.lpad(F.col("position").cast("string"), 6, "0")).alias("file"), "label")


@query("SELECT doc_id, CASE WHEN source IN ('src0', 'src3') OR source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6') OR ('0x' || substr(md5('8:' || doc_id::VARCHAR), 1, 8))::BIGINT % 1000 < 120 THEN 'val' ELSE 'train' END AS split FROM documents")
def smp_holdout_or_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP03: held sources, sources outside the training list, and a draw among the rest."""
    drawn = splits.bernoulli(8, F.col("doc_id"), 120) == "val"
    return read(spark, sf_dir, "documents").select("doc_id", splits.holdout(F.col("source"), ["src0", "src3"], [f"src{k}" for k in range(7)], drawn).alias("split"))


_DRAW = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT % 1000 < {permille}"


@query(f"WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'n' || doc_id::VARCHAR ELSE doc_id::VARCHAR END AS frame FROM documents) SELECT doc_id, CASE WHEN CASE WHEN doc_id % 3 = 0 THEN {_DRAW.format(seed=4, key='frame', permille=150)} ELSE doc_id % 6 = 0 END THEN 'val' ELSE 'train' END AS split FROM f")
def smp_modulo_or_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP04: every sixth numbered frame, and a draw for frames without a number."""
    frame = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("n"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", frame.alias("frame")).select("doc_id", splits.modulo_or_draw(F.col("frame"), 0.15, 4).alias("split"))


@query("WITH n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('6:' || doc_id::VARCHAR), doc_id) AS rn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT source, doc_id FROM n WHERE rn <= 5")
def smp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP06: a few rows of each source by draw, without those that exist already."""
    return splits.negatives(read(spark, sf_dir, "documents").select("source", "doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "source", "doc_id", 5, 6)


_BUCKETS = {"short": "n_chars < 700", "labelled": "doc_id % 3 = 0", "first": "source = 'src0'"}
_PICK = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS bucket, {i} AS nth, row_number() OVER (ORDER BY md5('9:' || doc_id::VARCHAR), doc_id) AS rn FROM documents WHERE {test}" for i, (k, test) in enumerate(_BUCKETS.items()))


@query(f"WITH p AS (SELECT doc_id, bucket FROM ({_PICK}) WHERE rn <= 16), r AS (SELECT doc_id, 'rest' AS bucket, row_number() OVER (ORDER BY md5('9:' || doc_id::VARCHAR), doc_id) AS rn FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p)) SELECT * FROM p UNION ALL SELECT doc_id, bucket FROM r WHERE rn <= 50 - (SELECT count(*) FROM p)")
def smp_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMP01: as many rows of each bucket, which may overlap, then of the rest up to the total."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return splits.sample_buckets(docs, {k: F.expr(test) for k, test in _BUCKETS.items()}, "doc_id", 50, 9).select("doc_id", "bucket")


@query("WITH h AS (SELECT o_custkey % 7 AS split, max(o_orderkey) AS last FROM orders WHERE o_custkey % 7 <> 3 GROUP BY 1) SELECT c_custkey AS key, coalesce(last, -1) + row_number() OVER (PARTITION BY c_custkey % 7 ORDER BY c_custkey) AS index FROM customer LEFT JOIN h ON split = c_custkey % 7")
def ord_next_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD07: numbers that go on after the greatest of each split, from 0 where there is none."""
    held = read(spark, sf_dir, "orders").filter("o_custkey % 7 <> 3").select((F.col("o_custkey") % 7).alias("split"), F.col("o_orderkey").alias("index"))
    new = read(spark, sf_dir, "customer").select((F.col("c_custkey") % 7).alias("split"), F.col("c_custkey").alias("key"))
    return splits.next_index(new, held, "split", "key", "index").select("key", "index")


# Names of one letter each: the similarity of two is 0, or the common length twice over both lengths.
@query("WITH p AS (SELECT p_partkey AS part, p_partkey % 20 AS scope, p_partkey % 3 AS k, p_partkey % 9 + 1 AS n FROM part), g AS (SELECT s_suppkey AS supp, s_suppkey % 20 AS scope, s_suppkey % 4 AS k, s_suppkey * 7 % 13 + 1 AS n FROM supplier), j AS (SELECT part, supp, 2.0::DOUBLE * least(p.n, g.n) / (p.n + g.n) AS sim FROM p JOIN g USING (scope, k)), b AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY sim DESC, supp) AS rn FROM j WHERE sim > 0.15) SELECT part, supp, CAST(floor(sim * 1000 + 0.5) AS BIGINT) AS similarity FROM b WHERE rn = 1")
def joi_best_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI08: each reading with the truth of its recording whose name is most alike."""
    named = lambda k, n, letters: F.repeat(F.element_at(F.array(*[F.lit(x) for x in "abcd"[:letters]]), (k % letters + 1).cast("int")), n.cast("int"))
    part, supp = F.col("p_partkey"), F.col("s_suppkey")
    parsed = read(spark, sf_dir, "part").select(part.alias("part"), (part % 20).alias("scope"), named(part, part % 9 + 1, 3).alias("name"))
    truth = read(spark, sf_dir, "supplier").select(supp.alias("supp"), (supp % 20).alias("scope"), named(supp, supp * 7 % 13 + 1, 4).alias("name"))
    best = evaluation.best_alike(parsed, truth, "scope", "name", "supp")
    return best.select("part", "supp", F.floor(F.col("similarity") * 1000 + 0.5).cast("long").alias("similarity"))


# The ratio by its definition: the longest common block (first in the one, then in the other), then what lies on each side of it.
_BLOCKS = """w AS (SELECT id, a, b, 0 AS n FROM pairs UNION ALL SELECT id, unnest([a[:i - 1], a[i + n:], NULL]), unnest([b[:j - 1], b[j + n:], NULL]), unnest([0, 0, n]) FROM (
 SELECT id, a, b, m.n AS n, -m.i AS i, -m.j AS j FROM (SELECT id, a, b, list_max(list_filter(flatten(list_transform(range(1, len(a) + 1), lambda i: list_transform(range(1, len(a) - i + 2), lambda k: {'n': k, 'i': -i, 'j': -strpos(b, a[i:i + k - 1])}))), lambda s: s.j < 0)) AS m
 FROM w WHERE a <> '' AND b <> '') WHERE m IS NOT NULL)), ratio AS (SELECT id, sum(n) AS matched FROM w GROUP BY id)"""
_LONG = "p_name || ' ' || p_brand || ' ' || p_type"


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS part, lower({_LONG}) AS name FROM part), pairs AS (SELECT x.part AS id, x.name AS a, y.name AS b FROM p x JOIN p y ON y.part = x.part + 1), {_BLOCKS}
SELECT id AS part, CAST(floor(2000.0::DOUBLE * matched / (length(pairs.a) + length(pairs.b)) + 0.5) AS BIGINT) AS permille FROM pairs JOIN ratio USING (id)""")
def str_name_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR27, STR41: similarity of neighbouring names, real ones."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))
    other = p.select((F.col("part") - 1).alias("part"), F.col("name").alias("other"))
    both = p.join(other, "part").select("part", text.similarity(F.col("name"), F.col("other")).alias("s"))
    return both.select("part", F.floor(F.col("s") * 1000 + 0.5).cast("long").alias("permille"))


_MISREAD = f"""g AS (SELECT p_partkey AS part, p_partkey // 100 AS scope, lower({_LONG}) AS name, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part), r AS (SELECT part, scope, CASE WHEN part % 9 = 8 THEN repeat('q', 1 + part % 3) ELSE name[:part % 12] || 'x' || name[part % 12 + 2:] END AS name, cents FROM g WHERE part % 4 <> 0),
pairs AS (SELECT r.part * 1000000 + t.part AS id, t.name AS a, r.name AS b, r.part AS part, t.part AS truth FROM r JOIN g t ON t.scope = r.scope AND t.part % 4 = 0), {_BLOCKS},
s AS (SELECT part, truth, 2.0::DOUBLE * coalesce(matched, 0) / (length(pairs.a) + length(pairs.b)) AS sim FROM pairs LEFT JOIN ratio USING (id)), b AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY sim DESC, truth) AS rn FROM s WHERE sim > 0.15)"""


def _misread(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Names of three parts in four with one character misread (some are nothing like a name), and the fourth parts as the truth of their hundred."""
    part = F.col("p_partkey")
    g = read(spark, sf_dir, "part").select(part.alias("part"), F.floor(part / 100).cast("long").alias("scope"), F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("name"), F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    at = (F.col("part") % 12).cast("int")
    misread = F.when(F.col("part") % 9 == 8, F.repeat(F.lit("q"), (F.col("part") % 3 + 1).cast("int"))).otherwise(F.concat(F.substring("name", F.lit(1), at), F.lit("x"), F.substring("name", at + 2, F.lit(1000))))
    return g.filter("part % 4 <> 0").withColumn("name", misread), g.filter("part % 4 = 0").withColumnRenamed("part", "truth")


@query(f"WITH RECURSIVE {_MISREAD} SELECT part, truth, CAST(floor(sim * 1000 + 0.5) AS BIGINT) AS permille FROM b WHERE rn = 1")
def joi_best_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOI08: misread names with the true name of their recording that is most alike, real ones."""
    best = evaluation.best_alike(*_misread(spark, sf_dir), "scope", "name", "truth")
    return best.select("part", "truth", F.floor(F.col("similarity") * 1000 + 0.5).cast("long").alias("permille"))


@query(f"""WITH RECURSIVE {_MISREAD}, m AS (SELECT b.*, r.cents AS read, g.cents AS true_cents FROM b JOIN r ON r.part = b.part JOIN g ON g.part = b.truth WHERE rn = 1)
SELECT (SELECT count(*) FROM r) AS total_detected_tags, count(*) AS matched_with_gt, (SELECT count(*) FROM r) - count(*) AS unmatched, count_if(abs(read - true_cents) < 20000)::BIGINT AS price_default_exact_match, count_if(abs(read - true_cents + 150) < 20000)::BIGINT AS price_card_exact_match, count_if(sim > 0.6)::BIGINT AS product_name_sim_gt_60, round(avg(sim), 6) AS product_name_avg_sim FROM m""")
def agg_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG06, AGG22: figures of a whole run against ground truth, matched and unmatched."""
    prices_of = lambda df, less: df.withColumns({"default": F.col("cents"), "card": F.col("cents") - less})
    parsed, truth = _misread(spark, sf_dir)
    found = evaluation.end_to_end(prices_of(parsed, 0), prices_of(truth, 150), "scope", "name", "truth", "default", "card", within=20000)
    return found.withColumn("product_name_avg_sim", F.round("product_name_avg_sim", 6))
