"""Queries over label rows: merged readings, reference text, labelling, regions, trust."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import prices
from tagmill.operators import matching, rows
from tagmill.plans.labels import _CELLS, INFER, PLAIN, _cells
from tagmill.plans.proxies import OCR, ocr, read
from tagmill.plans.registry import query


def _split(c):  # noqa: ANN001, ANN202
    return F.concat(F.floor(c / 100).cast("string"), F.lit(" "), F.lpad((c % 100).cast("string"), 2, "0"))


# A name that reads as half digits or more is none.
_NAMED = f"CASE WHEN length(regexp_replace(translate(trim(name), '{prices.CONFUSED}', '{prices.MEANT}'), '\\D', '', 'g')) * 2 < length(trim(name)) THEN trim(name) ELSE '' END"
_MERGED = f"""m AS (SELECT part, name, default_cents AS dflt, (card_cents // 100) * 100 AS card, CASE WHEN percent >= 5 THEN percent END AS pct FROM ocr),
i AS (SELECT *, {INFER.format(c='card', p='pct')} AS inferred FROM m),
u AS (SELECT *, coalesce(inferred IS NOT NULL AND (dflt <= card + 1 OR NOT (abs(dflt - inferred) * 100 <= inferred * 12)), false) AS used FROM i),
z AS (SELECT *, CASE WHEN used THEN inferred ELSE dflt END AS final FROM u)"""


@query(f"WITH {OCR}, {_MERGED} SELECT part, {_NAMED} AS product_name, {PLAIN.format(c='final')} AS price_default, {PLAIN.format(c='card')} AS price_card, coalesce('-' || pct::VARCHAR || '%', '') AS discount_amount, used AS price_default_inferred, CASE WHEN part % 2 = 0 THEN 'red_panel' ELSE 'fallback' END AS template FROM z")
def str_merged_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR12, STR13, STR16, PRJ13: readings of a label's regions with fallbacks."""
    card, default = _split(F.col("card_cents")), _split(F.col("default_cents"))
    full = F.when(F.col("part") % 3 == 0, "").otherwise(F.col("name"))
    merged = rows.merged_reading(F.col("name"), default, card, F.concat(F.lit("-"), F.col("percent").cast("string"), F.lit("%")), full, prices.zone_candidates(F.lit("234 99")), F.col("part") % 2 == 0)
    return ocr(spark, sf_dir).select("part", merged.alias("m")).select("part", "m.*")


_ZONE = "list_filter([v * 100 + 99, v * 100, CASE WHEN v >= 1000 THEN (v // 10) * 100 + v % 10 END], lambda x: x IS NOT NULL AND x BETWEEN 5000 AND 999900)"


@query(f"SELECT part, array_to_string(list_transform({_ZONE}, lambda x: x::VARCHAR), ' ') AS cents FROM (SELECT p_partkey AS part, 100 + p_partkey % 3000 AS v FROM part)")
def str_zone_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR14: weak readings of a lone shelf price."""
    number = (100 + F.col("part") % 3000).cast("string")
    return ocr(spark, sf_dir).select("part", F.array_join(prices.zone_candidates(F.concat(F.lit("- "), number, F.lit(" -"))).cast("array<string>"), " ").alias("cents"))


@query(f"WITH {_CELLS} SELECT part, concat_ws(' ', nullif(product_name, ''), nullif(replace(price_default, ',', '.'), ''), CASE WHEN price_card = '' THEN NULL ELSE replace(price_card, ',', '.') END, nullif(barcode, ''), nullif(CASE WHEN part % 5 = 0 THEN '' ELSE '-10%' END, '')) AS reference FROM cells")
def prj_reference_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ14: an annotation's cells as one text."""
    two = lambda c: F.when(F.col(c).isin("", "нет"), F.col(c)).otherwise(F.replace(prices.csv_price(F.col(c)), F.lit(","), F.lit(".")))
    cells = _cells(spark, sf_dir).withColumns({c: two(c) for c in ("price_default", "price_card")})
    return cells.select("part", rows.reference_text(("product_name", "price_default", "price_card", "barcode", "discount_amount")).alias("reference"))


@query(f"WITH {OCR} SELECT part, CASE WHEN part % 3 = 0 THEN 'given' ELSE {_NAMED} END AS label_product_name, part % 3 = 0 OR part % 4 = 0 AS was_labeled, CASE WHEN part % 4 = 0 THEN 'line' END AS given_line FROM ocr")
def prj_fill_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ15, PRJ19, FLT09, STR11: blank labels filled from the recognised text."""
    p = F.col("part")
    df = ocr(spark, sf_dir).select("part", "text", F.when(p % 3 == 0, "given").otherwise(" ").alias("label_product_name"), F.when(p % 4 == 0, "line").otherwise("").alias("label_price_line"))
    marked = rows.add_labels(df).withColumn("was_labeled", rows.labeled())
    filled = rows.fill_labels(marked, "text")
    return filled.select("part", "label_product_name", "was_labeled", F.when(F.col("label_price_line") == "line", "line").alias("given_line"))


_R = ", ".join(f"('{f}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for f, (a, b, c, d) in rows.REGIONS.items())


@query(f"""WITH p AS (SELECT p_partkey AS part, (p_partkey % 40) / 100.0::DOUBLE AS x, (p_partkey % 50) / 100.0::DOUBLE AS y FROM part), r(field, a, b, c, d) AS (VALUES {_R}),
b AS (SELECT part, x, y, x + 0.5::DOUBLE AS x2, y + 0.4::DOUBLE AS y2, greatest(x + 0.5::DOUBLE - x, 0.01) AS w, greatest(y + 0.4::DOUBLE - y, 0.01) AS h FROM p WHERE part % 2 = 0)
SELECT part, field, a AS x1, b AS y1, c AS x2, d AS y2 FROM p, r WHERE part % 2 = 1
UNION ALL SELECT part, 'product_name', 0.03::DOUBLE, 0.02::DOUBLE, 0.97::DOUBLE, greatest(0.16::DOUBLE, y - 0.03::DOUBLE) FROM b
UNION ALL SELECT part, 'price_default', least(0.95::DOUBLE, x + 0.36::DOUBLE * w), greatest(0::DOUBLE, y - 0.06::DOUBLE * h), least(0.98::DOUBLE, x + 0.88::DOUBLE * w), least(0.98::DOUBLE, y + 0.52::DOUBLE * h) FROM b
UNION ALL SELECT part, 'discount_amount', greatest(0::DOUBLE, x), greatest(0::DOUBLE, y), least(0.98::DOUBLE, x + 0.25::DOUBLE * w), least(0.98::DOUBLE, y + 0.5::DOUBLE * h) FROM b
UNION ALL SELECT part, 'price_card', greatest(0::DOUBLE, x + 0.03::DOUBLE * w), greatest(0::DOUBLE, y + 0.08::DOUBLE * h), least(0.98::DOUBLE, x + 0.42::DOUBLE * w), least(0.99::DOUBLE, y2) FROM b
UNION ALL SELECT part, 'barcode_text', greatest(0::DOUBLE, x + 0.48::DOUBLE * w), greatest(0::DOUBLE, y + 0.52::DOUBLE * h), least(0.99::DOUBLE, x2), least(0.99::DOUBLE, y2) FROM b""")
def geo_field_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO10, GEO11: regions of a label's fields, placed by its red panel or fixed."""
    p = F.col("part")
    x, y = (p % 40) / F.lit(100.0), (p % 50) / F.lit(100.0)
    panel = F.when(p % 2 == 0, F.struct(x.alias("x1"), y.alias("y1"), (x + 0.5).alias("x2"), (y + 0.4).alias("y2")))
    df = ocr(spark, sf_dir).select("part", panel.alias("panel"))
    return df.select("part", F.inline(rows.regions(F.col("panel"))))


@query("SELECT p_partkey AS part, z.zone, z.x1, z.y1, z.x2, z.y2 FROM (SELECT p_partkey, unnest([struct_pack(zone := 'name', x1 := 0, y1 := 0, x2 := w, y2 := c), struct_pack(zone := 'discount', x1 := 0, y1 := c, x2 := least(greatest(8, (w * 38) // 100), w), y2 := h), struct_pack(zone := 'card', x1 := w // 10, y1 := c, x2 := w, y2 := h)]) AS z FROM (SELECT p_partkey, 101 + p_partkey % 300 AS w, 103 + p_partkey % 200 AS h, ((103 + p_partkey % 200) * 45) // 100 AS c FROM part))")
def geo_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GEO14: strips of a label."""
    p = F.col("part")
    return ocr(spark, sf_dir).select("part", F.inline(rows.zones(101 + p % 300, 103 + p % 200)))


@query("WITH m AS (SELECT l_partkey AS part, arg_max(l_orderkey, (l_orderkey, l_linenumber, l_suppkey)) AS source FROM lineitem GROUP BY l_partkey) SELECT p_partkey AS part, 'crops/' || p_partkey::VARCHAR || '.jpg' AS crop_path, p_partkey::VARCHAR || '.jpg' AS filename, coalesce(source::VARCHAR, '') AS source_image FROM part LEFT JOIN m ON part = p_partkey")
def prj_rows_from_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ03, PRJ12: parsed rows with the last manifest row of their crop."""
    from tagmill.plans.proxies import det
    from tagmill.sources.readers import normalize_manifest

    m = matching.last_wins(det(spark, sf_dir).select("part", "image_id", "line", "supp"), ["part"], [F.col("image_id"), F.col("line"), F.col("supp")])
    crops = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.concat(F.lit("crops/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("crop_path"))
    return normalize_manifest(crops).join(m, "part", "left").select("part", "crop_path", "filename", F.coalesce(F.col("image_id").cast("string"), F.lit("")).alias("source_image"))


@query("SELECT doc_id AS id, source AS gt_source, CASE WHEN doc_id % 10 = 0 THEN 'diagnostic' WHEN source IN (SELECT DISTINCT 'src' || (doc_id % 7)::VARCHAR FROM labels) THEN 'contaminated' ELSE 'honest' END AS trust_level FROM documents")
def agg_registry_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20: trust of artefacts by leakage."""
    train = read(spark, sf_dir, "labels").select(F.concat(F.lit("src"), (F.col("doc_id") % 7).cast("string")).alias("source"))
    artefacts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("gt_source"), (F.col("doc_id") % 10 == 0).alias("diagnostic"))
    return rows.trust(train, artefacts).select("id", "gt_source", "trust_level")
