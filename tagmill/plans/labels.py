"""Queries over recognised labels: prices, discounts, names, barcodes, payloads, result cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions import barcodes, coerce, prices, text
from tagmill.operators import contract
from tagmill.plans.proxies import EAN, OCR, ean, ocr, read, sql_check
from tagmill.plans.registry import query

# The same readings in DuckDB SQL, on the ASCII labels of `ocr`.
NORM = f"n AS (SELECT *, translate(text, '{prices.CONFUSED}', '{prices.MEANT}') AS norm0 FROM ocr), m AS (SELECT *, regexp_replace(regexp_replace(norm0, '{prices.LONG_RUN}', ' ', 'g'), '{prices.DATE}', ' ', 'g') AS norm FROM n)"


def sql_pairs(t: str, pattern: str) -> str:
    return f"list_transform(list_zip(regexp_extract_all({t}, '{pattern}', 1), regexp_extract_all({t}, '{pattern}', 2)), lambda z: CAST(z[1] AS BIGINT) * 100 + CAST(z[2] AS BIGINT))"


def sql_prices(t: str, tok: str) -> str:
    alone = f"list_transform(list_filter({tok}, lambda x: length(x) >= 3), lambda x: CAST(x AS BIGINT))"
    near = f"list_transform(range(1, len({tok})), lambda i: CASE WHEN length({tok}[i + 1]) = 2 THEN CAST({tok}[i] AS BIGINT) * 100 + CAST({tok}[i + 1] AS BIGINT) END)"
    every = " || ".join([sql_pairs(t, prices.PRICE_AND_CENTS), sql_pairs(t, prices.PRICE_POINT_CENTS), alone, near])
    return f"list_reverse_sort(list_distinct(list_filter({every}, lambda p: p BETWEEN 50 AND 999999)))"


def sql_first_discount(t: str, pattern: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({t}, '{pattern}', 1), lambda d: CAST(d AS BIGINT)), lambda d: d BETWEEN 5 AND 80)[1]"


def sql_discount(t: str) -> str:
    return f"coalesce({sql_first_discount(t, prices.SIGNED_PERCENT)}, {sql_first_discount(t, prices.AFTER_MINUS)})"


PRICED = f"{OCR}, {NORM}, tk AS (SELECT *, regexp_extract_all(norm, '{prices.PRICE_TOKEN}', 1) AS tok FROM m), pr AS (SELECT *, {sql_prices('norm', 'tok')} AS found, {sql_discount('norm0')} AS pct FROM tk)"
INFER = "CASE WHEN {p} BETWEEN 5 AND 40 AND ({c} * 200 + (100 - {p})) // ((100 - {p}) * 2) BETWEEN 50 AND 999999 THEN ({c} * 200 + (100 - {p})) // ((100 - {p}) * 2) END"
PLAIN = "({c} // 100)::VARCHAR || '.' || CASE WHEN {c} % 10 = 0 THEN (({c} % 100) // 10)::VARCHAR ELSE lpad(({c} % 100)::VARCHAR, 2, '0') END"
PARSED = f"""{PRICED}, c AS (SELECT *, CASE WHEN len(found) >= 1 THEN found[-1] END AS card, CASE WHEN len(found) >= 2 THEN found[1] END AS dflt FROM pr),
i AS (SELECT *, {INFER.format(c='card', p='pct')} AS inferred FROM c),
u AS (SELECT *, coalesce(inferred IS NOT NULL AND (dflt IS NULL OR dflt <= card + 1 OR NOT (abs(dflt - inferred) * 100 <= inferred * 12)), false) AS used FROM i),
z AS (SELECT *, CASE WHEN used THEN inferred ELSE dflt END AS final FROM u)"""


@query(f"WITH {OCR} SELECT part, translate(text, '{prices.CONFUSED}', '{prices.MEANT}') AS norm FROM ocr")
def str_confusables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR01: confusable characters as digits."""
    return ocr(spark, sf_dir).select("part", prices.as_digits(F.col("text")).alias("norm"))


@query(f"WITH {PRICED} SELECT part, list_transform(found, lambda x: x::VARCHAR).array_to_string(' ') AS cents FROM pr")
def str_price_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR02, STR03, ORD08: all price readings of a text."""
    return ocr(spark, sf_dir).select("part", F.array_join(prices.prices(F.col("text")).cast("array<string>"), " ").alias("cents"))


@query(f"WITH {PRICED} SELECT part, pct FROM pr")
def str_discount_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR04, STR15, STR22: the explicit discount."""
    return ocr(spark, sf_dir).select("part", prices.discount(F.col("text")).alias("pct"))


_USUAL = ", ".join(map(str, prices.USUAL_DISCOUNTS))


@query(f"WITH d AS (SELECT p_partkey AS part, (p_partkey % 90)::VARCHAR || ' ' || (p_partkey % 37)::VARCHAR || ' 7' AS text FROM part), l AS (SELECT part, list_filter(list_transform(regexp_extract_all(text, '\\b(\\d{{1,2}})\\b', 1), lambda x: CAST(x AS BIGINT)), lambda x: x BETWEEN 5 AND 80) AS c FROM d) SELECT part, coalesce(list_filter([{_USUAL}], lambda u: list_contains(c, u))[1], list_max(c))::BIGINT AS pct FROM l")
def str_discount_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR05: a discount from the price strip, usual steps first."""
    p = F.col("part")
    zone = F.concat_ws(" ", (p % 90).cast("string"), (p % 37).cast("string"), F.lit("7"))
    return ocr(spark, sf_dir).select("part", prices.zone_discount(zone).alias("pct"))


@query(f"WITH {OCR} SELECT part, {INFER.format(c='card_cents', p='percent')} AS inferred, coalesce(abs(default_cents - ({INFER.format(c='card_cents', p='percent')})) * 100 <= ({INFER.format(c='card_cents', p='percent')}) * 12, false) AS consistent FROM ocr")
def str_infer_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR06, STR07: price before the discount, and whether the read one agrees."""
    c, p = F.col("card_cents"), F.col("percent")
    return ocr(spark, sf_dir).select("part", prices.infer_default(c, p).alias("inferred"), prices.consistent(c, F.col("default_cents"), p).alias("consistent"))


_NAME = "list_aggregate(list_filter(list_transform(string_split(text, '|'), lambda x: trim(x)), lambda x: length(x) = list_max(list_transform(string_split(text, '|'), lambda y: CASE WHEN {ok} THEN length(trim(y)) END)) AND {okx}), 'first')"
_OK = "length(trim({x})) > 3 AND length(regexp_replace(translate(trim({x}), '" + prices.CONFUSED + "', '" + prices.MEANT + "'), '\\D', '', 'g')) * 2 < length(trim({x})) AND NOT regexp_matches(translate(trim({x}), '" + prices.CONFUSED + "', '" + prices.MEANT + "'), '^[\\d\\s.,\\-+%]+$')"


NAME_OF_LABEL = _NAME.format(ok=_OK.format(x="y"), okx=_OK.format(x="x"))


@query(f"WITH {PARSED} SELECT part, coalesce({NAME_OF_LABEL}, '') AS product_name, coalesce({PLAIN.format(c='coalesce(final, card)')}, '') AS price_default, coalesce({PLAIN.format(c='card')}, '') AS price_card, coalesce('-' || pct::VARCHAR || '%', '') AS discount_amount, used AS price_default_inferred FROM z")
def str_parse_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR08 to STR10, STR17, STR39, STR42: a label's text to its fields."""
    return ocr(spark, sf_dir).select("part", prices.parse_text(F.col("text")).alias("p")).select("part", "p.*")


_CSV = "WITH d AS (SELECT p_partkey AS part, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN (p_partkey % 60)::VARCHAR || '.5' WHEN 2 THEN (p_partkey % 400)::VARCHAR || ',25' WHEN 3 THEN 'n/a' ELSE (p_partkey % 60)::VARCHAR END AS t FROM part)"
_V = "CAST(round(TRY_CAST(replace(t, ',', '.') AS DECIMAL(18,6)) * 100) AS BIGINT)"
_SHOW = "CASE WHEN t = '' THEN '' WHEN {v} IS NULL THEN t ELSE ({w} // 100)::VARCHAR || ',' || lpad(({w} % 100)::VARCHAR, 2, '0') END"


def _price_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    cell = F.when(p % 5 == 0, "").when(p % 5 == 1, F.concat((p % 60).cast("string"), F.lit(".5"))).when(p % 5 == 2, F.concat((p % 400).cast("string"), F.lit(",25"))).when(p % 5 == 3, "n/a").otherwise((p % 60).cast("string"))
    return read(spark, sf_dir, "part").select(p.alias("part"), cell.alias("t"))


@query(f"{_CSV} SELECT part, {_SHOW.format(v=_V, w=f'(CASE WHEN {_V} BETWEEN 1 AND 4999 THEN {_V} * 100 ELSE {_V} END)')} AS scaled, {_SHOW.format(v=_V, w=_V)} AS plain FROM d")
def str_price_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR21, STR23, STR24: result cells with and without display scaling."""
    t = F.col("t")
    return _price_cells(spark, sf_dir).select("part", prices.csv_price(t).alias("scaled"), prices.csv_price(t, scale=False).alias("plain"))


_READ = "[x for x in [{v}, CASE WHEN {v} < 5000 THEN {v} * 100 END, CASE WHEN {v} < 5000 THEN {v} * 100 + 99 - ({v} * 100) % 100 END, CASE WHEN {v} > 5000 THEN ({v} + 50) // 100 END] if x IS NOT NULL]"


@query(f"WITH {OCR}, d AS (SELECT part, CASE WHEN part % 7 = 0 THEN -1 ELSE card_cents END AS a, CASE WHEN part % 11 = 0 THEN -1 WHEN part % 2 = 0 THEN card_cents // 100 ELSE default_cents END AS b FROM ocr) SELECT part, CASE WHEN a < 0 AND b < 0 THEN true WHEN a < 0 OR b < 0 THEN false ELSE len(list_filter({_READ.format(v='a')}, lambda x: len(list_filter({_READ.format(v='b')}, lambda y: abs(x - y) <= 200)) > 0)) > 0 END AS same FROM d")
def str_tolerant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR18 to STR20, DUP11: price equality in any reading."""
    p, show = F.col("part"), prices.comma
    left = F.when(p % 7 == 0, "нет").otherwise(show(F.col("card_cents")))
    right = F.when(p % 11 == 0, "").when(p % 2 == 0, show(F.floor(F.col("card_cents") / 100).cast("long"))).otherwise(show(F.col("default_cents")))
    return ocr(spark, sf_dir).select("part", prices.prices_match(left, right).alias("same"))


@query("SELECT doc_id, md5(regexp_replace(lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))), '(\\d),(\\d)', '\\1.\\2', 'g')) AS h FROM documents")
def str_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR25: normal form of a text (as a digest)."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("h"))


@query(f"WITH {OCR} SELECT part, CASE WHEN gd = 'нет' THEN pd = 'нет' WHEN pd = 'нет' THEN false ELSE abs(a - b) <= 2 END AS same FROM (SELECT part, percent AS a, (percent + part % 4) AS b, CASE WHEN part % 6 = 0 THEN 'нет' ELSE 'x' END AS gd, CASE WHEN part % 9 = 0 THEN 'нет' ELSE 'x' END AS pd FROM ocr)")
def str_discount_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR28, STR29: discounts within two percent."""
    p, pct = F.col("part"), F.col("percent")
    show = lambda v: F.concat(F.lit("-"), v.cast("string"), F.lit(" %"))
    pred, given = F.when(p % 9 == 0, "нет").otherwise(show(pct)), F.when(p % 6 == 0, "нет").otherwise(show(pct + p % 4))
    return ocr(spark, sf_dir).select("part", F.when((p % 9 == 0) & (p % 6 != 0), False).otherwise(prices.discounts_match(pred, given)).alias("same"))


@query(f"WITH {OCR} SELECT part, length(trim(n)) >= 3 AND length(regexp_replace(trim(n), '\\D', '', 'g')) * 100 < length(trim(n)) * 55 OR part % 3 = 0 AS readable, CASE WHEN length(n) < 3 AND part % 3 <> 0 THEN 'no_name_and_no_price' WHEN length(n) < 3 THEN 'no_name' ELSE 'no_price' END AS reason FROM (SELECT part, CASE WHEN part % 4 = 0 THEN '12' WHEN part % 4 = 1 THEN '12345 a' ELSE name END AS n FROM ocr)")
def flt_readable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT06, FLT07: readable labels, and why others are not."""
    p = F.col("part")
    name = F.when(p % 4 == 0, "12").when(p % 4 == 1, "12345 a").otherwise(F.col("name"))
    price = F.when(p % 3 == 0, "3.05").otherwise("")
    raw = F.lit("x")
    return ocr(spark, sf_dir).select("part", text.readable(name, F.lit(""), price, raw).alias("readable"), text.fail_reason(name, F.lit(""), price, raw).alias("reason"))


@query("SELECT p_partkey AS part, length(p_name) BETWEEN 1 AND 25 AND trim(p_name) <> '' AND translate(p_name, 'abcdefghijklmnopqrstuvwxyz0123456789 ', '') = '' AS valid FROM part")
def flt_text_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT08, SRC23: training texts of dictionary characters."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), text.text_valid(F.col("p_name"), "abcdefghijklmnopqrstuvwxyz0123456789").alias("valid"))


@query("SELECT doc_id, source, regexp_extract('data/cam_' || lpad((doc_id % 90)::VARCHAR, 2, '0') || '_' || (doc_id % 13)::VARCHAR || '.mp4', '(\\d{2}_\\d{1,2})', 1) AS recording FROM documents")
def str_source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR30 to STR32, STR40: the recording that a path names."""
    i = F.col("doc_id")
    path = F.concat(F.lit("data/cam_"), F.lpad((i % 90).cast("string"), 2, "0"), F.lit("_"), (i % 13).cast("string"), F.lit(".mp4"))
    return read(spark, sf_dir, "documents").select("doc_id", "source", text.source_name(path).alias("recording"))


@query()
def str_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR27, STR41: Ratcliff-Obershelp similarity of neighbouring names. Not expressible in SQL."""
    p = ocr(spark, sf_dir).select("part", "name")
    other = p.select((F.col("part") - 1).alias("part"), F.col("name").alias("other"))
    return p.join(other, "part").select("part", text.similarity(F.col("name"), F.col("other")).alias("similarity"))


@query(f"WITH {EAN} SELECT n AS part, code, {sql_check('code')}::INTEGER AS digit, {sql_check('code')} = CAST(substr(code, 13, 1) AS BIGINT) AS valid FROM ean")
def bar_ean13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BAR01, BAR02: check digits."""
    codes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), ean(F.col("p_partkey")).alias("code"))
    return codes.select("part", "code", barcodes.check_digit(F.col("code")).alias("digit"), barcodes.valid_ean13(F.col("code")).alias("valid"))


@query(f"WITH {EAN}, g AS (SELECT n // 3 AS g, list(code ORDER BY n) AS c FROM ean GROUP BY n // 3) SELECT g, coalesce(list_filter(c, lambda x: {sql_check('x')} = CAST(substr(x, 13, 1) AS BIGINT))[1], c[1]) AS best FROM g")
def bar_pick_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BAR03, BAR04, BAR08, BAR09, DUP12: the best of several decoded codes."""
    codes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), ean(F.col("p_partkey")).alias("code"))
    grouped = codes.groupBy(F.floor(F.col("n") / 3).cast("long").alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda x: x["code"]).alias("c"))
    return grouped.select("g", barcodes.best_barcode(F.col("c")).alias("best"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def qr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BAR05: payloads that are JSON objects."""
    pairs = barcodes.qr_pairs(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", F.try_element_at(pairs, F.lit("k")).alias("k"))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages WHERE contains(url, '?')")
def qr_query_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BAR05: payloads that are URLs with a query."""
    pairs = barcodes.qr_pairs(F.col("url"))
    pages = read(spark, sf_dir, "pages").filter(F.contains("url", F.lit("?"))).select("page_id", pairs.alias("m"))
    return pages.select("page_id", *[F.nullif(F.try_element_at("m", F.lit(k)), F.lit("")).alias(k) for k in ("page", "ref")])


@query("SELECT p_partkey AS part, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey % 100)::VARCHAR ELSE (p_partkey % 70)::VARCHAR END AS price1_qr, p_partkey::VARCHAR AS qr_code_barcode, CASE WHEN p_partkey % 3 = 0 THEN '5' END AS action_code_qr FROM part")
def qr_alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BAR06, BAR07: fields by long, then short name; the first payload wins."""
    p = F.col("p_partkey")
    first = F.concat(F.when(p % 2 == 0, F.concat(F.lit("price1="), (p % 100).cast("string"), F.lit("&p1=9"))).otherwise(F.concat(F.lit("price1=&p1="), (p % 70).cast("string"))), F.lit("&b="), p.cast("string"))
    second = F.concat(F.lit("b=0"), F.when(p % 3 == 0, "&aC=5").otherwise("&aC="))
    merged = barcodes.merge_first(F.array(barcodes.qr_pairs(first), barcodes.qr_pairs(second)))
    df = read(spark, sf_dir, "part").select(p.alias("part"), F.explode(F.array(merged)).alias("m"))
    return df.select("part", *barcodes.qr_fields(F.col("m"))).select("part", "price1_qr", "qr_code_barcode", "action_code_qr")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("part")
    return ocr(spark, sf_dir).select(
        "part", F.col("name").alias("product_name"), F.when(p % 4 == 0, "").otherwise(prices.plain(F.col("default_cents"))).alias("price_default"), F.when(p % 6 == 0, "нет").when(p % 4 == 0, "").otherwise(prices.plain(F.col("card_cents"))).alias("price_card"),
        F.when(p % 3 == 0, "4600000000000").otherwise("").alias("barcode"), F.when(p % 5 == 0, "").otherwise("-10%").alias("discount_amount"), F.when(p % 2 == 0, "red").otherwise("").alias("color"),
        F.when(p % 8 == 0, "7").otherwise("").alias("qr_code_barcode"),
    )


_COMMA = "({v} // 100)::VARCHAR || ',' || lpad(({v} % 100)::VARCHAR, 2, '0')"
_CELLS = f"""{OCR}, cells AS (SELECT part, trim(name) AS product_name, CASE WHEN part % 4 = 0 THEN '' ELSE {_COMMA.format(v='default_cents')} END AS price_default,
 CASE WHEN part % 6 = 0 THEN 'нет' WHEN part % 4 = 0 THEN '' ELSE {_COMMA.format(v='card_cents')} END AS price_card, CASE WHEN part % 3 = 0 THEN '4600000000000' ELSE '' END AS barcode,
 CASE WHEN part % 5 = 0 THEN 'нет' ELSE '-10%' END AS discount_amount, CASE WHEN part % 2 = 0 THEN 'red' ELSE '' END AS color, CASE WHEN part % 8 = 0 THEN '7' ELSE '' END AS qr_code_barcode FROM ocr)"""


def _contract_sql() -> str:
    from tagmill.plans.detections import sql_row

    given = ("product_name", "price_default", "price_card", "barcode", "discount_amount", "color", "qr_code_barcode")
    return f"WITH {_CELLS} SELECT {sql_row({c: c for c in given} | {c: repr('нет') for c in contract.ALWAYS_ABSENT})} FROM cells"


@query(_contract_sql())
def prj_contract29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ01, PRJ02, SNK01: the 29 columns with blank and absent cells."""
    return contract.result_rows(_cells(spark, sf_dir))


_FILLED = "({c} <> '' AND {c} <> 'нет')"
_F = {c: _FILLED.format(c=c) for c in contract.PROFILE}


@query(f"WITH {_CELLS} SELECT part, array_to_string(list_filter([{', '.join(f'CASE WHEN {t} THEN {c!r} END' for c, t in _F.items())}], lambda x: x IS NOT NULL), '|') AS filled_fields, ({' + '.join(f'{t}::BIGINT' for t in _F.values())}) AS filled_count, CASE WHEN {_F['price_default']} AND {_F['price_card']} THEN 'True' ELSE 'False' END AS has_price_pair, CASE WHEN {_F['barcode']} THEN 'True' ELSE 'False' END AS has_barcode, CASE WHEN {_F['discount_amount']} THEN 'True' ELSE 'False' END AS has_discount FROM cells")
def prj_fill_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ04, PRJ05, FLT11: which main fields are filled."""
    return _cells(spark, sf_dir).select("part", *contract.fill_profile())


_N = "(1 + (price_default <> '')::BIGINT + (price_card <> '')::BIGINT + (barcode <> '')::BIGINT + 1 + 3 + (color <> '')::BIGINT + (qr_code_barcode <> '')::BIGINT)"
_I = "[x for x in [CASE WHEN barcode = '' AND qr_code_barcode = '' THEN 'QR_MISSING' END, CASE WHEN price_default IN ('', 'нет') AND price_card IN ('', 'нет') THEN 'PRICE_NOT_FOUND' END, CASE WHEN part % 100 < 30 THEN 'LOW_CONFIDENCE' END, CASE WHEN " + _N + " < 7 THEN 'OCR_INCOMPLETE' END] if x IS NOT NULL]"


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    rows = contract.result_rows(cells.withColumn("filename", F.col("part").cast("string")))
    rows = rows.withColumn("part", F.col("filename").cast("long")).withColumn("filename", F.lit(""))
    confidence = F.when(F.col("part") % 100 < 30, 0.5).otherwise(0.9)
    return rows.withColumn("filled_count", contract.filled_count()).withColumn("issues", contract.issues(confidence, F.col("filled_count"))).withColumn("confidence", confidence)


@query(f"WITH {_CELLS} SELECT part, {_N} AS filled_count, array_to_string({_I}, ',') AS issues, CASE WHEN len({_I}) > 0 THEN 'review' ELSE 'ready' END AS status FROM cells")
def prj_issue_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ07, PRJ08, AGG15: issue marks of a result row."""
    status = F.when(F.size("issues") > 0, "review").otherwise("ready")
    return _issues(spark, sf_dir).select("part", "filled_count", F.array_join("issues", ",").alias("issues"), status.alias("status"))


@query(f"WITH {_CELLS}, i AS (SELECT part, {_I} AS x FROM cells) SELECT part, CASE WHEN list_contains(x, 'PRICE_NOT_FOUND') THEN 'check price' WHEN list_contains(x, 'QR_MISSING') THEN 'check code' WHEN list_contains(x, 'LOW_CONFIDENCE') THEN 'check reading' WHEN list_contains(x, 'OCR_INCOMPLETE') THEN 'check fields' ELSE 'ready' END AS recommendation FROM i")
def prj_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ09, AGG16: what to do about the gravest issue."""
    return _issues(spark, sf_dir).select("part", contract.recommendation(F.col("issues")).alias("recommendation"))


@query(f"WITH {_CELLS}, i AS (SELECT part, {_I} AS x FROM cells) SELECT issue, count(*) AS n FROM (SELECT unnest(x) AS issue FROM i) GROUP BY issue")
def agg_issue_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14: rows by issue."""
    return _issues(spark, sf_dir).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query(f"WITH {_CELLS}, i AS (SELECT part, {_I} AS x, {_N} AS n, barcode <> '' OR qr_code_barcode <> '' AS coded, CASE WHEN part % 100 < 30 THEN 50 ELSE 90 END AS conf FROM cells), a AS (SELECT count(*) AS n_rows, count_if(coded)::BIGINT AS qr_decoded, count_if(len(x) > 0)::BIGINT AS issue_rows, sum(n)::BIGINT AS filled, sum(len(x))::BIGINT AS n_issues, sum(conf)::BIGINT AS conf FROM i) SELECT n_rows, qr_decoded, issue_rows, filled, floor(100.0 * filled / (29 * n_rows) + 0.5)::BIGINT AS completeness, greatest(0, floor(100 - 8.0 * n_issues / n_rows - 20 * (1 - conf / (100.0 * n_rows)) + 0.5))::BIGINT AS health FROM a")
def agg_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13, AGG17, STR38: figures of a dashboard."""
    coded = coerce.filled(F.col("barcode")) | coerce.filled(F.col("qr_code_barcode"))
    total = _issues(spark, sf_dir).agg(
        F.count("*").alias("n_rows"), F.count_if(coded).alias("qr_decoded"), F.count_if(F.size("issues") > 0).alias("issue_rows"), F.sum("filled_count").alias("filled"),
        F.sum(F.size("issues")).alias("n_issues"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("conf"),
    )
    half_up = lambda c: F.floor(c + 0.5).cast("long")
    n = F.col("n_rows")
    health = F.greatest(F.lit(0).cast("long"), half_up(100 - F.lit(8.0) * F.col("n_issues") / n - 20 * (1 - F.col("conf") / (n * 100.0))))
    return total.select("n_rows", "qr_decoded", "issue_rows", "filled", half_up(F.lit(100.0) * F.col("filled") / (n * 29)).alias("completeness"), health.alias("health"))


@query(f"WITH {_CELLS} SELECT field, floor(1000.0 * n / total + 0.5)::BIGINT AS permille FROM (SELECT unnest(['product_name', 'price_default', 'price_card', 'barcode', 'discount_amount', 'color']) AS field, unnest([{', '.join(f'count_if({t})' for t in _F.values())}]) AS n, count(*) AS total FROM cells)")
def agg_fill_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG04: share of filled cells by column, in one pass, then unpivoted."""
    counts = _cells(spark, sf_dir).agg(F.count("*").alias("total"), *[F.count_if(coerce.filled(F.col(c))).alias(c) for c in contract.PROFILE])
    long = counts.unpivot("total", list(contract.PROFILE), "field", "n")
    return long.select("field", F.floor(F.lit(1000.0) * F.col("n") / F.greatest("total", F.lit(1)) + 0.5).cast("long").alias("permille"))
