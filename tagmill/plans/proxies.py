"""Detection tables derived from the star schema, alike in Spark and in SQL: integers only, so results are exact.

`det`: an order's lines as the detections of an image (or, by number, of a frame of a video).
`gt`: orders' customers as annotated boxes.  `ocr`: parts as recognised price labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID = ["image_id", "line", "part", "supp"]
FIELDS = ["line", "part", "supp", "x1", "y1", "x2", "y2", "conf"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    x1, y1 = (part * 37 + supp * 11) % 300, (supp * 53) % 200
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("line"), part.alias("part"), supp.alias("supp"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 60 + part % 80).alias("x2"), (y1 + 50 + supp % 60).alias("y2"),
        F.round("l_extendedprice").cast("long").alias("conf"),
    )


DET = """det AS (SELECT l_orderkey AS image_id, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, l_suppkey AS supp,
 (l_partkey*37+l_suppkey*11)%300 AS x1, (l_suppkey*53)%200 AS y1, (l_partkey*37+l_suppkey*11)%300+60+l_partkey%80 AS x2,
 (l_suppkey*53)%200+50+l_suppkey%60 AS y2, CAST(round(l_extendedprice) AS BIGINT) AS conf FROM lineitem)"""


def video(df: DataFrame) -> DataFrame:
    return df.withColumn("video", F.col("image_id") % 1000).withColumn("frame", F.floor(F.col("image_id") / 1000).cast("long"))


VIDEO = "vid AS (SELECT *, image_id % 1000 AS video, image_id // 1000 AS frame FROM det)"


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One annotated box for each order: as a detection's, moved by its customer."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    x1, y1 = (key * 29 + cust * 7) % 300, (cust * 31) % 200
    return read(spark, sf_dir, "orders").select(
        key.alias("image_id"), cust.alias("tag"), x1.alias("x1"), y1.alias("y1"), (x1 + 70 + cust % 50).alias("x2"), (y1 + 60 + key % 40).alias("y2"), F.round("o_totalprice").cast("long").alias("price"),
    )


GT = """gt AS (SELECT o_orderkey AS image_id, o_custkey AS tag, (o_orderkey*29+o_custkey*7)%300 AS x1, (o_custkey*31)%200 AS y1,
 (o_orderkey*29+o_custkey*7)%300+70+o_custkey%50 AS x2, (o_custkey*31)%200+60+o_orderkey%40 AS y2, CAST(round(o_totalprice) AS BIGINT) AS price FROM orders)"""


def cents() -> Column:
    return F.round(F.col("p_retailprice") * 100).cast("long")


def ocr(spark: SparkSession, sf_dir: str, name: str = "p_name") -> DataFrame:
    """Recognised labels: 'NNN NN | NNN NN | -PP% | name', the card price a share of the default price."""
    default = cents()
    percent = F.col("p_partkey") % 45
    card = default - F.floor(default * percent / 100).cast("long")
    price = lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit(" "), F.lpad((c % 100).cast("string"), 2, "0"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), default.alias("default_cents"), card.alias("card_cents"), percent.alias("percent"), F.col(name).alias("name"),
        F.concat_ws(" | ", price(default), price(card), F.concat(F.lit("-"), percent.cast("string"), F.lit("%")), F.col(name)).alias("text"),
    )


OCR = """ocr0 AS (SELECT p_partkey AS part, CAST(round(p_retailprice*100) AS BIGINT) AS default_cents, p_partkey % 45 AS percent, p_name AS name FROM part),
ocr1 AS (SELECT *, default_cents - (default_cents * percent) // 100 AS card_cents FROM ocr0),
ocr AS (SELECT *, (default_cents // 100)::VARCHAR || ' ' || lpad((default_cents % 100)::VARCHAR, 2, '0') || ' | ' || (card_cents // 100)::VARCHAR || ' ' || lpad((card_cents % 100)::VARCHAR, 2, '0')
 || ' | -' || percent::VARCHAR || '% | ' || name AS text FROM ocr1)"""


def ean(number: Column) -> Column:
    """Thirteen digits from a number, the check digit wrong for every fifth."""
    from tagmill.functions.barcodes import check_digit

    twelve = F.lpad((number * 7919 + 460000000000).cast("string"), 12, "0")
    return F.concat(twelve, ((check_digit(twelve) + F.when(number % 5 == 0, 1).otherwise(0)) % 10).cast("string"))


EAN_DIGITS = "list_sum(list_transform(range(1, 13), lambda i: CAST(substr({t}, i, 1) AS BIGINT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END))"


def sql_check(t: str) -> str:
    return f"((10 - CAST({EAN_DIGITS.format(t=t)} AS BIGINT) % 10) % 10)"


EAN = f"""e0 AS (SELECT p_partkey AS n, lpad((p_partkey*7919+460000000000)::VARCHAR, 12, '0') AS twelve FROM part),
ean AS (SELECT n, twelve || (({sql_check('twelve')} + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END) % 10)::VARCHAR AS code FROM e0)"""
