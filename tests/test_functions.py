"""Column helpers against literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from tagmill.functions import barcodes, coerce, geometry, prices, text
from tagmill.functions.geometry import Box
from tagmill.operators import contract


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


def test_default_from_card_and_discount(spark):
    assert abs(value(spark, prices.infer_default(lit(305), lit(16))) - 363) <= 5
    assert value(spark, prices.infer_default(lit(305), lit(50))) is None


@pytest.mark.parametrize(("label", "percent"), [("скидка -23%", 23), ("-3%", None), ("°", None), ("16°", 16), ("no", None), ("- 12 x", 12)])
def test_discount(spark, label, percent):
    assert value(spark, prices.discount(lit(label))) == percent


@pytest.mark.parametrize(("label", "percent"), [("23", 23), ("скид 16", 16), ("77 24 9", 24), ("77 9", 77), ("", None)])
def test_zone_discount(spark, label, percent):
    assert value(spark, prices.zone_discount(lit(label))) == percent


def test_parse_text(spark):
    one = value(spark, prices.parse_text(lit("305 | 99 | -16% | карта")))
    assert one.price_card == "3.05" and one.discount_amount == "-16%" and one.price_default_inferred and float(one.price_default) > 3.05
    assert one.price_default == "3.63"
    two = value(spark, prices.parse_text(lit("368 99 | 305 99 | 16%")))
    assert two.price_card == "3.05" and float(two.price_default) >= 3.5
    none = value(spark, prices.parse_text(lit("")))
    assert (none.product_name, none.price_default, none.price_card) == ("", "", "")
    assert value(spark, prices.parse_text(lit("Молоко топлёное | 12.05.2024 | 3 шт в упаковке"))).product_name == "Молоко топлёное"


def test_refine(spark):
    default, inferred = prices.refine(lit(305), lit(305), lit(16))
    assert value(spark, inferred) is True and value(spark, default) > 305
    default, inferred = prices.refine(lit(305), lit(363), lit(16))
    assert value(spark, inferred) is False and value(spark, default) == 363


@pytest.mark.parametrize(("cents", "shown"), [(305, "3.05"), (350, "3.5"), (300, "3.0"), (5, "0.05")])
def test_plain(spark, cents, shown):
    assert value(spark, prices.plain(lit(cents))) == shown


@pytest.mark.parametrize(("cell", "scaled", "plain"), [("3.05", "305,00", "3,05"), ("89,99", "89,99", "89,99"), ("", "", ""), ("нет", "нет", "нет"), ("0", "0,00", "0,00"), (None, "", "")])
def test_csv_price(spark, cell, scaled, plain):
    assert value(spark, prices.csv_price(lit(cell).cast("string"))) == scaled
    assert value(spark, prices.csv_price(lit(cell).cast("string"), scale=False)) == plain


@pytest.mark.parametrize(("a", "b", "same"), [("3.05", "305.99", True), ("", "нет", True), ("", "3", False), ("100", "400", False), ("100", "120", True), ("100", "101,5", True), ("nan", None, True)])
def test_prices_match(spark, a, b, same):
    assert value(spark, prices.prices_match(lit(a).cast("string"), lit(b).cast("string"))) is same


@pytest.mark.parametrize(("a", "b", "same"), [("-23%", "- 24 %", True), ("-23%", "26", False), ("нет", "нет", True), ("", "нет", True), ("5", "", False), ("a", "A", True)])
def test_discounts_match(spark, a, b, same):
    assert value(spark, prices.discounts_match(lit(a), lit(b))) is same


def test_zone_candidates(spark):
    assert value(spark, prices.zone_candidates(lit("234"))) == [23499, 23400]
    assert 23499 in value(spark, prices.zone_candidates(lit("234 99")))
    assert value(spark, prices.zone_candidates(lit("12"))) == []


@pytest.mark.parametrize(("code", "valid"), [("4006381333931", True), ("4006381333932", False), ("400638133393", False), ("400-6381333931", True), (None, False)])
def test_ean13(spark, code, valid):
    assert value(spark, barcodes.valid_ean13(lit(code).cast("string"))) is valid


def test_best_barcode(spark):
    best = lambda *codes: value(spark, barcodes.best_barcode(F.array(*map(lit, codes))))
    assert best("4006381333931", "4600000000008") in ("4600000000008", "4006381333931")
    assert best("12345678", "123456789") == "123456789" and best("1234567") == "" and best("x4006381333931", "99999999999999") == "4006381333931"
    assert value(spark, barcodes.barcode_from_texts(F.array(lit("id 4006381333931 x")))) == "4006381333931"
    assert value(spark, barcodes.barcode_from_texts(F.array(lit("id 4006381333932 x")))) == ""


def test_qr_payloads(spark):
    def fields(payload):
        df = spark.range(1).select(barcodes.qr_pairs(lit(payload)).alias("m"))
        return df.select(*barcodes.qr_fields(F.col("m"))).first()

    assert fields('{"price1": 12.5, "p2": "7"}').price1_qr == "12.5" and fields('{"p2": "7"}').price2_qr == "7"
    got = fields("https://x.example/a?b=46&p1=1&p1=2&aC=%D0%B0#frag")
    assert (got.qr_code_barcode, got.price1_qr, got.action_code_qr) == ("46", "2", "а")
    assert fields("barcode=1&b=2").qr_code_barcode == "1" and fields("barcode=&b=2").qr_code_barcode == "2"
    assert fields("").price1_qr is None


def test_coercions_differ(spark):
    cells = ["1.5", "1,5", "нет", "", "nan", "x", None, '"2"', "inf"]
    got = lambda f: [value(spark, f(lit(c).cast("string"))) for c in cells]
    assert got(coerce.or_drop) == [1.5, None, None, None, None, None, None, None, None]
    assert got(coerce.or_null) == [1.5, 1.5, None, None, None, None, None, None, None]
    assert got(coerce.or_zero) == [1.5, 0, 0, 0, 0, 0, 0, 0, 0]
    assert got(coerce.or_minus_one) == [1.5, 1.5, -1, -1, -1, -1, -1, 2, -1]
    assert got(coerce.or_absent) == ["1.5", "1,5", "нет", "нет", "nan", "x", "нет", '"2"', "inf"]


def test_boxes(spark):
    a, b = Box(*map(lit, (0, 0, 10, 10))), Box(*map(lit, (5, 0, 15, 10)))
    assert abs(value(spark, geometry.iou(a, b)) - 1 / 3) < 1e-12 and value(spark, geometry.iou(a, a)) == 1
    assert value(spark, geometry.iou_at_least(a, b, 1, 3)) is True and value(spark, geometry.iou_at_least(a, b, 34, 100)) is False
    assert value(spark, geometry.center_distance(a, b)) == 5 and value(spark, geometry.doubled_center_distance_squared(a, b)) == 100
    assert value(spark, geometry.diagonal(lit(3), lit(4))) == 5 and value(spark, geometry.diagonal(lit(None).cast("int"), lit(4))) == 1
    assert tuple(value(spark, geometry.clip_pad(Box(*map(lit, (1.5, 2.5, 8.2, 9.9))), lit(10), lit(10), lit(2)))) == (0, 0, 10, 10)
    assert value(spark, geometry.yolo_line(lit(0), geometry.yolo_box(a, lit(20), lit(20)))) == "0 0.250000 0.250000 0.500000 0.500000"
    assert value(spark, geometry.yolo_box(Box(*map(lit, (0, 0, 1, 10))), lit(20), lit(20))) is None
    assert [tuple(t) for t in value(spark, geometry.tiles(lit(700).cast("long"), lit(320).cast("long"), 320, 240))] == [(0, 0), (240, 0), (380, 0)]
    assert tuple(value(spark, geometry.roi_pixels(lit(100), lit(50), 0.1, 0.1, 0.5, 0.5))) == (10, 5, 50, 25)  # 2.5 and 12.5 would round to even
    assert value(spark, geometry.fraction(lit("30000/1001"))) == 30000 / 1001 and value(spark, geometry.fraction(lit("1/0"))) == 0
    assert value(spark, geometry.frame_number(lit("f00_12"))) == 12 and value(spark, geometry.frame_number(lit("x"))) == 0
    assert value(spark, geometry.track_score(lit(2.0), lit(9.0))) == 6 and math.isclose(value(spark, geometry.blob_confidence(lit(1e9), lit(1), lit(1))), 0.99)


def test_texts(spark):
    assert value(spark, text.normalize(lit("  A \n b 1,5 "))) == "a b 1.5"
    assert value(spark, text.similarity(lit("abcd"), lit("abxd"))) == 0.75
    assert value(spark, text.similarity(lit(""), lit(None).cast("string"))) == 1 and value(spark, text.similarity(lit(""), lit(""), blank_equal=False)) == 0
    assert value(spark, text.source_name(lit("a/b/43_15-2 x.mp4"))) == "43_15-2" and value(spark, text.source_name(lit("plain"))) == "plain"
    assert value(spark, text.label_source(lit("t__materials_data_43_15_000001_abc"))) == "43_15"
    assert value(spark, text.label_source(lit("materials_data_43_15_43_15_000001_abc"))) == "43_15"
    assert value(spark, text.safe_stem(lit("d/имя 1!.mp4"))) == "имя_1_" and value(spark, text.frame_id(lit("a_000042_x"))) == 42
    assert value(spark, text.name_from_lines(lit("12 345 | Сыр твёрдый | цена 12"))) == "Сыр твёрдый"
    assert value(spark, text.text_valid(lit("ab"), "abc")) is True and value(spark, text.text_valid(lit("ad"), "abc")) is False
    lines = F.array(*[F.struct(lit(t).alias("text"), lit(x).alias("cx"), lit(y).alias("cy")) for t, x, y in (("b", 2, 0), ("a", 1, 9), ("", 0, 0))])
    assert value(spark, text.pipe_text(lines)) == "a | b"


def test_contract(spark):
    assert len(contract.COLUMNS) == 29
    assert contract.header_check(contract.COLUMNS) == (True, [], [])
    assert contract.header_check(["filename", "x"])[2] == ["x"]
    row = contract.result_rows(spark.createDataFrame([("a", None, "3.05")], "product_name string, barcode string, price_card string")).first()
    assert (row.product_name, row.barcode, row.price_card, row.discount_amount, row.price_discount, row.id_sku) == ("a", "", "305,00", "нет", "нет", "")
    df = contract.result_rows(spark.createDataFrame([("a",)], "product_name string")).withColumn("n", contract.filled_count()).withColumn("i", contract.issues(F.lit(0.5), F.col("n")))
    got = df.select("n", "i", contract.recommendation(F.col("i")).alias("r")).first()
    assert got.n == 5 and got.i == list(contract.ISSUES) and got.r == "check price"


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "from tagmill.plans import registry as r; assert set(r.oracle_sql()) <= set(r.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=repo, check=True, timeout=100)
