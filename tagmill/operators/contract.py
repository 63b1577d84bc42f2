"""The 29-column result table: projection, fill profile, issues, header check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions.coerce import ABSENT, blank, filled, or_absent, or_empty
from tagmill.functions.prices import csv_price

# The result columns in order.
COLUMNS = [
    "filename", "product_name", "price_default", "price_card", "price_discount", "barcode", "discount_amount", "id_sku", "print_datetime", "code",
    "additional_info", "color", "special_symbols", "frame_timestamp", "x_min", "y_min", "x_max", "y_max", "qr_code_barcode",
    "price1_qr", "price2_qr", "price3_qr", "price4_qr", "wholesale_level_1_count", "wholesale_level_1_price", "wholesale_level_2_count", "wholesale_level_2_price",
    "action_price_qr", "action_code_qr",
]
ALWAYS_ABSENT = ("price_discount", "additional_info", "special_symbols")
NEVER_READ = ("id_sku", "print_datetime", "code")
SCALED = ("price_default", "price_card")
QR_PRICES = ("price1_qr", "price2_qr", "price3_qr", "price4_qr", "wholesale_level_1_price", "wholesale_level_2_price", "action_price_qr")
PROFILE = ("product_name", "price_default", "price_card", "barcode", "discount_amount", "color")

# Issue marks and their messages, in the order in which they are reported.
ISSUES = ("QR_MISSING", "PRICE_NOT_FOUND", "LOW_CONFIDENCE", "OCR_INCOMPLETE")


def result_rows(parsed: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Render parsed columns (text; any may be missing) as the result table, with the columns `keep` before it."""

    def cell(name: str) -> Column:
        if name in ALWAYS_ABSENT:
            return F.lit(ABSENT)
        if name in NEVER_READ or name not in parsed.columns:
            return F.lit(ABSENT if name == "discount_amount" else "")
        if name in SCALED or name in QR_PRICES:
            return csv_price(F.col(name), scale=name in SCALED)
        return or_absent(F.col(name)) if name == "discount_amount" else or_empty(F.col(name))

    return parsed.select(*(keep or []), *[cell(c).alias(c) for c in COLUMNS])


def fill_profile() -> list[Column]:
    """Names of the filled main fields joined by a pipe, their number, and three tests as 'True' or 'False'."""
    names = F.array_compact(F.array(*[F.when(filled(F.col(c)), c) for c in PROFILE]))
    flag = lambda test: F.when(test, "True").otherwise("False")
    return [
        F.array_join(names, "|").alias("filled_fields"),
        F.size(names).cast("long").alias("filled_count"),
        flag(filled(F.col("price_default")) & filled(F.col("price_card"))).alias("has_price_pair"),
        flag(filled(F.col("barcode"))).alias("has_barcode"),
        flag(filled(F.col("discount_amount"))).alias("has_discount"),
    ]


def filled_count() -> Column:
    """Cells that are not blank; the absence mark counts."""
    return sum((F.when(~blank(F.col(c)), 1).otherwise(0) for c in COLUMNS), F.lit(0)).cast("long")


def issues(confidence: Column, n_filled: Column) -> Column:
    tests = [~filled(F.col("barcode")) & ~filled(F.col("qr_code_barcode")), ~filled(F.col("price_default")) & ~filled(F.col("price_card")), confidence < 0.72, n_filled < 7]
    return F.array_compact(F.array(*[F.when(t, name) for t, name in zip(tests, ISSUES, strict=True)]))


def recommendation(found: Column) -> Column:
    """By the first of price, code, confidence, completeness that is an issue."""
    has = lambda name: F.array_contains(found, name)
    return F.when(has("PRICE_NOT_FOUND"), "check price").when(has("QR_MISSING"), "check code").when(has("LOW_CONFIDENCE"), "check reading").when(has("OCR_INCOMPLETE"), "check fields").otherwise("ready")


def header_check(header: list[str]) -> tuple[bool, list[str], list[str]]:
    """Whether it is the contract's header exactly; missing and extra names."""
    return header == COLUMNS, [c for c in COLUMNS if c not in header], [c for c in header if c not in COLUMNS]


def select_contract(df: DataFrame) -> DataFrame:
    """The contract's columns only, missing and null cells blank."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in COLUMNS])


