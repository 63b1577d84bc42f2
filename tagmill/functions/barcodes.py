"""Barcodes and QR payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagmill.functions.coerce import digits

# Payload keys of each field, the long name before the short one.
QR_FIELDS = {
    "qr_code_barcode": ("barcode", "b"),
    "price1_qr": ("price1", "p1"),
    "price2_qr": ("price2", "p2"),
    "price3_qr": ("price3", "p3"),
    "price4_qr": ("price4", "p4"),
    "wholesale_level_1_count": ("wholesaleLevel1Count", "wL1C"),
    "wholesale_level_1_price": ("wholesaleLevel1Price", "wL1P"),
    "wholesale_level_2_count": ("wholesaleLevel2Count", "wL2C"),
    "wholesale_level_2_price": ("wholesaleLevel2Price", "wL2P"),
    "action_price_qr": ("actionPrice", "aP"),
    "action_code_qr": ("actionCode", "aC"),
}


def check_digit(twelve: Column) -> Column:
    """Of the first twelve digits: the odd places once, the even ones three times."""
    weighted = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda acc, i: acc + F.substring(twelve, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return (10 - weighted % 10) % 10


def valid_ean13(text: Column) -> Column:
    d = digits(text)
    return F.when(F.length(d) == 13, check_digit(d) == F.substring(d, 13, 1).cast("int")).otherwise(False)


def best_barcode(candidates: Column) -> Column:
    """Of the distinct candidates with 8 digits or more: the first valid one, '46' before others; else the first longest; else ''."""
    distinct = F.array_distinct(F.filter(F.transform(candidates, digits), lambda c: F.length(c) >= 8))
    valid = F.filter(distinct, valid_ean13)
    at_home = F.filter(valid, lambda c: c.startswith("46"))
    longest = F.aggregate(distinct, F.lit(""), lambda acc, c: F.when(F.length(c) > F.length(acc), c).otherwise(acc))
    return F.coalesce(F.try_element_at(at_home, F.lit(1)), F.try_element_at(valid, F.lit(1)), longest)


def codes_in_text(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d{8,14})"), F.lit(1))


def barcode_from_texts(texts: Column) -> Column:
    """As best_barcode() over digit runs, but only a valid code."""
    best = best_barcode(F.flatten(F.transform(texts, codes_in_text)))
    return F.when(valid_ean13(best), best).otherwise("")


def barcode_in_text(barcode: Column, text: Column) -> Column:
    d = digits(barcode)
    return (F.length(d) >= 8) & F.contains(digits(text), d)


def _pairs_of(query: Column) -> Column:
    """Map of a query string; later values of a key win, keys without a name go."""
    parts = F.filter(F.split(query, "&"), lambda p: F.contains(p, F.lit("=")) & ~p.startswith("="))
    key = lambda p: F.try_url_decode(F.substring_index(p, "=", 1))
    value = lambda p: F.try_url_decode(F.substring(p, F.instr(p, "=") + 1, F.length(p)))
    n = F.size(parts)
    last = F.filter(F.transform(parts, lambda p, i: F.when(~F.exists(F.slice(parts, i + 2, n), lambda q: key(q) == key(p)), p)), lambda p: p.isNotNull())
    return F.map_from_arrays(F.transform(last, key), F.transform(last, value))


def qr_pairs(payload: Column) -> Column:
    """A JSON object's members; else the pairs of a URL's query, or of the payload as one."""
    raw = F.coalesce(payload, F.lit(""))
    members = F.from_json(F.when(raw.rlike(r"^\s*\{"), raw), "map<string,string>")
    inside = F.regexp_extract(raw, r"^[^?#]*\?([^#]*)", 1)
    return F.when(F.size(members) > 0, members).otherwise(_pairs_of(F.when(inside != "", inside).otherwise(raw)))


def qr_fields(pairs: Column) -> list[Column]:
    """The eleven target fields, null where no alias holds a value."""
    value = lambda k: F.nullif(F.btrim(F.try_element_at(pairs, F.lit(k))), F.lit(""))
    return [F.coalesce(*[value(k) for k in aliases]).alias(field) for field, aliases in QR_FIELDS.items()]


def merge_first(maps: Column) -> Column:
    """Merge an array of maps, the first value of a key wins."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.aggregate(maps, empty, lambda acc, m: F.map_concat(acc, F.map_filter(m, lambda k, _: ~F.map_contains_key(acc, k))))


def decoded_strings(nested: Column) -> Column:
    """Payloads of several decoders as one list, in order, without blank ones."""
    return F.filter(F.transform(F.flatten(F.filter(nested, lambda x: x.isNotNull())), lambda s: F.btrim(s)), lambda s: s != "")
