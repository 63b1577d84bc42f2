"""Coercion policies for text cells. They differ on purpose; name the one a table needs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A field that is absent on the tag; "" is a field that was there but not read.
ABSENT = "нет"
BLANKS = " \t\r\n"


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def blank(text: Column) -> Column:
    return trimmed(text) == ""


def filled(text: Column) -> Column:
    """Neither blank nor marked absent."""
    return ~blank(text) & (trimmed(text) != ABSENT)


def _number(text: Column) -> Column:
    """Plain decimal notation only: casts would also take 'nan', 'infinity' and type suffixes."""
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def or_null(text: Column) -> Column:
    """Blank, absent, nan, '-' and unreadable cells are null; decimal commas are read."""
    return _number(F.replace(trimmed(text), F.lit(","), F.lit(".")))


def or_drop(text: Column) -> Column:
    """Null where the row is to be dropped; no decimal comma."""
    return _number(trimmed(text))


def or_zero(text: Column, comma: bool = False) -> Column:
    return F.coalesce(or_null(text) if comma else or_drop(text), F.lit(0.0))


def or_minus_one(text: Column) -> Column:
    """Quotes and blanks stripped, decimal commas read, -1 for all else."""
    return F.coalesce(_number(F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\"'\s]", ""), F.lit(","), F.lit("."))), F.lit(-1.0))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\D", "")


def clean(text: Column) -> Column:
    return F.lower(trimmed(text))


def or_empty(text: Column) -> Column:
    return trimmed(text)


def or_absent(text: Column) -> Column:
    return F.when(blank(text), ABSENT).otherwise(trimmed(text))
