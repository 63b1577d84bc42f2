"""Text columns: normal forms, validity, similarity, names of sources and files."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tagmill.functions.coerce import trimmed


def normalize(text: Column) -> Column:
    """Single blanks, lower case, decimal points."""
    return F.regexp_replace(F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))), r"(\d),(\d)", "$1.$2")


def text_valid(text: Column, allowed: str, longest: int = 25) -> Column:
    """Not blank, not too long, and only characters of the dictionary (blank always allowed)."""
    return ~(trimmed(text) == "") & (F.length(text) <= longest) & (F.translate(text, allowed + " ", "") == "")


def readable(name: Column, default: Column, card: Column, raw: Column) -> Column:
    """Some raw text, and a name of 3 characters with under 55 % digits or any price."""
    n = trimmed(name)
    n_digits = F.length(n) - F.length(F.regexp_replace(n, r"\d", ""))
    has_name = (F.length(n) >= 3) & (n_digits * 100 < F.length(n) * 55)
    return (trimmed(raw) != "") & (has_name | (trimmed(default) != "") | (trimmed(card) != ""))


def fail_reason(name: Column, default: Column, card: Column, raw: Column) -> Column:
    no_name, no_price = F.length(trimmed(name)) < 3, (trimmed(default) == "") & (trimmed(card) == "")
    return F.when(trimmed(raw) == "", "empty_ocr").when(no_name & no_price, "no_name_and_no_price").when(no_name, "no_name").otherwise("no_price")


def source_name(value: Column) -> Column:
    """The stem of a path, or of it the recording number dd_d[d][-d[d]]."""
    path = F.btrim(F.replace(value, F.lit("\\"), F.lit("/")))
    base = F.element_at(F.split(path, "/"), -1)
    stem = F.when(base.rlike(r"^.+\.[^.]*$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    number = F.regexp_extract(stem, r"(\d{2}_\d{1,2}(?:-\d{1,2})?)", 1)
    return F.when(number != "", number).otherwise(stem)


def label_source(stem: Column) -> Column:
    """Source of a label file: tag__ and materials_data_ prefixes, the trailing frame and hash, and a doubled number go."""
    bare = F.regexp_replace(F.regexp_replace(stem, r"^.*?__", ""), r"^materials_data_", "")
    raw = F.regexp_replace(bare, r"^(.*)_[^_]*_[^_]*$", "$1")
    return source_name(F.regexp_replace(raw, r"^([^_]+_[^_]+)_\1.*$", "$1"))


def safe_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), r"(?U)[^\w.-]", "_")


def frame_id(name: Column) -> Column:
    return F.regexp_extract(name, r"_(\d{6})_", 1).try_cast("long")


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def unique_file_name(source: Column, frame: Column, path: Column) -> Column:
    """source_frame_hash, the hash over path and frame."""
    return F.concat_ws("_", source, F.lpad(frame.cast("string"), 6, "0"), F.substring(F.sha1(F.concat_ws(":", path, frame.cast("string"))), 1, 10))


def _ratio(left: pd.Series, right: pd.Series, one_blank: float, both_blank: float) -> pd.Series:
    def one(a: str | None, b: str | None) -> float:
        a, b = a or "", b or ""
        if not a or not b:
            return both_blank if not a and not b else one_blank
        return SequenceMatcher(None, a, b).ratio()

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)])


@F.pandas_udf(DoubleType())
def _similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return _ratio(left, right, 0.0, 1.0)


@F.pandas_udf(DoubleType())
def _similarity_strict(left: pd.Series, right: pd.Series) -> pd.Series:
    return _ratio(left, right, 0.0, 0.0)


def similarity(left: Column, right: Column, blank_equal: bool = True) -> Column:
    """Ratcliff-Obershelp ratio of normalised texts. There is no built-in for it and edit distance differs, so this runs in Python."""
    return (_similarity if blank_equal else _similarity_strict)(normalize(left), normalize(right))


def pipe_text(lines: Column) -> Column:
    """Recognised lines (text, cx, cy) in the order of (cx, cy), joined by ' | '; lines without a place are dropped."""
    placed = F.filter(lines, lambda x: x["cx"].isNotNull() & x["cy"].isNotNull() & (trimmed(x["text"]) != ""))
    ordered = F.array_sort(F.transform(placed, lambda x: F.struct(x["cx"].alias("cx"), x["cy"].alias("cy"), x["text"].alias("text"))))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), " | ")


def name_from_lines(text: Column) -> Column:
    """The line with most letters (a quarter point for each character, three quarters off for each digit), without price words."""
    from tagmill.functions.prices import as_digits

    # Words of price labels.
    stop = "руб|шт|скид|цена"
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[|\n]"), trimmed), lambda x: F.length(x) >= 3)
    n_digits = lambda x: F.length(as_digits(x)) - F.length(F.regexp_replace(as_digits(x), r"(?U)\d", ""))
    letters = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)\p{IsAlphabetic}", ""))
    fit = F.filter(lines, lambda x: (n_digits(x) * 2 < F.length(x)) & ~F.lower(x).rlike(stop))
    scored = F.transform(fit, lambda x: F.struct((letters(x) * 4 + F.length(x) - n_digits(x) * 3).alias("score"), x.alias("line")))
    start = F.struct(F.lit(-4).alias("score"), F.lit("").alias("line"))
    return F.aggregate(scored, start, lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc), lambda acc: acc["line"])


def result_text(result: Column) -> Column:
    """All lines of a recognition result given as JSON, joined by blanks.

    The result is a list.  An object gives rec_texts, else rec_text (a list or one text), else the first item of each list
    in rec_res, else every text or list of texts under a key with 'text' or 'rec' in its name.  A list is of pairs (place,
    [text, score]).  Anything else, JSON that can't be read included, gives no text; a text that itself begins with '[' and
    is a JSON list is read as a list.
    """
    none = F.array().cast("array<string>")
    items = lambda j: F.coalesce(F.from_json(F.when(j.startswith("["), j), "array<string>"), none)
    of_value = lambda v: F.when(v.startswith("["), items(v)).when(F.coalesce(v, F.lit("")) != "", F.array(v)).otherwise(none)
    first_of = lambda rows: F.transform(F.filter(rows, lambda r: r.startswith("[")), lambda r: F.get(items(r), F.lit(0)))

    def of_object(j: Column) -> Column:
        fields = F.from_json(j, "map<string,string>")
        at = lambda k: F.try_element_at(fields, F.lit(k))
        has = lambda k: F.map_contains_key(fields, k)
        named = F.map_values(F.map_filter(fields, lambda k, _: F.lower(k).rlike("text|rec")))
        return F.when(has("rec_texts"), of_value(at("rec_texts"))).when(has("rec_text"), of_value(at("rec_text"))).when(has("rec_res"), first_of(items(at("rec_res")))).otherwise(F.flatten(F.transform(named, of_value)))

    def of_pairs(j: Column) -> Column:
        pairs = F.filter(F.transform(items(j), items), lambda p: F.size(p) == 2)
        return first_of(F.transform(pairs, lambda p: p[1]))

    parts = F.transform(items(F.btrim(result)), lambda j: F.when(j.startswith("{"), of_object(j)).otherwise(of_pairs(j)))
    return F.array_join(F.flatten(F.filter(parts, lambda p: p.isNotNull())), " ")


def best_variant(texts: Column) -> Column:
    """The text with most characters, digits counting 1.3; the first of equals, blank without any."""
    score = lambda t: F.length(t) * 10 + (F.length(t) - F.length(F.regexp_replace(t, r"\d", ""))) * 3
    scored = F.transform(F.filter(texts, lambda t: t.isNotNull()), lambda t: F.struct(score(t).alias("score"), t.alias("text")))
    start = F.struct(F.lit(-1).alias("score"), F.lit("").alias("text"))
    return F.aggregate(scored, start, lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc), lambda acc: acc["text"])


def pseudo_label(line: Column, score: Column, truths: Column) -> Column:
    """A line read with a score over 0.8 that holds a true text or is part of one; the line in upper case, truths as they are."""
    upper = F.upper(line)
    return F.exists(truths, lambda t: F.contains(t, upper) | F.contains(upper, t)) & (score > 0.8)


def lines_json(lines: Column) -> Column:
    return F.to_json(lines)
