"""Prices and discounts read from recognised text. Amounts are whole cents; text is made only at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagmill.functions.coerce import ABSENT, trimmed

# Characters that recognition confuses with digits, and the digits they stand for.
CONFUSED = "ОоOoQDЗзБбВвBІіIl|ГгЧчSsGgTt"
MEANT = "0000003366888111114444556977"
# The patterns that readings depend on, applied after CONFUSED is translated.
LONG_RUN = r"\b\d{6,14}\b"
DATE = r"\b\d{1,2}[./-]\d{1,2}(?:[./-]\d{2,4})?\b"
PRICE_TOKEN = r"\b(\d{2,4})\b"
PRICE_AND_CENTS = r"\b(\d{2,4})\s*[^\d]{0,4}(\d{2})\b"
PRICE_POINT_CENTS = r"\b(\d{1,4})[.,](\d{2})\b"
SIGNED_PERCENT = r"[-−]?\s*(\d{1,2})\s*[%°‰¢]"
AFTER_MINUS = r"[-−]\s*(\d{1,2})(?:\D|$)"
LONE_NUMBER = r"\b(\d{1,2})\b"
# Usual discount steps, the likeliest first.
USUAL_DISCOUNTS = (36, 30, 25, 24, 23, 21, 19, 16, 15, 14, 13, 11)
LEAST, MOST = 50, 999_999
DISCOUNT_LEAST, DISCOUNT_INFER, DISCOUNT_MOST = 5, 40, 80
TOLERANCE_PERCENT = 12


def as_digits(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), CONFUSED, MEANT)


def price_context(text: Column) -> Column:
    """Without runs of 6 to 14 digits and tokens that look like dates."""
    return F.regexp_replace(F.regexp_replace(text, "(?U)" + LONG_RUN, " "), "(?U)" + DATE, " ")


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))


def _pairs(text: Column, pattern: str) -> Column:
    return F.zip_with(_all(text, pattern, 1), _all(text, pattern, 2), lambda whole, cents: whole.cast("long") * 100 + cents.cast("long"))


def prices(text: Column) -> Column:
    """Distinct prices in cents, the highest first."""
    norm = price_context(as_digits(text))
    tokens = _all(norm, PRICE_TOKEN)
    alone = F.transform(F.filter(tokens, lambda t: F.length(t) >= 3), lambda t: t.cast("long"))
    neighbours = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda t, after: F.when(F.length(after) == 2, t.cast("long") * 100 + after.cast("long")))
    found = F.concat(_pairs(norm, PRICE_AND_CENTS), _pairs(norm, PRICE_POINT_CENTS), alone, neighbours)
    return F.sort_array(F.array_distinct(F.filter(found, lambda p: p.isNotNull() & p.between(LEAST, MOST))), asc=False)


def _first_discount(found: Column) -> Column:
    fits = F.filter(F.transform(found, lambda d: d.cast("long")), lambda d: d.between(DISCOUNT_LEAST, DISCOUNT_MOST))
    return F.try_element_at(fits, F.lit(1))


def discount(text: Column) -> Column:
    """Percent with its sign, or else a number after a minus; null if none is from 5 to 80."""
    norm = as_digits(text)
    return F.coalesce(_first_discount(_all(norm, SIGNED_PERCENT)), _first_discount(_all(norm, AFTER_MINUS)))


def zone_discount(text: Column) -> Column:
    """As discount(); failing that any number from 5 to 80, a usual step before the largest."""
    lone = F.filter(F.transform(_all(as_digits(text), LONE_NUMBER), lambda d: d.cast("long")), lambda d: d.between(DISCOUNT_LEAST, DISCOUNT_MOST))
    usual = F.try_element_at(F.filter(F.array(*[F.lit(d).cast("long") for d in USUAL_DISCOUNTS]), lambda d: F.array_contains(lone, d)), F.lit(1))
    return F.coalesce(discount(text), usual, F.array_max(lone))


def clamp_discount(percent: Column) -> Column:
    return F.when(percent.between(DISCOUNT_LEAST, DISCOUNT_INFER), percent)


def infer_default(card: Column, percent: Column) -> Column:
    """Price before a discount of 5 to 40 percent, rounded to a cent."""
    left = 100 - percent
    value = F.floor((card * 200 + left) / (left * 2)).cast("long")
    return F.when(percent.between(DISCOUNT_LEAST, DISCOUNT_INFER) & value.between(LEAST, MOST), value)


def consistent(card: Column, default: Column, percent: Column) -> Column:
    expected = infer_default(card, percent)
    return F.coalesce(F.abs(default - expected) * 100 <= expected * TOLERANCE_PERCENT, F.lit(False))


def refine(card: Column, default: Column, percent: Column) -> tuple[Column, Column]:
    """Default price and whether it was inferred: where it is missing, not above the card price, or inconsistent."""
    return refine_with(card, default, infer_default(card, percent))


def refine_with(card: Column, default: Column, inferred: Column) -> tuple[Column, Column]:
    agrees = F.abs(default - inferred) * 100 <= inferred * TOLERANCE_PERCENT
    use = inferred.isNotNull() & (default.isNull() | (default <= card + 1) | ~agrees)
    return F.when(use, inferred).otherwise(default), F.coalesce(use, F.lit(False))


def plain(cents: Column) -> Column:
    """305 as 3.05, 350 as 3.5, 300 as 3.0."""
    rest = cents % 100
    tail = F.when(rest % 10 == 0, (rest / 10).cast("int").cast("string")).otherwise(F.lpad(rest.cast("string"), 2, "0"))
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), tail)


def comma(cents: Column) -> Column:
    return F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))


def cents_of(text: Column) -> Column:
    """A non-negative number as text, with point or comma, in whole cents; null for all else."""
    norm = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", ""), F.lit(","), F.lit("."))
    return F.when(norm.rlike(r"^\d+(\.\d*)?$|^\.\d+$"), F.round(norm.try_cast("decimal(18,6)") * 100).cast("long"))


def scaled(cents: Column) -> Column:
    """A price under 50 is a display in hundredths."""
    return F.when((cents > 0) & (cents < 5000), cents * 100).otherwise(cents)


def csv_price(text: Column, scale: bool = True) -> Column:
    """Two decimals and a comma; blank stays blank, other text stays as it is without blanks."""
    raw = F.regexp_replace(trimmed(text), " ", "")
    cents = cents_of(text)
    return F.when(raw == "", "").when(cents.isNull(), F.replace(raw, F.lit(","), F.lit("."))).otherwise(comma(scaled(cents) if scale else cents))


def price_or_minus_one(text: Column) -> Column:
    """In cents; -1 for blank, absent, nan and unreadable."""
    return F.coalesce(cents_of(text), F.lit(-1).cast("long"))


def _distinct_by(values: Column, least_gap: int) -> Column:
    """First of values nearer to each other than least_gap."""
    empty = F.filter(values, lambda _: F.lit(False))
    return F.aggregate(values, empty, lambda acc, v: F.when(F.exists(acc, lambda u: F.abs(u - v) < least_gap), acc).otherwise(F.array_append(acc, v)))


def price_readings(cents: Column) -> Column:
    """What a price may mean: itself; below 50 also hundredfold, plain and with .99; above 50 also a hundredth."""
    hundred = cents * 100
    options = F.array(cents, F.when(cents < 5000, hundred), F.when(cents < 5000, hundred + 99 - hundred % 100), F.when(cents > 5000, F.floor((cents + 50) / 100).cast("long")))
    return F.when(cents < 0, F.array().cast("array<bigint>")).otherwise(_distinct_by(F.array_compact(options), 2))


def prices_match(left: Column, right: Column, tolerance: int = 200) -> Column:
    """Equal within tolerance (cents) in some reading of either; two missing prices match, one does not."""
    a, b = price_or_minus_one(left), price_or_minus_one(right)
    near = F.exists(price_readings(a), lambda x: F.exists(price_readings(b), lambda y: F.abs(x - y) <= tolerance))
    return F.when((a < 0) & (b < 0), True).when((a < 0) | (b < 0), False).otherwise(near)


def first_percent(text: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), " ", ""), r"(\d{1,2})", 1).try_cast("long")


def discounts_match(left: Column, right: Column) -> Column:
    """Whole percents within 2; an absent right side needs an absent left; other text must be equal when normalised."""
    from tagmill.functions.text import normalize

    bare = lambda c: F.replace(F.ltrim(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")), F.lit("-")), F.lit("%"), F.lit(""))
    p, g = bare(left), bare(right)
    none = lambda c: (c == "") | (c == ABSENT)
    both = p.try_cast("long").isNotNull() & g.try_cast("long").isNotNull()
    return F.when(none(g), none(p)).when(p == "", False).when(both, F.abs(p.try_cast("long") - g.try_cast("long")) <= 2).otherwise(normalize(left) == normalize(right))


def zone_candidates(text: Column) -> Column:
    """Weak readings of a large shelf price, in cents: 234 as 234.99 and 234; 2349 also as 234.9; 234 99 as 234.99."""
    norm = as_digits(text)
    edge = r"(?<![A-Za-zА-Яа-я0-9])(%s)(?![A-Za-zА-Яа-я0-9])"
    numbers, short = (F.regexp_extract_all(norm, F.lit(edge % p), F.lit(1)) for p in (r"\d{1,9}", r"\d{2,4}"))
    split = lambda t: F.when((F.length(t) == 4) & F.substring(t, 1, 3).cast("long").between(50, 999), F.substring(t, 1, 3).cast("long") * 100 + F.substring(t, 4, 1).cast("long"))
    single = F.flatten(F.transform(short, lambda t: F.array(F.when(t.cast("long").between(50, 9999), t.cast("long") * 100 + 99), F.when(t.cast("long").between(50, 9999), t.cast("long") * 100), split(t))))
    pair = F.zip_with(numbers, F.slice(numbers, 2, F.greatest(F.size(numbers), F.lit(1))), lambda a, b: F.when(F.length(a).between(2, 3) & (F.length(b) == 2) & a.cast("long").between(50, 999), a.cast("long") * 100 + b.cast("long")))
    return _distinct_by(F.filter(F.concat(single, pair), lambda v: v.isNotNull() & v.between(5000, 999_900)), 2)


def product_name(text: Column) -> Column:
    """The longest line (first of equals) over 3 characters with under half digits, no date, no piece mark, not only figures."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), trimmed), lambda x: x != "")

    def named(line: Column) -> Column:
        norm = as_digits(line)
        n_digits = F.length(norm) - F.length(F.regexp_replace(norm, r"(?U)\d", ""))
        return (F.length(line) > 3) & (n_digits * 2 < F.length(line)) & ~norm.rlike(r"\d{2}\.\d{2}\.\d{4}") & ~F.contains(F.lower(line), F.lit("шт")) & ~norm.rlike(r"^[\d\s.,\-+%]+$")

    best = F.aggregate(F.filter(lines, named), F.lit(""), lambda acc, x: F.when(F.length(x) > F.length(acc), x).otherwise(acc))
    return best


def parse_text(text: Column) -> Column:
    """Whole recognised text to name, prices and discount."""
    # Bound once: each reading is an expression of some size that would else be repeated in every field.
    read = F.struct(prices(text).alias("found"), discount(text).alias("percent"), product_name(text).alias("name"))

    def fields(r: Column) -> Column:
        n = F.size(r["found"])
        card = F.when(n >= 1, F.element_at(r["found"], -1))
        first = F.when(n >= 2, F.element_at(r["found"], 1))
        return F.struct(r["name"].alias("name"), r["percent"].alias("percent"), card.alias("card"), first.alias("first"), infer_default(card, r["percent"]).alias("inferred"))

    def chosen(r: Column) -> Column:
        default, used = refine_with(r["card"], r["first"], r["inferred"])
        return F.struct(
            r["name"].alias("product_name"),
            F.coalesce(plain(F.coalesce(default, r["card"])), F.lit("")).alias("price_default"),
            F.coalesce(plain(r["card"]), F.lit("")).alias("price_card"),
            F.coalesce(F.concat(F.lit("-"), r["percent"].cast("string"), F.lit("%")), F.lit("")).alias("discount_amount"),
            used.alias("price_default_inferred"),
        )

    return F.transform(F.transform(F.array(read), fields), chosen)[0]


def display_line(default: Column, card: Column, raw: Column) -> Column:
    """Prices in cents without a point, distinct, or else the first six numbers of the raw text."""
    shown = F.array_compact(F.array(*[F.when(c >= 100, c.cast("string")) for c in (cents_of(default), cents_of(card))]))
    numbers = F.slice(_all(as_digits(raw), r"\b(\d{2,4})\b"), 1, 6)
    return F.when(F.size(shown) > 0, F.array_join(F.array_distinct(shown), " ")).otherwise(F.array_join(numbers, " "))
