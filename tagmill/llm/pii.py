"""Personal data in whole texts, with DataFrame functions only.

A regular expression for each kind proposes spans, leftmost and without overlap;
a validator confirms them (Luhn for cards, mod-97 for IBANs, ranges and digit
counts for the others), and words nearby adjust the score.  Kinds of the base
(email, ip, card, phone) are reported whatever their score; IBANs and social
security numbers are added where their score reaches ``THRESHOLD``, which the
latter only do beside a word of their own.

Places: splitting a text by a pattern gives what lies between the matches, so a
match starts where the pieces and matches before it end; running sums are taken
in chunks, so a text with very many matches costs little more than its length.
Patterns take runs possessively and begin where a run begins (or where the match
before ended), which finds what the plain patterns find, but in one pass over any
text and without recursion.  A row is worked on by itself: nothing is shuffled.

Results for odd input: null and empty texts have no spans (counts of zero, the
hash of the empty string); rows with equal doc_id or equal text are each reported;
a null doc_id stays; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on each side of a span in which words are looked for.
NEARBY = 40
#: What a nearby word adds to a score, and the score from which a span of the added kinds is reported.
BONUS, THRESHOLD = 30, 60
#: Running sums are taken in chunks of this many matches.
CHUNK = 256


@dataclass(frozen=True)
class Kind:
    """`plain` finds what `pattern` finds; it is the pattern as stated, for engines whose matching is linear anyway.

    A text without `hint` (a plain string, or a pattern that begins with few characters) has no span that could be confirmed.
    """

    name: str
    hint: str
    pattern: str
    plain: str
    prior: int
    words: str
    base: bool
    valid: Callable[[Column], Column]


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check; `number` is short."""
    back = F.reverse(number)
    value = lambda i: F.ascii(F.substring(back, i + 1, F.lit(1))) - 48
    doubled = lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda total, i: total + doubled(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether a string of capitals and digits passes the check of an IBAN; `iban` is short and has more than four characters."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban) - 4), F.substring(iban, 1, 4))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    step = lambda rest, i: F.when(code(i) < 58, (rest * 10 + code(i) - 48) % 97).otherwise((rest * 100 + code(i) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(iban)), F.lit(0), step) == 1


def _ip(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _card(match: Column) -> Column:
    return F.when(F.length(digits(match)).between(14, 19), luhn(digits(match))).otherwise(False)


def _iban(match: Column) -> Column:
    compact = F.replace(match, F.lit(" "))
    return F.when(F.length(compact).between(15, 34), mod97(compact)).otherwise(False)


def _ssn(match: Column) -> Column:
    return ~match.rlike("^(?:000|666|9)|-00-|0000$")


# The stated patterns of the base kinds (`plain`).
KINDS = (
    Kind("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 90, "e-?mail|mail|mailto|contact", True, lambda m: F.lit(True)),
    Kind("ip", r"\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 60, "ip|host|server|address|login", True, _ip),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9](?:[\x20-]?[0-9])++",
         r"[0-9]([\x20-]?[0-9])+", 70, "card|credit|debit|visa|mastercard|payment", True, _card),
    Kind("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]",
         r"\+[0-9][\x20().0-9-]+[0-9]", 60, "phone|tel|call|mobile|fax", True, lambda m: F.length(digits(m)).between(10, 15)),
    Kind("iban", "[A-Z][A-Z][0-9][0-9]", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 80, "iban|bank|account|transfer", False, _iban),
    Kind("ssn", "[0-9]-[0-9][0-9]-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "", 30, "ssn|social|security", False, _ssn),
)


def _by_kind(number: Column, pick: Callable[[Kind], Column]) -> Column:
    first, *rest = enumerate(KINDS)
    chosen = F.when(number == first[0], pick(first[1]))
    for k, kind in rest:
        chosen = chosen.when(number == k, pick(kind))
    return chosen


def _running(values: Column) -> Column:
    """Inclusive running sums of an array of longs; `values` must be cheap to repeat, as a lambda's variable is."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("sums"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["total"] + x).alias("total"), F.concat(acc["sums"], F.array(acc["total"] + x)).alias("sums"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda k: F.slice(values, k * CHUNK + 1, CHUNK))
    inner = F.transform(chunks, lambda c: F.aggregate(c, start, add))
    carried = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<array<long>>").alias("sums"))

    def chain(acc: Column, c: Column) -> Column:
        lifted = F.transform(c["sums"], lambda v: v + acc["total"])
        return F.struct((acc["total"] + c["total"]).alias("total"), F.concat(acc["sums"], F.array(lifted)).alias("sums"))

    return F.flatten(F.aggregate(inner, carried, chain)["sums"])


def _once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    # explode(array(x)) computes x once: the optimizer doesn't copy it into what follows.
    return df.select(*keep, F.explode(F.array(value)).alias(name))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and `found`: an array of (start, kind number, kind, end, score), by start, then kind as listed; ends are exclusive."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def proposed(number: int, kind: Kind) -> Column:
        made = F.struct(F.lit(number).alias("number"), F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("matches"))
        return F.when(F.contains(text, F.lit(kind.hint)) if len(kind.hint) == 1 else text.rlike(kind.hint), made)

    df = _once(docs.select("doc_id", "text"), "kinds", F.array_compact(F.array(*[proposed(k, kind) for k, kind in enumerate(KINDS)])), "doc_id")
    # From one match's start to the next: the match and the piece after it.
    steps = lambda k: F.transform(k["pieces"], lambda p, i: (F.length(p) + F.coalesce(F.length(F.get(k["matches"], i - 1)), F.lit(0))).cast("long"))
    df = _once(df, "kinds", F.transform("kinds", lambda k: F.struct(k["number"].alias("number"), k["pieces"].alias("pieces"), k["matches"].alias("matches"), steps(k).alias("steps"))), "doc_id")
    df = _once(df, "kinds", F.transform("kinds", lambda k: F.struct(k["number"].alias("number"), k["pieces"].alias("pieces"), k["matches"].alias("matches"), _running(k["steps"]).alias("starts"))), "doc_id")

    def placed(k: Column) -> Column:
        around = lambda i: F.concat(F.right(F.get(k["pieces"], i), F.lit(NEARBY)), F.lit(" "), F.left(F.get(k["pieces"], i + 1), F.lit(NEARBY)))
        return F.transform(k["matches"], lambda m, i: F.struct(F.get(k["starts"], i).alias("start"), k["number"].alias("number"), m.alias("match"), around(i).alias("around")))

    df = _once(df, "found", F.filter(F.flatten(F.transform("kinds", placed)), lambda s: _by_kind(s["number"], lambda kind: kind.valid(s["match"]))), "doc_id")
    small = lambda around: F.translate(around, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    score = lambda s: _by_kind(s["number"], lambda kind: F.lit(kind.prior) + F.when(small(s["around"]).rlike(f"(?:^|[^a-z])(?:{kind.words})(?:[^a-z]|$)"), BONUS).otherwise(0))
    scored = lambda s: F.struct(
        s["start"].alias("start"), s["number"].alias("number"), _by_kind(s["number"], lambda kind: F.lit(kind.name)).alias("kind"),
        (s["start"] + F.length(s["match"])).alias("end"), F.least(F.lit(100), score(s)).alias("score"),
    )
    df = _once(df, "found", F.transform("found", scored), "doc_id")
    base = sum(kind.base for kind in KINDS)
    return df.select("doc_id", F.array_sort(F.filter("found", lambda s: (s["number"] < base) | (s["score"] >= THRESHOLD))).alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, the hash of base spans, all spans and their scores as text."""
    listed = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [kind.name for kind in KINDS if kind.base]
    count = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    counts = [count(name) for name in base]
    return spans(docs).select(
        "doc_id", *counts, F.sha2(listed(F.filter("found", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"), F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def oracle() -> str:
    """DuckDB SQL for digest() on documents, with the plain patterns."""
    at = "(?:^|[^A-Za-z0-9])"
    one = "list_sum(list_transform(range(len(n)), lambda i: CASE WHEN i % 2 = 0 THEN n[len(n) - i]::INT WHEN n[len(n) - i]::INT > 4 THEN 2 * n[len(n) - i]::INT - 9 ELSE 2 * n[len(n) - i]::INT END)) % 10 = 0"
    turned = "list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i > len(c) - 4 THEN c[i - len(c) + 4] ELSE c[i + 4] END)"
    rest = f"list_reduce(list_transform({turned}, lambda x: (CASE WHEN ascii(x) < 58 THEN ascii(x) - 48 ELSE ascii(x) - 55 END)::BIGINT), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END, 0::BIGINT) = 1"
    valid = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda x: len(ltrim(x, '0')) < 4 AND coalesce(try_cast(right(x, 3) AS INT), 0) < 256))",
        "card": f"len(n) BETWEEN 14 AND 19 AND {one}",
        "phone": "len(n) BETWEEN 10 AND 15",
        "iban": f"len(c) BETWEEN 15 AND 34 AND {rest}",
        "ssn": "NOT regexp_matches(m, '^(?:000|666|9)|-00-|0000$')",
    }
    # No look-around here: a guard before or after is a group of its own, taken off again by its length.
    guarded = {"iban": (at, r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", "[A-Za-z0-9]"), "ssn": ("(?:^|[^0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9-]")}
    parts = []
    for k, kind in enumerate(KINDS):
        pattern = kind.plain or "".join(guarded[kind.name][:2])
        head = f"regexp_extract(m0, '^{guarded[kind.name][0]}')" if not kind.plain else "''"
        tail = f"NOT regexp_matches(left(after, 1), '{guarded[kind.name][2]}')" if not kind.plain else "true"
        parts.append(f"""
s{k} AS (SELECT r, string_split_regex(t, '{pattern}') AS pieces, regexp_extract_all(t, '{pattern}') AS ms FROM d WHERE regexp_matches(t, '{pattern}')),
u{k} AS (SELECT r, unnest(ms) AS m0, unnest(pieces[:len(ms)]) AS before, unnest(pieces[2:]) AS after, unnest(range(len(ms))) AS i FROM s{k}),
w{k} AS (SELECT r, m0, before, after, CASE WHEN {'true' if kind.plain else f"{head} = m0"} THEN 0 ELSE len({head}) END AS h,
         sum(len(before) + len(m0)) OVER (PARTITION BY r ORDER BY i) - len(m0) AS start0 FROM u{k}),
x{k} AS (SELECT r, substr(m0, h + 1) AS m, start0 + h AS start, right(before || left(m0, h), {NEARBY}) || ' ' || left(after, {NEARBY}) AS around, after FROM w{k} WHERE {tail}),
y{k} AS (SELECT *, string_split(regexp_replace(m, '[^0-9]', '', 'g'), '') AS n0, string_split(replace(m, ' ', ''), '') AS c FROM x{k}),
z{k} AS (SELECT r, {k} AS k, '{kind.name}' AS kind, start, start + len(m) AS stop,
         least(100, {kind.prior} + CASE WHEN regexp_matches(translate(around, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:^|[^a-z])(?:{kind.words})(?:[^a-z]|$)') THEN {BONUS} ELSE 0 END) AS score
         FROM (SELECT *, CASE WHEN len(n0) BETWEEN 10 AND 19 THEN n0 ELSE []::VARCHAR[] END AS n FROM y{k}) WHERE CASE WHEN {valid[kind.name]} THEN true ELSE false END)""")
    base = [kind.name for kind in KINDS if kind.base]
    both = " UNION ALL ".join(f"SELECT * FROM z{k}" for k in range(len(KINDS)))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{name}') AS n_{name}" for name in base)
    span = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),{','.join(parts)},
a AS (SELECT * FROM ({both}) WHERE k < {len(base)} OR score >= {THRESHOLD}),
g AS (SELECT r, {counts}, string_agg({span}, ',' ORDER BY start, k) FILTER (WHERE k < {len(base)}) AS base, string_agg({span}, ',' ORDER BY start, k) AS spans,
      string_agg(CAST(score AS VARCHAR), ',' ORDER BY start, k) AS scores FROM a GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{name}, 0) AS n_{name}' for name in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN g USING (r)"""
