"""Repeated runs of lines, found by winnowing over line hashes.

A *window* is a shortest run of whole lines, seen from its first line or from
its last, that holds at least ``min_words`` words.  Each window selects its
smallest line hash (the rightmost of equal ones) as a fingerprint; two copies of
a run hold the same windows and so select fingerprints at the same places of it.
A selected position is one row: its fingerprint and the windows that chose it,
each with the hash of its lines (a difference of prefix hashes, so a window costs
the same however many lines it has).

Positions are met by fingerprint.  One that occurs at a single place cannot lie
in a repeated run.  The others are joined with the first place of their
fingerprint that agrees in a whole window around it: a frequent line has very
many places but each window around it has one first occurrence, so no pair of
places is listed.  A match is extended both ways by the windows of neighbouring
positions, which overlap it: forwards by those that begin in the run, backwards
by those that end in it; their union is the repeated run.

A line is deleted exactly if it lies in a run of at least ``min_words`` words
that occurs earlier, in the order of (doc_id, text key, line).  The first
occurrence of a line is never deleted.

Hot lines and runs: counts and first occurrences are pre-aggregated, and joins
with them are salted, so no fingerprint's places meet in one task.

Results for odd input: a null text stays null with no lines; an empty text is
one empty line; rows equal in doc_id and text are one document, each of which
gets its result; a null doc_id comes before all others; an empty table gives no
rows; columns of docs named like a result column give way to it.  A text that
loses all its lines becomes empty and is kept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import boxed, materialize, slices, text_key, unboxed

MIN_WORDS = 50
#: Places over which a frequent fingerprint or run is spread.
SALTS = 32
#: Prefix hashes of lines: polynomials in BASE over the integers modulo a Mersenne prime.
MODULUS, BASE = (1 << 127) - 1, 0x5DEECE66D1234567F0E1D2C3B4A59687 % ((1 << 127) - 1)
#: Rows of one Arrow batch of results.
BATCH = 1 << 15


def line_windows(n_words: np.ndarray, min_words: int) -> np.ndarray:
    """(first, last) of each shortest run with min_words words, from its first or from its last line, in order."""
    total = np.concatenate([[0], np.cumsum(n_words)])
    n = len(n_words)
    last = np.searchsorted(total, total[:-1] + min_words, side="left") - 1
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    starts = np.arange(n)
    ahead, back = last < n, total[1:] >= min_words
    # A line without words at an end adds nothing; searchsorted finds the shortest run from the one side given.
    key = np.unique(np.concatenate([starts[ahead] * (n + 1) + last[ahead], first[back] * (n + 1) + starts[back]]))
    return np.stack([key // (n + 1), key % (n + 1)], 1)


def select_minima(hashes: list[int], windows: list[list[int]]) -> list[int]:
    """The line that each window selects: the smallest hash, rightmost of equal ones. Both ends of windows never go back."""
    out, near, upto = [], deque(), 0
    for a, b in windows:
        while upto <= b:
            while near and hashes[near[-1]] >= hashes[upto]:
                near.pop()
            near.append(upto)
            upto += 1
        while near[0] < a:
            near.popleft()
        out.append(near[0])
    return out


def run_hashes(hashes: list[int], windows: list[list[int]]) -> list[int]:
    """Hash of the lines of each window, by prefix hashes."""
    prefix, powers = [0], [1]
    for h in hashes:
        prefix.append((prefix[-1] * BASE + h + 1) % MODULUS)
    longest = max((b - a + 1 for a, b in windows), default=0)
    for _ in range(longest):
        powers.append(powers[-1] * BASE % MODULUS)
    return [(prefix[b + 1] - prefix[a] * powers[b + 1 - a]) % MODULUS for a, b in windows]


_WINDOW = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())])
POSITIONS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("position", pa.int32()), ("print", pa.int64()), ("windows", pa.list_(_WINDOW))])
_LOW = (1 << 64) - 1


def positions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, position, print (its line hash), windows (first, last, halves of the run's hash): one row a selected line."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in slices(batches):
            for doc_id, key, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                lines = (text or "").encode().split(b"\n")
                n_words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
                if int(n_words.sum()) < min_words:
                    continue
                hashes = [xxhash.xxh64_intdigest(x) for x in lines]
                found = line_windows(n_words, min_words).tolist()
                own: list[dict] = []
                at = -1
                for (a, b), p, whole in zip(found, select_minima(hashes, found), run_hashes(hashes, found), strict=True):
                    # Selected places never go back, so a place's windows follow one another; a row holds a bounded number of them.
                    if p != at or len(own) >= BATCH:
                        if own:
                            yield doc_id, key, at, _signed(hashes[at]), own
                        own, at = [], p
                    own.append({"first": a, "last": b, "hi": whole >> 64, "lo": _signed(whole & _LOW)})
                yield doc_id, key, at, _signed(hashes[at]), own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row in rows_of(batches):
            out.append(row)
            held += len(row[-1])
            if held >= BATCH:
                yield _batch(out)
                out, held = [], 0
        yield _batch(out)

    return docs.select("doc_id", text_key(F.col("text")).alias("key"), "text").mapInArrow(run, "doc_id long, key long, position int, print long, windows array<struct<first:int,last:int,hi:long,lo:long>>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(POSITIONS), POSITIONS, strict=True)], schema=POSITIONS)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, key, gone: for each document with repeats a flag for every line up to its last repeated one."""
    found = materialize(positions(docs, min_words))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salt = F.pmod(F.xxhash64("doc_id", "key", "first"), F.lit(SALTS)).cast("int")
    windows = found.select("print", "doc_id", "key", F.inline("windows"))
    # The first place of a fingerprint and of what surrounds it; runs that occur once are gone here.
    place = F.struct("doc_id", "key", "first")
    origin = windows.groupBy("print", "hi", "lo").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.withColumn("salt", salt).join(origin.withColumn("salt", salts), ["print", "hi", "lo", "salt"]).filter(place > F.col("origin"))
    # Bounded by the windows of one document, two for each of its lines.
    runs = later.groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = []
            for each in b.column("runs"):
                first, last = (each.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                step = np.zeros(int(last.max()) + 2, np.int64)
                np.add.at(step, first, 1)
                np.add.at(step, last + 1, -1)
                gone.append(np.cumsum(step)[:-1] > 0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(gone, pa.list_(pa.bool_()))], ["doc_id", "key", "gone"])

    return runs.mapInArrow(extend, "doc_id long, key long, gone array<boolean>")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, text without its repeated runs, and n_lines, n_deleted, deleted (line numbers from 0)."""
    docs = docs.drop("n_lines", "n_deleted", "deleted")
    runs = repeated_runs(docs, min_words).select(F.col("doc_id").alias("run_doc"), F.col("key").alias("run_key"), "gone")
    here = boxed(docs).withColumn("key", text_key(F.col("text")))
    joined = here.join(runs.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("run_doc")) & (F.col("key") == F.col("run_key")), "left")
    lines = F.split("text", "\n", -1)
    left = F.filter(F.zip_with(lines, "gone", lambda x, g: F.when(F.coalesce(g, F.lit(False)), None).otherwise(x)), lambda x: x.isNotNull())
    deleted = F.coalesce(F.filter(F.transform("gone", lambda g, i: F.when(g, i)), lambda i: i.isNotNull()), F.array().cast("array<int>"))
    out = joined.withColumn("deleted", deleted).withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"))
    out = out.withColumn("text", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    marks = {"n_lines": F.col("n_lines"), "n_deleted": F.size("deleted").cast("long"), "deleted": F.col("deleted")}
    return unboxed(out, [*docs.columns, *marks], **marks)


def oracle(min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL for dedup_lines() on documents: every window compared whole, without fingerprints."""
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM d),
w AS (SELECT doc_id, i, len(list_filter(string_split_regex(line, '[ \\t\\n\\x0b\\f\\r]+'), lambda t: t <> '')) AS n FROM x),
c AS (SELECT doc_id, i, n, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
p AS (SELECT a.doc_id, a.i AS a, b.i AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {min_words}),
f AS (SELECT doc_id, a, min(b) AS b FROM p GROUP BY doc_id, a UNION SELECT doc_id, max(a) AS a, b FROM p GROUP BY doc_id, b),
k AS (SELECT f.*, md5(array_to_string(l[a + 1 : b + 1], chr(10))) AS h FROM f JOIN d USING (doc_id)),
o AS (SELECT h, min(struct_pack(d := doc_id, a := a)) AS origin FROM k GROUP BY h),
g AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(a, b + 1)) AS i FROM k JOIN o USING (h) WHERE struct_pack(d := doc_id, a := a) > origin) GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_deleted,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string([l[i + 1] for i in range(len(l)) if NOT list_contains(gone, i)], chr(10)) END AS text
FROM d LEFT JOIN g USING (doc_id)"""
