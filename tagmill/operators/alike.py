"""Names most alike, by the Ratcliff-Obershelp ratio, without comparing all with all.

The ratio is 2 M / (a + b), with M characters in matching blocks and a, b the lengths, so M is at
most what the two bags of characters share.  A bag is kept as tokens (a character and which of
its kind it is).  For a ratio of t or more, lengths and shared tokens must satisfy

    b >= a t / (2 - t)   and   shared >= t (a + b) / 2 >= a t / (2 - t),

so one of the rarest a - ceil(a t / (2 - t)) + 1 tokens of a name is in its partner: only such
pairs meet (an equi-join on scope and token), those whose counts still allow the ratio are compared exactly.

Names are settled in rounds of falling t: all partners at t or above have been seen in a
round, so a best ratio that reaches t is the best of all; names that reach none go on to the next
round.  Only names that resemble nothing meet most others, in the last round, at the least ratio asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.functions import text
from tagmill.sources.scratch import discard, materialize

ROUNDS = (0.8, 0.55, 0.35)


def tokens(name: Column) -> Column:
    """A name's bag of characters as distinct tokens; the blank name has one of its own."""
    chars = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)))
    nth = lambda c, i: F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))
    return F.when(F.length(name) == 0, F.array(F.lit(""))).otherwise(F.transform(chars, lambda c, i: F.concat(c, nth(c, i).cast("string"))))


def _pairs(left: DataFrame, known: DataFrame, postings: DataFrame, t: float) -> DataFrame:
    """(scope, name, truth) of all pairs that may reach t."""
    n, m, share = F.size("tokens"), F.size("truth_tokens"), t / (2 - t)
    head = F.slice("tokens", F.lit(1), (n - F.ceil(n * share - 1e-9) + 1).cast("int"))
    met = left.select("scope", "name", F.explode(head).alias("token")).join(postings, ["scope", "token"]).select("scope", "name", "truth").distinct()
    both = met.join(left, ["scope", "name"]).join(known, ["scope", "truth"])
    fits = (m >= n * share - 1e-9) & (n >= m * share - 1e-9) & (F.size(F.array_intersect("tokens", "truth_tokens")) * 2 >= (n + m) * t - 1e-9)
    return both.filter(fits).select("scope", "name", "truth", "first")


def best_matches(parsed: DataFrame, truth: DataFrame, least: float = 0.15) -> DataFrame:
    """Each distinct (scope, name) of parsed with `first` (least order) and similarity of the truth (scope, name, order) most alike, over `least`.

    Names must be normalised; of truths that are equally alike the least order counts.  Names without such a truth are left out.
    """
    known = truth.groupBy("scope", F.col("name").alias("truth")).agg(F.min("order").alias("first")).withColumn("truth_tokens", tokens(F.col("truth")))
    known = materialize(known)
    postings = known.select("scope", "truth", F.explode("truth_tokens").alias("token"))
    often = postings.groupBy("scope", "token").agg(F.count("*").alias("often"))
    own = parsed.select("scope", "name").distinct().withColumn("token", F.explode(tokens(F.col("name"))))
    # Rarest tokens first: those of no truth cost nothing.
    ranked = own.join(often, ["scope", "token"], "left").groupBy("scope", "name").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "token"))).alias("r"))
    left = materialize(ranked.select("scope", "name", F.col("r.token").alias("tokens")))
    found, scratch = None, []
    for t in [*(r for r in ROUNDS if r > least), least]:
        compared = _pairs(left, known, postings, t).withColumn("similarity", text.similarity(F.col("truth"), F.col("name")))
        compared = materialize(compared)  # the ratio is computed once
        at = F.col("similarity") > least if t == least else F.col("similarity") >= t
        best = compared.filter(at).groupBy("scope", "name").agg(F.max_by(F.struct("first", "similarity"), F.struct("similarity", -F.col("first"))).alias("b")).select("scope", "name", "b.first", "b.similarity")
        best = materialize(best)
        discard(compared)
        found = best if found is None else found.unionByName(best)
        if t != least:
            rest = materialize(left.join(best, ["scope", "name"], "left_anti"))
            scratch.append(left)
            left = rest
    for table in [*scratch, left, known]:
        discard(table)
    return found
