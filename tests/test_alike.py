"""Names most alike against comparing all with all."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tagmill.operators import alike, evaluation


def plain(parsed, truth, least):
    out = {}
    for scope, name in {(s, n) for s, n in parsed}:
        best = None
        for s, t, order in truth:
            if s == scope:
                ratio = SequenceMatcher(None, t, name).ratio() if t and name else float(not t and not name)
                if ratio > least and (best is None or (ratio, -order) > best):
                    best = (ratio, -order)
        if best:
            out[scope, name] = (-best[1], best[0])
    return out


def drawn(seed, n):
    r = random.Random(seed)
    words = ["milk", "Milch", "молоко", "3.2%", "bread", "a", "cheese", "é", "сыр 45", "xyz", ""]
    name = lambda: " ".join(r.choice(words) for _ in range(r.randrange(4))).lower().strip()
    truth = [(r.randrange(3), name(), k) for k in range(n)]
    misread = lambda t: "".join(c if r.random() < 0.85 else r.choice("abcx ") for c in t).strip()
    parsed = [(s, misread(t)) for s, t, _ in r.sample(truth, n // 2)] + [(r.randrange(4), r.choice(["", "q", "qqq", name()])) for _ in range(n // 4)]
    return [(s, " ".join(p.split())) for s, p in parsed], [(s, " ".join(t.split()), k) for s, t, k in truth]


def test_best_matches_are_those_of_all_pairs(spark):
    for seed, least in ((1, 0.15), (2, 0.15), (3, 0.5), (4, 0.0)):
        parsed, truth = drawn(seed, 120)
        got = alike.best_matches(spark.createDataFrame(parsed, "scope int, name string"), spark.createDataFrame(truth, "scope int, name string, order int"), least)
        assert {(r.scope, r.name): (r.first, r.similarity) for r in got.collect()} == plain(parsed, truth, least)


def test_no_names_and_clashing_columns(spark):
    schema = "video int, product string, tag int"
    some = spark.createDataFrame([(1, "Milk  3,2", 5), (1, None, 6)], schema)
    none = spark.createDataFrame([], schema)
    assert evaluation.best_alike(some, none.withColumnRenamed("tag", "gt"), "video", "product", "gt").count() == 0
    assert evaluation.best_alike(none, some.withColumnRenamed("tag", "gt"), "video", "product", "gt").count() == 0
    wide = some.withColumns({"name": F.lit("x"), "scope": F.lit(9), "first": F.lit(1), "a.b": F.lit(2)}).drop("a.b")
    got = evaluation.best_alike(wide, some.withColumnRenamed("tag", "gt"), "video", "product", "gt").collect()
    assert sorted((r.tag, r.gt, r.similarity, r.name) for r in got) == [(5, 5, 1.0, "x"), (6, 6, 1.0, "x")]


def test_few_pairs_meet_where_names_are_alike(spark):
    names = [(1, f"{random.Random(k).getrandbits(60):x}", k) for k in range(300)]
    known = spark.createDataFrame(names, "scope int, truth string, first int").withColumn("truth_tokens", alike.tokens(F.col("truth")))
    own = spark.createDataFrame([(1, t) for _, t, _ in names], "scope int, name string").withColumn("tokens", alike.tokens(F.col("name")))
    postings = known.select("scope", "truth", F.explode("truth_tokens").alias("token"))
    assert alike._pairs(own, known, postings, 0.8).count() < 300 * 300 / 4
