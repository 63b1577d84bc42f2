"""Connected components of a graph of links, by alternating star contraction.

Each round replaces every link by links to the smallest node around, first
towards larger neighbours, then towards smaller ones (Kiveris et al., 2014).
A hot node is pre-aggregated as a minimum; its links are never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagmill.sources.scratch import discard, materialize

SALTS = 16


def _stars(links: DataFrame, both: bool) -> DataFrame:
    """Links u-v, v < u: hang u's neighbours (all, or only the smaller ones) on the smallest node among them and u."""
    seen = links
    if both:
        seen = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    # A node with very many neighbours meets its minimum in SALTS places.
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hung = seen.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"]).drop("salt")
    if both:
        return hung.filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(hung.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node that has a link; links: u, v of one orderable type."""
    now = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now)
    stamp = None
    while True:
        new = materialize(_stars(_stars(now, both=True), both=False))
        # A round that changes nothing leaves the same set of links: each node once, below its root.
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = new
        if mark == stamp:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        stamp = mark
