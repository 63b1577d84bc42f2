"""The corpus pipeline: documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on every document that the stage
before kept, and returns a DataFrame; all but the last return the columns of
documents.  run() writes each stage's result as Parquet in the shared folder and
reads it as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import lang_id, line_dedup, packing, simhash
from tagmill.llm.common import boxed, materialize, read, text_key, unboxed

#: A text whose pooled language probability is below this is in no language that was learned.
MIN_SCORE = 0.4
#: Places over which rows that are repeated very often are spread.
SALTS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language and writes it to lang; null and letterless texts and doubtful ones go."""
    found = lang_id.predict(boxed(docs), lang_id.fit(docs))
    kept = found.filter((F.col("lang_pred") != lang_id.UNKNOWN) & (F.col("score") >= MIN_SCORE))
    return unboxed(kept, docs.columns, lang=F.col("lang_pred"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes runs of lines with 50 words or more that occur earlier; a document without any word left goes."""
    cleaned = line_dedup.dedup_lines(boxed(docs))
    kept = cleaned.filter((F.col("n_deleted") == 0) | F.col("text").rlike("\\S"))
    return unboxed(kept, docs.columns, n_chars=F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document that is least by id, then text key, stays, once; those without an id come last.

    Documents are told apart by id and text (a null text counts as empty), so two texts with one id are two documents.
    Of rows equal in both, the one least in its other columns, written as JSON, stays.
    """
    groups = simhash.similar_documents(docs)
    least = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("component_key"))
    seen = groups.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.bool_or(least).alias("stays"))
    # Only what goes and what is repeated; salted, as one row may be repeated very often.
    ruled = seen.filter(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("ruled_id"), F.col("key").alias("ruled_key"), "stays")
    ruled = ruled.withColumn("ruled_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    here = boxed(docs).withColumn("key", text_key(F.col("text"))).withColumn("json", F.to_json("rest"))
    here = here.withColumn("salt", F.pmod(F.xxhash64("json"), F.lit(SALTS)).cast("int"))
    same = F.col("doc_id").eqNullSafe(F.col("ruled_id")) & (F.col("key") == F.col("ruled_key")) & (F.col("salt") == F.col("ruled_salt"))
    joined = here.join(ruled.hint("shuffle_hash"), same, "left")
    once = joined.filter("stays is null").select("text", "rest")
    row = F.min_by(F.struct("text", "rest"), F.struct(F.col("text").isNull().alias("null"), "json"))
    repeated = joined.filter("stays").groupBy("doc_id", "key").agg(row.alias("row")).select("row.text", "row.rest")
    return unboxed(once.unionByName(repeated), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining text in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("packing", pack),
]

#: No stage but line_dedup can be said in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
