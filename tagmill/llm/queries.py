"""The queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.llm import additive, avi, bpe_tree, chat, lang_id, licenses, line_dedup, packing, pii, simhash, structure, token_counts, whitening
from tagmill.llm.common import read


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repair_conversations(read(spark, sf_dir, "conversations"))


def op7_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = lang_id.predict(docs.select("doc_id", "text"), lang_id.fit(docs))
    return found.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "label_share")


def op9_byte_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi.digest_documents(read(spark, sf_dir, "documents"))


def op2_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op3_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.digest(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_avi_mjpeg": op1_avi_mjpeg,
    "op2_line_winnowing": op2_line_winnowing,
    "op3_token_attribution": op3_token_attribution,
    "op4_simhash_pivots": op4_simhash_pivots,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_chat_repair": op6_chat_repair,
    "op7_additive_quantisation": op7_additive_quantisation,
    "op8_language_gru": op8_language_gru,
    "op9_byte_bpe_tree": op9_byte_bpe_tree,
    "op10_license_scan": op10_license_scan,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_pii": op12_pii,
    "op13_structure_repair": op13_structure_repair,
}
ORACLE: dict[str, str] = {
    "op2_line_winnowing": line_dedup.oracle(),
    "op10_license_scan": licenses.oracle(),
    "op12_pii": pii.oracle(),
}
