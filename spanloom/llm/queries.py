"""Queries over the given tables, one for each operator, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import (
    conversation_trie,
    decontam,
    licenses,
    lm_score,
    mixing,
    ngram_join,
    nn_descent,
    packing,
    pii,
    quality,
    secret_scan,
    substring_dedup,
    whitening,
)
from spanloom.sources.tables import table


def op1_empirical_bayes_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.posteriors(docs, table(spark, folder, "labels"), F.col("source"), F.col("lang"))


def op2_paragraph_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.repeated(table(spark, folder, "documents"))


def op3_disclosure_sanitisation(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents"))


def op4_parity_sketch_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(table(spark, folder, "documents"))


#: Shares of the token budget by language.
MIXTURE = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def good_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A labelled table of domains: the language of documents that labels call good."""
    good = labels.where("quality = 1 and toxic = 0").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(good, "doc_id", "left_semi")


def op5_soft_membership_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return mixing.mix(docs, good_languages(docs, table(spark, folder, "labels")), MIXTURE)


def op6_nn_descent_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, folder, "embeddings"))


def op7_multipart_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(table(spark, folder, "documents"))


def op8_license_signatures(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents")).drop("detections")


def op9_cross_entropy_difference(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_fm_index_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as files

    vocabulary = packing.Vocabulary(files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)
    return packing.pack(table(spark, folder, "documents"), vocabulary)


def op13_conversation_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.spliced_trie(table(spark, folder, "conversations"))


QUERIES = {
    "op1_empirical_bayes_quality": op1_empirical_bayes_quality,
    "op2_paragraph_minhash_dedup": op2_paragraph_minhash_dedup,
    "op5_soft_membership_mixing": op5_soft_membership_mixing,
    "op6_nn_descent_near_duplicates": op6_nn_descent_near_duplicates,
    "op3_disclosure_sanitisation": op3_disclosure_sanitisation,
    "op4_parity_sketch_join": op4_parity_sketch_join,
    "op7_multipart_secrets": op7_multipart_secrets,
    "op8_license_signatures": op8_license_signatures,
    "op9_cross_entropy_difference": op9_cross_entropy_difference,
    "op10_fm_index_decontamination": op10_fm_index_decontamination,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_conversation_prefix_trie": op13_conversation_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {}
