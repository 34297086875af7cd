"""From raw documents to a weighted training corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes what
a stage returns as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, mixing, ngram_join, quality, secret_scan
from spanloom.llm.queries import MIXTURE, good_languages
from spanloom.session import Workspace
from spanloom.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose posterior of being good is under one half; null and empty texts are judged by their site."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five words, 80 in a hundred) keep that with the smallest id.

    Rows without an id or without words are linked with nothing and stay.
    """
    return ngram_join.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of benchmark items; drop documents that hold nothing else; null and empty texts stay."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the values of secrets and of linked credential parts; no row goes."""
    return secret_scan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as it is read: documents with rates that bring expected tokens of the languages to their shares.

    The columns n_tokens, p_<language>, rate and copies are added; a document is read ``copies`` times.
    """
    rated = mixing.weigh(docs, good_languages(docs, table(spark, sf_dir, "labels")), MIXTURE)
    return rated.where("rate > 0")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixture),
]

#: SQL cannot express these stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, f"stage-{k}")
    return docs
