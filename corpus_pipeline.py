"""A training corpus from ``documents`` in five stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locusframe.llm.common import delete_folders, folders_made, save, table
from locusframe.llm.jaccard import one_of_each
from locusframe.llm.mixing import mixed
from locusframe.llm.packing import pack
from locusframe.llm.quality import accepted
from locusframe.llm.secret_scan import without_secrets


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    return without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources have their target words."""
    return mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of whole documents, or of pieces of long ones, without two copies in one bin."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the trained model or the seeded draws; a test holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written, and what it and its predecessor left goes then."""
    docs, left = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with folders_made() as made:
            docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete_folders(spark, [f for f in left + made if f != docs._saved_at])
        left = [docs._saved_at]
    return docs
