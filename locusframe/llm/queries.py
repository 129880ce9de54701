"""The operators' queries over whole tables, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from locusframe.llm import secret_scan, token_files, warc
from locusframe.llm.common import table
from locusframe.llm.edit_fingerprint import fingerprint_documents, with_near_classes
from locusframe.llm.jaccard import near_duplicates
from locusframe.llm.mixing import mix
from locusframe.llm.neighbours import nearest_neighbours
from locusframe.llm.packing import pack
from locusframe.llm.quality import classify
from locusframe.llm.sharding import shard


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 16)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 100 = 0"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_near_classes(fingerprint_documents(table(spark, sf_dir, "documents")))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_shard, op3_nearest_neighbours, op4_ngram_jaccard_join, op5_best_fit_packing, op6_edit_fingerprint, op7_token_files, op8_quality_classifier, op9_warc_round_trip, op10_secret_scan)}

#: None of these results can be had from SQL alone (seeded draws, trained models, files); tests hold them against brute force.
ORACLES: dict[str, str] = {}
