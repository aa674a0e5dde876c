"""Named queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import cotraining
from lexspark.llm.bpe import token_counts
from lexspark.llm.chunks import edited_fingerprints
from lexspark.llm.common import table
from lexspark.llm.cotraining import classify
from lexspark.llm.hadamard import cluster
from lexspark.llm.jaccard import jaccard_components
from lexspark.llm.langid import language_ids
from lexspark.llm.lexical import ranked_search
from lexspark.llm.licenses import scan
from lexspark.llm.logbilinear import language_model_scores
from lexspark.llm.packing import pack
from lexspark.llm.pfair import mix
from lexspark.llm.sql import SQL
from lexspark.llm.styletree import extract_articles
from lexspark.llm.wand import leaks

QUERIES = {}
__all__ = ["QUERIES", "SQL"]


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op2_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90, 100)


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"))


@_query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


@_query
def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return classify(documents, cotraining.train(documents, table(spark, sf_dir, "labels"))).select("doc_id", *cotraining.RESULT)


@_query
def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


@_query
def op1_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_articles(table(spark, sf_dir, "pages"))


@_query
def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", F.expr("CAST(doc_id DIV 100 AS STRING)"), F.col("doc_id").cast("string"))
    return scan(documents.select("doc_id", path.alias("path"), "text"))


@_query
def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op12_bag_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op13_progressive_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))
