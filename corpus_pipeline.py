"""Training-corpus pipeline over ``documents``: each stage reads what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``docs``. Null texts and texts without letters go in the first stage;
rows with a null id take part in every stage but are never anyone's copy. A table
without rows passes through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.llm import cotraining, langid, wand
from lexspark.llm.common import crc_mod, prepare, table
from lexspark.llm.jaccard import jaccard_components
from lexspark.llm.pfair import mix
from lexspark.session import cut_lineage

# a prediction below this, or no letter at all, is no known language
LANGUAGE_FROM = 0.5
# near copies: five-word n-grams, similarity of 0.8 or more
COPY_WORDS, COPY_SHARE = 5, (80, 100)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages."""
    prepare(spark)
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    model = langid.train(docs.where(~held).select("text", "lang"))
    judged = langid.identify(docs, model)
    return judged.where(f"lang_pred <> 'und' AND score >= {LANGUAGE_FROM}").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views take for good."""
    prepare(spark)
    model = cotraining.train(docs, table(spark, sf_dir, "labels"))
    return cotraining.classify(docs, model).where("keep").select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one of the least id."""
    prepare(spark)
    groups = jaccard_components(docs, COPY_WORDS, *COPY_SHARE)
    ids = groups.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    first = ids.where("component_id = doc_id").select(F.col("doc_id").alias("first_id"))
    kept = docs.where("doc_id IS NOT NULL").join(first, docs["doc_id"] == first["first_id"], "left_semi")
    # rows that share an id are one document
    kept = kept.withColumn("_row", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("_row = 1").drop("_row")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return wand.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot in the mix of sources."""
    prepare(spark)
    return mix(docs)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("n-gram Jaccard join", copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

# trained classifiers cannot be said in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage keeps is written to the shared checkpoint folder as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    cut_lineage(spark.range(1))  # sets the checkpoint folder where only tests leave it open
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
