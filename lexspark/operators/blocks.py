"""Any-word top-k search over stored posting blocks with bounds.

The postings of a term in a scope (a jurisdiction) are dealt by a hash of the document
into blocks of about ``BLOCK`` postings; a block row has the largest term weight inside, so
that idf times it bounds what any of its documents can gain. A search runs in three steps:

1. The rarest terms of a query, as few as hold k postings, are read whole; the k-th best partial score is a
   threshold that the k best documents reach.
2. The most common terms whose bounds together stay below the threshold cannot
   lift a document on their own. Of the other terms, blocks are read unless their bound plus
   the bounds of all other terms stays below the threshold.
3. The common terms are looked up for the documents still able to reach the
   threshold: the hash says which block may hold one, the rest is never read.

The rows are those of exhaustive scoring.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspark.operators.ranking import top_per_group
from lexspark.operators.search import K1, MIN_IDF, NAME_WEIGHT, TEXT_WEIGHT, B, TextIndex, query_terms, term_bucket
from lexspark.session import cut_lineage

BLOCK = 32
# scores are rounded to nine places before they are ordered
SLACK = 1e-6


class BlockIndex(NamedTuple):
    """``blocks`` (term, scope, block, bound, n, docs) and ``terms`` (term, scope, n, blocks, bound, df, corpus)."""

    blocks: DataFrame
    terms: DataFrame


def _block(doc_id: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), blocks)


def write_blocks(index: TextIndex, doc_id: str, scope: str, path: str, buckets: int = 256) -> None:
    """Store the postings of a text index that carry ``scope`` as blocks under ``path``."""
    size = index.lengths.agg(F.count("*").alias("corpus"), F.avg("length").alias("average"))
    corpus, average = size.select("corpus").scalar(), size.select("average").scalar()
    f = NAME_WEIGHT * F.col("tf_name") + TEXT_WEIGHT * F.col("tf_text")
    rows = index.postings.select(
        "term", F.coalesce(scope, F.lit("")).alias("scope"), F.col(doc_id).alias("doc_id"),
        (f * (K1 + 1.0) / (f + K1 * (1.0 - B + B * F.col("length") / average))).alias("weight"),
    )
    counts = rows.groupBy("term", "scope").agg(F.count("*").alias("n"), F.max("weight").alias("bound")).withColumn(
        "blocks", F.ceil(F.col("n") / BLOCK)
    )
    df = counts.groupBy("term").agg(F.sum("n").alias("df"))
    bucket = term_bucket(F.col("term"), buckets).alias("bucket")
    counts.join(df, "term").select("*", corpus.alias("corpus")).write.mode("overwrite").parquet(f"{path}/terms")
    # a common term has many blocks, so its postings meet in many small groups
    blocks = (
        rows.join(counts.select("term", "scope", "blocks"), ["term", "scope"])
        .groupBy("term", "scope", _block(F.col("doc_id"), F.col("blocks")).alias("block"))
        .agg(F.max("weight").alias("bound"), F.count("*").alias("n"), F.collect_list(F.struct("doc_id", "weight")).alias("docs"))
    )
    blocks.select("*", bucket).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> BlockIndex:
    """The blocks that ``write_blocks`` stored."""
    return BlockIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"))


def _open(blocks: DataFrame, wanted: DataFrame, by_block: bool, buckets: int) -> DataFrame:
    """(term, scope, block, bound, doc_id, weight) of the blocks that ``wanted`` names, by term and scope or one by one."""
    keys = ["term", "scope"] + (["block"] if by_block else [])
    named = wanted.select(*keys).distinct().withColumn("bucket", term_bucket(F.col("term"), buckets))
    return blocks.join(named, ["bucket", *keys], "left_semi").select("term", "scope", "block", "bound", F.inline("docs"))


def top_any_word(queries: DataFrame, index: BlockIndex, k: int, buckets: int = 256) -> tuple[DataFrame, DataFrame]:
    """The ``k`` best documents of each query (qid, query, scope) that hold any of its words, and the blocks read.

    Results are (qid, position, doc_id, score), best score first, then the least id; a null scope
    is every scope. Reads are (term, blocks, blocks_read) of the terms asked for.
    """
    asked = query_terms(queries).select("qid", "term").join(queries.select("qid", F.col("scope").alias("_asked")), "qid")
    idf = F.greatest(F.log((F.col("corpus") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(MIN_IDF))
    # one row for each term of a query and scope it reads: small against the postings
    parts = asked.join(index.terms, "term").where(F.col("_asked").isNull() | (F.col("_asked") == F.col("scope")))
    parts = cut_lineage(parts.select("qid", "term", "scope", "n", "blocks", idf.alias("idf"), (idf * F.col("bound")).alias("gain")))
    of_query = parts.groupBy("qid", "term").agg(F.sum("n").alias("n"), F.max("gain").alias("gain"))
    before = Window.partitionBy("qid").orderBy("n", "term").rowsBetween(Window.unboundedPreceding, -1)
    rare = of_query.withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("seen") < k)

    first = parts.join(rare.select("qid", "term"), ["qid", "term"])
    opened = _open(index.blocks, first, False, buckets)
    partial = opened.join(first.select("qid", "term", "scope", "idf"), ["term", "scope"]).groupBy("qid", "doc_id").agg(
        F.sum(F.col("idf") * F.col("weight")).alias("score")
    )
    best = top_per_group(partial, ["qid"], [F.col("score").desc(), F.col("doc_id")], k)
    threshold = best.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score") - SLACK).otherwise(0.0).alias("threshold"))

    all_gain = Window.partitionBy("qid")
    upto = all_gain.orderBy("gain", "term").rowsBetween(Window.unboundedPreceding, 0)
    roles = (
        of_query.join(threshold, "qid", "left").na.fill(0.0, ["threshold"])
        .withColumn("all_gain", F.sum("gain").over(all_gain)).withColumn("common", F.sum("gain").over(upto) < F.col("threshold"))
        .withColumn("common_gain", F.sum(F.when(F.col("common"), F.col("gain")).otherwise(0.0)).over(all_gain))
    )
    roles = cut_lineage(parts.drop("gain", "n").join(roles, ["qid", "term"]))
    essential, common = roles.where(~F.col("common")), roles.where("common")
    # a block whose best document stays below the threshold with all that other terms can add
    able = F.col("idf") * F.col("bound") + F.col("all_gain") - F.col("gain") >= F.col("threshold")
    kept = index.blocks.select("bucket", "term", "scope", "block", "bound").join(
        essential.withColumn("bucket", term_bucket(F.col("term"), buckets)), ["bucket", "term", "scope"]
    ).where(able).select("qid", "term", "scope", "block", "idf", "threshold", "common_gain")
    kept = cut_lineage(kept)
    gained = _open(index.blocks, kept, True, buckets).join(kept, ["term", "scope", "block"])
    candidates = cut_lineage(
        gained.groupBy("qid", "scope", "doc_id").agg(
            F.sum(F.col("idf") * F.col("weight")).alias("score"), F.max("threshold").alias("threshold"), F.max("common_gain").alias("common_gain")
        ).where(F.col("score") + F.col("common_gain") >= F.col("threshold"))
    )
    looked = cut_lineage(
        candidates.select("qid", "scope", "doc_id").join(common.select("qid", "term", "scope", "idf", "blocks"), ["qid", "scope"])
        .withColumn("block", _block(F.col("doc_id"), F.col("blocks")))
    )
    added = _open(index.blocks, looked, True, buckets).select("term", "scope", "doc_id", "weight").join(looked, ["term", "scope", "doc_id"]).groupBy("qid", "doc_id").agg(
        F.sum(F.col("idf") * F.col("weight")).alias("more")
    )
    total = F.round(F.col("score") + F.coalesce("more", F.lit(0.0)), 9).alias("score")
    scored = candidates.join(added, ["qid", "doc_id"], "left").select("qid", "doc_id", total)
    ranked = top_per_group(scored, ["qid"], [F.col("score").desc(), F.col("doc_id")], k, rank="position")
    stored = index.terms.join(parts.select("term", "scope").distinct(), ["term", "scope"]).groupBy("term").agg(F.sum("blocks").alias("blocks"))
    whole = first.select("term", "scope").distinct().join(index.blocks.select("term", "scope", "block"), ["term", "scope"])
    read = whole.unionByName(kept.select("term", "scope", "block")).unionByName(looked.select("term", "scope", "block")).distinct()
    reads = stored.join(read.groupBy("term").agg(F.count("*").alias("blocks_read")), "term", "left").na.fill(0, ["blocks_read"])
    return ranked.select("qid", "position", "doc_id", "score"), reads
