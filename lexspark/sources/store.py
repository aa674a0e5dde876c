"""Case store in hash buckets: a batch rewrites only the buckets its cases are in.

A bucket is a partition folder. ``merge_cases`` reads the buckets a batch touches (found by
partition pruning), applies the upsert rule, writes the outcome to the shared folder and puts
it in place of those buckets by dynamic partition overwrite; the others are neither read
nor written. ``crawled_at`` is when a case first came, ``updated_at`` when it last
came, both as the records say, so a batch merged twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.session import cut_lineage
from lexspark.sources.landing import upsert_cases

BUCKETS = 256


def case_bucket(case_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(case_id), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, buckets: int, mode: str) -> None:
    placed = rows.withColumn("bucket", case_bucket(F.col("case_id"), buckets))
    # one task a bucket; a bucket holds 1 / buckets of the cases, whatever their jurisdiction
    placed.repartition("bucket").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def create_store(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Start a store with landed ``rows`` (see ``landed_cases``, with ``crawled_at`` and ``updated_at``)."""
    _write(upsert_cases(rows.limit(0), rows), path, buckets, "errorifexists")


def merge_cases(spark: SparkSession, path: str, batch: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Upsert landed rows into the store; returns the buckets that were rewritten."""
    batch = cut_lineage(batch)
    # numbers below ``buckets``, not cases
    touched = sorted(r["bucket"] for r in batch.select(case_bucket(F.col("case_id"), buckets).alias("bucket")).distinct().collect())
    if touched:
        held = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
        _write(cut_lineage(upsert_cases(held.select(*batch.columns), batch)), path, buckets, "overwrite")
    return touched


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Current cases of a store."""
    return spark.read.parquet(path).drop("bucket")
