"""Upsert landed case records, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from lexspark.sources.landing import landed_cases, upsert_cases

RAW_DDL = (
    "id STRING, case_id STRING, source_url STRING, case_name STRING, case_number STRING, court STRING, "
    "decision_date STRING, text STRING, full_text STRING, plain_text STRING, summary STRING, language STRING, "
    "extra MAP<STRING, STRING>, jurisdiction STRING, adapter STRING, seq BIGINT"
)


# batch number of a compacted base; streams count from 0
BASE = -1


def read_landing(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON records landed under ``path`` as a stream."""
    return spark.readStream.schema(RAW_DDL).option("maxFilesPerTrigger", files_per_batch).json(path)


def upsert_stream(raw: DataFrame, store: str, checkpoint: str) -> DataStreamWriter:
    """Writer that merges each micro-batch into the case store under ``store``.

    The store is a log of merged batches: a batch is reduced to one row per
    case and written to its own folder, overwritten when a batch is retried, so
    a replay after a failure changes nothing. ``read_store`` merges the log.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = landed_cases(batch)
        upsert_cases(rows.limit(0), rows).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return raw.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Current cases of a store: the upsert rule over all batches, in batch order."""
    log = spark.read.parquet(store).withColumn("seq", F.col("batch").cast("bigint")).drop("batch")
    return upsert_cases(log.where(F.lit(False)), log)


def compact_store(spark: SparkSession, store: str, target: str) -> None:
    """Write the current cases of ``store`` as the base of a new store under ``target``.

    The base is batch -1, which no stream writes: a stream that starts on the
    compacted store, with whatever checkpoint, adds to it and overwrites none of it.
    """
    read_store(spark, store).write.mode("overwrite").parquet(f"{target}/batch={BASE}")
