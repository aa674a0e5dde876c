"""Corpus tables: schemas, reading, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CASES_DDL = (
    "case_id STRING, jurisdiction STRING, court STRING, case_name STRING, case_number STRING, "
    "decision_date STRING, full_text STRING, summary STRING, source_url STRING, source_adapter STRING, "
    "language STRING, raw_metadata STRING, crawled_at TIMESTAMP, updated_at TIMESTAMP, case_type STRING, "
    "case_type_suggested STRING, subject_area STRING, subject_area_suggested STRING, outcome STRING, "
    "importance_score DOUBLE, has_content INT"
)
CITATIONS_DDL = "citing_case_id STRING, cited_case_id STRING, cited_reference STRING, citation_context STRING"
INDEX_DDL = "citation_string STRING, case_id STRING, jurisdiction STRING"
STATUTES_DDL = "law_name STRING, jurisdiction STRING, article STRING, text STRING, theme STRING"
LOCAL_CASES_DDL = (
    "case_name STRING, jurisdiction STRING, court STRING, year INT, result STRING, summary STRING, "
    "domain STRING, keywords ARRAY<STRING>, topic STRING"
)


def read_table(spark: SparkSession, path: str, jurisdiction: str | None = None, ddl: str | None = None) -> DataFrame:
    """A corpus table; a jurisdiction reads only its partition."""
    reader = spark.read.schema(ddl) if ddl else spark.read
    df = reader.parquet(path)
    return df.where(F.col("jurisdiction") == jurisdiction) if jurisdiction else df


def read_list(spark: SparkSession, path: str, ddl: str, strict: bool = True) -> DataFrame:
    """Records of JSON files that each hold one list.

    A file that holds anything else is an error, or no rows with ``strict=False``.
    """
    files = spark.read.text(path, wholetext=True)
    body = F.trim("value")
    is_list = body.startswith("[") & F.from_json(body, f"array<struct<{_as_fields(ddl)}>>").isNotNull()
    if strict:
        checked = F.when(is_list, body).otherwise(F.raise_error(F.lit("the file must contain a list")))
    else:
        checked = F.when(is_list, body)
    return files.select(F.inline(F.from_json(checked, f"array<struct<{_as_fields(ddl)}>>")))


def _as_fields(ddl: str) -> str:
    return StructType.fromDDL(ddl).simpleString()[len("struct<"):-1]


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write partitioned by jurisdiction.

    A jurisdiction may hold half of all cases, so rows are spread over several
    tasks inside each one; file sizes are left to the adaptive rebalance.
    """
    df.hint("rebalance", "jurisdiction").write.mode(mode).partitionBy("jurisdiction").parquet(path)


def write_edges(df: DataFrame, table: str, buckets: int = 512) -> None:
    """Save edges as a table bucketed by the cited case, for joins without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, "cited_case_id").sortBy("cited_case_id").saveAsTable(table)
