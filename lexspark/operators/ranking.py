"""Top rows per group, and first rows by an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None
) -> DataFrame:
    """First ``k`` rows of each group.

    The rank filter lets Spark put a group limit in front of the shuffle, so a
    group that holds a third of all rows sends ``k`` rows per input task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_row_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The row with the least ``order`` of each group, by a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), order).alias("_row"))
        .select(*keys, "_row.*")
    )


def best_priority(df: DataFrame, request: str, priority: str) -> DataFrame:
    """All rows of each request that carry its least priority.

    The minimum is a partial aggregate; no request's rows meet in one task.
    """
    least = df.groupBy(request).agg(F.min(priority).alias(priority))
    return df.join(least, [request, priority], "left_semi")


def fill_by_priority(
    df: DataFrame, request: str, priority: str, seq: Column, per_source: int, limit: int | None
) -> DataFrame:
    """Rows in priority order up to ``limit`` per request, ``per_source`` per source.

    ``limit=None`` keeps every source.
    """
    capped = top_per_group(df, [request, priority], [seq], per_source, rank="_source_rank")
    if limit is None:
        return capped.drop("_source_rank")
    order = [F.col(priority), F.col("_source_rank")]
    return top_per_group(capped, [request], order, limit, rank="position").drop("_source_rank")
