"""Snapshots of statistics and the changes between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.fixed.analytics import CHANGE_RULES

KEY = ["source_id", "indicator", "country_code"]


def snapshot_rows(stats: DataFrame, source_id: str | None = None) -> DataFrame:
    """Current value of every indicator, stamped: the row with the highest seq."""
    rows = stats.select(
        F.col("source").alias("source_id"), "indicator", F.col("jurisdiction").alias("country_code"), "value", "seq"
    )
    if source_id:
        rows = rows.where(F.col("source_id") == source_id)
    return rows.groupBy(*KEY).agg(F.max_by("value", "seq").alias("value")).withColumn(
        "snapshot_ts", F.current_timestamp()
    )


def take_snapshot(stats: DataFrame, path: str, source_id: str | None = None) -> None:
    """Append the current values to the snapshot store."""
    snapshot_rows(stats, source_id).write.mode("append").partitionBy("source_id").parquet(path)


def snapshot_counts(snapshot: DataFrame) -> DataFrame:
    """One row: indicators saved and sources processed."""
    by_source = snapshot.groupBy("source_id").agg(F.count("*").alias("n"))
    return by_source.agg(F.sum("n").alias("snapshots_saved"), F.count("*").alias("sources_processed"))


def severity(change: Column) -> Column:
    """Severity of a relative change in percent, NULL below every rule."""
    chain = None
    for name, least in sorted(CHANGE_RULES, key=lambda r: -r[1]):
        chain = (F if chain is None else chain).when(F.abs(change) >= least, name)
    return chain


def severity_rank(name: Column) -> Column:
    order = [n for n, _ in sorted(CHANGE_RULES, key=lambda r: -r[1])]
    return F.array_position(F.array(*map(F.lit, order)), name)


def detect_changes(snapshots: DataFrame, at: str = "snapshot_ts") -> DataFrame:
    """Every snapshot value that differs enough from the previous one of its series."""
    previous = F.lag("value").over(Window.partitionBy(*KEY).orderBy(at))
    change = F.when(F.col("old_value") != 0, (F.col("new_value") - F.col("old_value")) / F.abs("old_value") * 100.0)
    rows = (
        snapshots.withColumn("old_value", previous)
        .withColumnRenamed("value", "new_value").withColumnRenamed(at, "detected_at")
        .withColumn("change_pct", change)
        .withColumn("severity", severity(F.col("change_pct")))
        .where(F.col("severity").isNotNull())
    )
    label = F.concat_ws(" ", "source_id", "indicator", "country_code")
    return rows.select(
        F.concat(F.lit("change_"), F.col("severity")).alias("rule_id"), "severity",
        F.concat(label, F.when(F.col("change_pct") > 0, " rose").otherwise(" fell")).alias("title"),
        F.format_string("%s changed by %.1f%%", label, "change_pct").alias("description"),
        *KEY, "old_value", "new_value", "change_pct", "detected_at",
    )


def latest_changes(snapshots: DataFrame, at: str = "snapshot_ts") -> DataFrame:
    """Changes between the last two snapshots of each series, by two partial aggregates."""
    last = snapshots.groupBy(*KEY).agg(F.max(at).alias("_last"))
    marked = snapshots.join(last, KEY)
    before = marked.where(F.col(at) < F.col("_last")).groupBy(*KEY).agg(F.max(at).alias("_before"))
    pair = marked.join(before, KEY).where(F.col(at).isin(F.col("_last"), F.col("_before")))
    return detect_changes(pair.drop("_last", "_before"), at)


def filter_events(
    events: DataFrame, severity_is: str | None = None, source_id: str | None = None,
    country_code: str | None = None, limit: int = 20,
) -> DataFrame:
    """Events by severity, then the most recent, first ``limit``."""
    rows = events
    for column, value in (("severity", severity_is), ("source_id", source_id), ("country_code", country_code)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows.orderBy(
        severity_rank(F.col("severity")), F.col("detected_at").desc(), *KEY
    ).limit(limit)


def event_history(
    events: DataFrame, days_back: int = 30, severity_is: str | None = None, country_code: str | None = None,
    limit: int = 20, now: Column | None = None,
) -> DataFrame:
    """Recorded events of the last ``days_back`` days."""
    now = F.current_timestamp() if now is None else now
    recent = events.where(F.col("detected_at").cast("timestamp") >= now - F.make_dt_interval(F.lit(days_back)))
    return filter_events(recent, severity_is, None, country_code, limit)
