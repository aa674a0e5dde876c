"""Landed records: ids, normal forms, and upserts into the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.fixed.jurisdictions import SOURCE_JURISDICTION
from lexspark.functions.text import keyword_tokens
from lexspark.session import blank_to_null, first_text

STANDARD_FIELDS = [
    "id", "case_id", "case_name", "case_number", "court", "decision_date", "text", "full_text",
    "plain_text", "summary", "source_url", "language",
]


def source_case_id(jurisdiction: Column) -> Column:
    """'JURISDICTION:id' from the first of id, case_id, source_url, else a hash of the record."""
    record = F.sha2(F.to_json(F.struct(*[F.col(c) for c in STANDARD_FIELDS])), 256)
    return F.concat_ws(":", jurisdiction, F.coalesce(first_text("id", "case_id", "source_url"), record))


def residual_json(extra: Column) -> Column:
    """The non-empty entries of a map of further fields as JSON, '{}' if none."""
    kept = F.map_filter(extra, lambda k, v: F.length(v) > 0)
    return F.when(F.size(kept) > 0, F.to_json(kept)).otherwise("{}")


def source_jurisdiction(source: Column) -> Column:
    """Jurisdiction a source delivers; an unlisted source by its first two letters."""
    table = F.create_map(*[F.lit(x) for kv in SOURCE_JURISDICTION.items() for x in kv])
    short = F.replace(F.replace(source, F.lit("leg"), F.lit("")), F.lit("law"), F.lit(""))
    return F.coalesce(F.try_element_at(table, source), F.substring(F.upper(short), 1, 2))


def landed_cases(raw: DataFrame, landed_at: Column | None = None) -> DataFrame:
    """Raw records (the standard fields, extra MAP, jurisdiction, adapter, seq) as case rows.

    With ``landed_at`` they carry it as ``crawled_at`` and ``updated_at``."""
    def text(c: str) -> Column:
        return F.coalesce(c, F.lit("")).alias(c)

    times = [] if landed_at is None else [landed_at.alias("crawled_at"), landed_at.alias("updated_at")]
    return raw.select(
        source_case_id(F.col("jurisdiction")).alias("case_id"), "jurisdiction",
        text("court"), text("case_name"), text("case_number"), text("decision_date"),
        F.coalesce(first_text("text", "full_text", "plain_text"), F.lit("")).alias("full_text"),
        text("summary"), text("source_url"), F.col("adapter").alias("source_adapter"), text("language"),
        residual_json(F.col("extra")).alias("raw_metadata"), "seq", *times,
    )


def upsert_cases(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per case_id over both tables, which share columns and a ``seq``.

    Stored rows come before new ones, and new ones in ``seq`` order. The longest
    text stays (the older on a tie), metadata and ``updated_at``, where there is one, are
    the newest, every other column keeps its first value. One partial aggregate, so any number of copies of a
    case are merged before the shuffle.
    """
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    newest = [c for c in ("raw_metadata", "updated_at") if c in rows.columns]
    first = [c for c in rows.columns if c not in ("case_id", "full_text", "seq", "_new", *newest)]
    order = F.struct("_new", "seq")
    longest = F.struct(F.length(F.coalesce("full_text", F.lit(""))), -F.col("_new"), -F.col("seq"))
    return rows.groupBy("case_id").agg(
        F.max_by("full_text", longest).alias("full_text"),
        *[F.max_by(c, order).alias(c) for c in newest],
        F.min_by(F.struct(*first), order).alias("_first"),
        F.max("seq").alias("seq"),
    ).select("case_id", "_first.*", "full_text", *newest, "seq")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``, each key once."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def new_citations(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges to append; an edge is one reference of one citing case."""
    return insert_new(old, new, ["citing_case_id", "cited_reference"])


def new_index_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    return insert_new(old, new, ["citation_string", "case_id", "jurisdiction"])


def crawl_ledger(landing: DataFrame) -> DataFrame:
    """Stored and failed records per source (``error`` NULL when stored)."""
    return landing.groupBy("source_adapter").agg(
        F.count_if(F.col("error").isNull()).alias("stored"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )


def normalized_cases(rows: DataFrame) -> DataFrame:
    """Case records with defaults for missing fields; at most two parties."""
    def text(c: str, default: str = "") -> Column:
        return F.coalesce(blank_to_null(c), F.lit(default)).alias(c)

    parties = F.when(F.size("parties") >= 2, F.slice("parties", 1, 2)).alias("parties")
    return rows.select(
        text("case_name"), F.upper(F.coalesce("jurisdiction", F.lit(""))).alias("jurisdiction"), text("court"),
        F.col("year").try_cast("int").alias("year"), text("result", "Unknown"), text("summary"),
        text("domain", "external"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        text("_source", "unknown"), parties,
        *[blank_to_null(c).alias(c) for c in ("citation", "ecli", "case_number", "full_text_url", "raw_id")],
    )


def normalized_statutes(rows: DataFrame) -> DataFrame:
    """Statute records with defaults for missing fields."""
    def text(c: str, default: str = "") -> Column:
        return F.coalesce(blank_to_null(c), F.lit(default)).alias(c)

    return rows.select(
        text("law_name"), F.upper(F.coalesce("jurisdiction", F.lit(""))).alias("jurisdiction"), "article",
        text("text"), "theme", text("_source", "unknown"),
        *[blank_to_null(c).alias(c) for c in ("law_id", "effective_date", "url")],
    )


def japanese_cases(rows: DataFrame, query: str, year_from: int | None = None) -> DataFrame:
    """Japanese court records with defaults; per source URL the last by seq, latest year first."""
    def text(c: str, default: str) -> Column:
        return F.coalesce(blank_to_null(F.trim(c)), F.lit(default))

    year = F.coalesce(F.col("year").try_cast("int"), F.lit(0))
    kept = rows.where(F.length(F.trim("source_url")) > 0)
    if year_from is not None:
        kept = kept.where((year == 0) | (year >= year_from))
    body = F.coalesce(blank_to_null(F.trim("text")), blank_to_null(F.trim("summary")), F.lit(""))
    out = kept.select(
        text("case_name", "事件").alias("case_name"), F.lit("JP").alias("jurisdiction"),
        text("court", "裁判所").alias("court"), year.alias("year"), text("result", "Unknown").alias("result"),
        body.alias("text"), F.trim("source_url").alias("source_url"),
        F.coalesce(blank_to_null(F.trim("summary")), F.substring(body, 1, 200)).alias("summary"),
        F.lit("external").alias("domain"), keyword_tokens(F.lit(query)).alias("keywords"),
        F.lit("courts_go_jp").alias("_source"), "seq",
    )
    rest = [c for c in out.columns if c not in ("source_url", "seq")]
    return out.groupBy("source_url").agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(
        "source_url", "r.*"
    ).orderBy(F.col("year").desc(), "source_url")
