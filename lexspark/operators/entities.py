"""Organisation names to registry entities, and entity profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.fixed import analytics as A
from lexspark.operators.matching import similar_join
from lexspark.operators.ranking import top_per_group
from lexspark.operators.substring import occurrences
from lexspark.session import write_out


def normalized_name(col: Column) -> Column:
    """Lower case, no punctuation, no leading 'the', no trailing legal forms."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", " "), r"\s+", " "))
    forms = "|".join(A.LEGAL_SUFFIXES)
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"(\s+({forms}))+$", ""), r"^the\s+", ""))


def entity_names(entities: DataFrame) -> DataFrame:
    """(canonical_id, name): canonical name, id and aliases of every entity."""
    names = F.array_distinct(
        F.concat(F.array("canonical_name", "canonical_id"), F.coalesce("aliases", F.array().cast("array<string>")))
    )
    return entities.select("canonical_id", F.explode(names).alias("name")).where(F.length("name") > 0)


def resolve_names(names: DataFrame, entities: DataFrame, column: str = "raw_name") -> DataFrame:
    """Distinct names with ``canonical_id``, ``confidence`` and ``match_level``.

    Exact, then normalised (both equi joins), then the most similar name at or
    above the threshold for what is left; the least id wins a tie. Unresolved
    names keep NULLs.
    """
    asked = names.select(F.col(column).alias("raw_name")).where(F.length(F.trim(column)) > 0).distinct()
    # a name is normalised once, after equal ones have met, so that all tasks share the work
    known = write_out(
        entity_names(entities).groupBy("name").agg(F.min("canonical_id").alias("canonical_id"))
        .withColumn("norm", normalized_name(F.col("name")))
    )
    registry = write_out(
        known.where(F.col("norm") != "").groupBy(F.col("norm").alias("_right")).agg(F.min("canonical_id").alias("canonical_id"))
    )
    exact = known.select(F.col("name").alias("raw_name"), F.struct(F.lit(0).alias("level"), "canonical_id").alias("exact"))
    near = registry.select(F.col("_right").alias("_left"), F.struct(F.lit(1).alias("level"), "canonical_id").alias("near"))
    tried = write_out(
        asked.withColumn("_left", normalized_name(F.col("raw_name"))).join(exact, "raw_name", "left").join(near, "_left", "left")
        .select("raw_name", "_left", F.coalesce("exact", "near").alias("m"))
    )
    direct = tried.where("m IS NOT NULL").select(
        "raw_name", "m.canonical_id",
        F.when(F.col("m.level") == 0, A.MATCH_CONFIDENCE["exact"]).otherwise(A.MATCH_CONFIDENCE["normalized"]).alias("confidence"),
        F.when(F.col("m.level") == 0, "exact").otherwise("normalized").alias("match_level"),
    )
    rest = tried.where("m IS NULL").select("raw_name", "_left")
    fuzzy = similar_join(rest, "_left", registry, "_right", A.RESOLVE_THRESHOLD).groupBy("raw_name").agg(
        F.min(F.struct((-F.col("similarity")).alias("d"), F.col("canonical_id").alias("id"))).alias("m")
    ).select(
        "raw_name", F.col("m.id").alias("canonical_id"), F.round(-F.col("m.d"), 3).alias("confidence"),
        F.lit("fuzzy").alias("match_level"),
    )
    left_over = rest.select("raw_name").join(fuzzy, "raw_name", "left")
    return direct.unionByName(left_over)


def candidate_entities(names: DataFrame, entities: DataFrame, limit: int = 5) -> DataFrame:
    """Registry entities that contain each asked name, after the resolved one; at most ``limit``."""
    # read twice below
    resolved = write_out(resolve_names(names, entities).where(F.col("canonical_id").isNotNull()))
    asked = names.select("raw_name").where(F.length(F.trim("raw_name")) > 0).distinct()
    texts = entity_names(entities).select("canonical_id", F.lower("name").alias("text"), F.lit(None).cast("string").alias("all"))
    keyed = asked.withColumn("key", F.lower("raw_name")).withColumn("scope", F.lit(None).cast("string"))
    # one call: the names are read once, an index of all their grams would not pay
    found = occurrences(keyed, texts, "text", "all", ["canonical_id"]).select("key", "canonical_id")
    hits = keyed.join(found, "key").select("raw_name", "canonical_id").distinct()
    extra = hits.join(resolved.select("raw_name", "canonical_id"), ["raw_name", "canonical_id"], "left_anti").select(
        "raw_name", "canonical_id", F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("match_level"),
    )
    order = [F.col("confidence").desc_nulls_last(), F.col("canonical_id")]
    top = top_per_group(resolved.unionByName(extra), ["raw_name"], order, limit, rank="position")
    return top.join(
        entities.select(
            "canonical_id", "canonical_name", "country_code", "entity_type", "industry", "parent_id",
            F.slice(F.array_sort(F.coalesce("aliases", F.array().cast("array<string>"))), 1, 5).alias("aliases_sample"),
        ),
        "canonical_id",
    )


def resolve_parties(party_rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """Party rows with ``normalized_entity_id`` where the match is confident enough."""
    sure = resolved.where(F.col("confidence") >= A.RESOLVE_THRESHOLD).select(
        "raw_name", F.col("canonical_id").alias("normalized_entity_id")
    )
    return party_rows.join(sure, "raw_name", "left")


def search_entities(
    entities: DataFrame, query: str | None = None, country_code: str | None = None,
    entity_type: str | None = None, industry: str | None = None, limit: int = 20,
) -> DataFrame:
    """Registry filter by name, country, type and industry; first ``limit`` by id."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    rows = entities
    if query:
        q = F.lit(query.lower())
        rows = rows.where(
            F.contains(F.col("canonical_id"), q) | F.contains(F.lower("canonical_name"), q)
            | F.exists(aliases, lambda a: F.contains(F.lower(a), q))
        )
    if country_code:
        rows = rows.where(F.col("country_code") == country_code.upper())
    if entity_type:
        rows = rows.where(F.col("entity_type") == entity_type.lower())
    if industry:
        rows = rows.where(F.contains(F.lower("industry"), F.lit(industry.lower())))
    return rows.select(
        "canonical_id", "canonical_name", "country_code", "entity_type", "industry", "parent_id",
        F.size(aliases).alias("alias_count"),
    ).orderBy("canonical_id").limit(limit)


def search_terms_of(entities: DataFrame, group: bool = False) -> DataFrame:
    """(canonical_id, term): names an entity is searched by; with ``group`` also its parent's and children's."""
    own = entity_names(entities).select("canonical_id", F.col("name").alias("term"))
    if not group:
        return own.distinct()
    family = entities.where(F.col("parent_id").isNotNull()).select("canonical_id", "parent_id")
    relatives = entities.select(
        F.col("canonical_id").alias("relative"),
        F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term"),
    )
    links = family.select("canonical_id", F.col("parent_id").alias("relative")).unionByName(
        family.select(F.col("parent_id").alias("canonical_id"), F.col("canonical_id").alias("relative"))
    )
    known = entities.select("canonical_id")
    near = links.join(known, "canonical_id", "left_semi").join(relatives, "relative").select("canonical_id", "term")
    return own.unionByName(near).distinct()


def entity_activity(terms: DataFrame, entities: DataFrame, stats: DataFrame) -> DataFrame:
    """(canonical_id, source, n): data points whose title mentions a search term, in the entity's country."""
    owners = terms.join(entities.select("canonical_id", "country_code"), "canonical_id").where(F.col("country_code").isNotNull()).select(
        F.lower("term").alias("key"), F.col("country_code").alias("scope"), "canonical_id"
    ).distinct()
    rows = stats.where(F.col("jurisdiction").isNotNull()).select(
        F.col("jurisdiction").alias("scope"), "source", "seq", F.lower("title").alias("text")
    )
    found = occurrences(owners, rows, "text", "scope", ["source", "seq"])
    return (
        owners.join(found, ["key", "scope"]).select("canonical_id", "source", "seq").distinct()
        .groupBy("canonical_id", "source").agg(F.count("*").alias("n"))
    )


def entity_totals(activity: DataFrame) -> DataFrame:
    """(canonical_id, sources_with_data, total_data_points)."""
    return activity.groupBy("canonical_id").agg(
        F.count("*").alias("sources_with_data"), F.sum("n").alias("total_data_points")
    )
