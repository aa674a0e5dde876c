"""Predicates, lookups and truncating projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.fixed.jurisdictions import KNOWN_JURISDICTIONS
from lexspark.functions.text import compact_article
from lexspark.operators.ranking import top_per_group
from lexspark.operators.substring import SubstringIndex, containing, least_containing, substring_index
from lexspark.session import cut_lineage, first_text

TEXT_LIMIT, CITATION_LIMIT, CITATION_CHARS, SUMMARY_CHARS = 50000, 50, 200, 500


def known_jurisdiction(col: Column) -> Column:
    """Accepts a known code as written or upper-cased."""
    return F.upper(col).isin(KNOWN_JURISDICTIONS) | col.isin(KNOWN_JURISDICTIONS)


def unknown_jurisdictions(df: DataFrame, column: str = "jurisdiction") -> DataFrame:
    """Codes in use that are not known, with their row counts."""
    return df.where(~known_jurisdiction(F.col(column))).groupBy(column).agg(F.count("*").alias("n"))


def in_years(day: Column, year_from: Column, year_to: Column) -> Column:
    """Text comparison on 'YYYY-MM-DD'; a NULL bound is open, '' passes an upper bound only."""
    low = F.concat(year_from.cast("string"), F.lit("-01-01"))
    high = F.concat(year_to.cast("string"), F.lit("-12-31"))
    return (year_from.isNull() | (day >= low)) & (year_to.isNull() | (day <= high))


def equals_either(first: str, second: str, value: Column) -> Column:
    return (F.col(first) == value) | (F.col(second) == value)


def contains_all_words(query: str, *columns: str) -> Column:
    """Every word occurs in at least one of the columns, without regard to case."""
    test = F.lit(True)
    for word in query.split():
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(word.lower())), F.lit(False))
        test = test & hit
    return test


def cases_containing(
    query: str, cases: DataFrame, jurisdiction: str, k: int = 20
) -> DataFrame:
    """Search without an index: all words by substring, inside one jurisdiction."""
    if not jurisdiction:
        raise ValueError("jurisdiction filter required for substring search")
    rows = cases.where(F.col("jurisdiction") == jurisdiction).where(
        contains_all_words(query, "case_name", "full_text")
    )
    return rows.orderBy(
        F.col("has_content").desc(), F.col("importance_score").desc_nulls_last(), "case_id"
    ).limit(k)


def search_disputes(
    disputes: DataFrame, query: str | None = None, dispute_type: str | None = None,
    jurisdiction: str | None = None, k: int = 20,
) -> DataFrame:
    """Latest ``k`` disputes whose title or text contains ``query``."""
    rows = disputes
    if query:
        q = F.lit(query.lower())
        rows = rows.where(F.contains(F.lower("title"), q) | F.contains(F.lower("full_text"), q))
    if dispute_type:
        rows = rows.where(F.col("dispute_type") == dispute_type)
    if jurisdiction:
        rows = rows.where(F.col("jurisdiction") == jurisdiction)
    return rows.orderBy(F.col("decision_date").desc_nulls_last(), "dispute_id").limit(k)


def _any_keyword(space: Column, keywords: list[str] | None) -> Column:
    words = [k.strip().lower() for k in keywords or [] if k and k.strip()]
    if not words:
        return F.lit(True)
    return F.exists(F.array(*map(F.lit, words)), lambda k: F.contains(space, k))


def local_cases(
    cases: DataFrame, jurisdiction: str, topic: str = "", keywords: list[str] | None = None,
    year_from: int | None = None, year_to: int | None = None,
) -> DataFrame:
    """Listed cases of a jurisdiction: the topic must occur, and any of the keywords.

    A row without a year passes the range.
    """
    space = F.lower(
        F.concat_ws(
            " ", F.coalesce("topic", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("domain", F.lit("")),
            F.array_join("keywords", " "),
        )
    )
    rows = cases.where(F.upper("jurisdiction") == jurisdiction.strip().upper())
    if year_from is not None:
        rows = rows.where(F.col("year").isNull() | (F.col("year") >= year_from))
    if year_to is not None:
        rows = rows.where(F.col("year").isNull() | (F.col("year") <= year_to))
    if topic.strip():
        rows = rows.where(F.contains(space, F.lit(topic.strip().lower())))
    return rows.where(_any_keyword(space, keywords)).withColumn("_source", F.lit("local_json"))


def local_statutes(
    statutes: DataFrame, jurisdiction: str, law_name: str | None = None, article: str | None = None,
    keywords: list[str] | None = None,
) -> DataFrame:
    """Statutes of a jurisdiction by name and article substring and any keyword."""
    rows = statutes.where(F.upper("jurisdiction") == jurisdiction.strip().upper())
    for column, value in (("law_name", law_name), ("article", article)):
        if value and value.strip():
            rows = rows.where(F.contains(F.lower(column), F.lit(value.strip().lower())))
    space = F.lower(
        F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("law_name", "article", "text", "theme")])
    )
    return rows.where(_any_keyword(space, keywords)).withColumn("_source", F.lit("local"))


def article_matches(column: Column, article: str, exact: bool = False) -> Column:
    """Article labels compared without whitespace and case."""
    wanted = "".join(article.lower().split())
    label = compact_article(column)
    return (label == wanted) if exact else F.contains(label, F.lit(wanted))


def statutes_by_source(
    statutes: DataFrame, home: dict[str, str], law_name: str | None = None, article: str | None = None,
    keywords: list[str] | None = None,
) -> DataFrame:
    """Rows of each jurisdiction's home source that match, or its local rows if it has none."""
    rows = statutes
    for column, value in (("law_name", law_name), ("article", article)):
        if value and value.strip():
            rows = rows.where(F.contains(F.lower(column), F.lit(value.strip().lower())))
    space = F.lower(
        F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("law_name", "article", "text", "theme")])
    )
    rows = rows.where(_any_keyword(space, keywords))
    home_of = F.create_map(*[F.lit(x) for kv in home.items() for x in kv])
    priority = F.when(F.col("_source") == F.try_element_at(home_of, F.col("jurisdiction")), 1).when(
        F.col("_source") == "local", 2
    )
    rows = rows.withColumn("_priority", priority).where(F.col("_priority").isNotNull())
    least = rows.groupBy("jurisdiction").agg(F.min("_priority").alias("_priority"))
    return rows.join(least, ["jurisdiction", "_priority"], "left_semi").drop("_priority")


def case_id_index(cases: DataFrame) -> SubstringIndex:
    """Substring index of the case ids by jurisdiction, for ``find_cases``."""
    return substring_index(cases.select("case_id", "jurisdiction", F.col("case_id").alias("id")), "id", "jurisdiction", "case_id")


def find_cases(
    keys: DataFrame, cases: DataFrame, max_length: int | None = None, index: SubstringIndex | None = None
) -> DataFrame:
    """Cases by (case_id, jurisdiction) key: the exact id, else the least id in the
    jurisdiction that contains the key. Returns (key, key_jurisdiction, case_id).
    ``max_length`` leaves out longer keys; ``index`` is a stored ``case_id_index``."""
    if max_length is not None:
        keys = keys.where(F.length("case_id") <= max_length)
    asked = keys.where(F.length(F.trim("case_id")) > 0).select(
        F.col("case_id").alias("key"), F.col("jurisdiction").alias("key_jurisdiction")
    ).distinct()
    ids = cases.select(F.col("case_id").alias("key"), F.lit(True).alias("_exact")).distinct()
    # both branches read this one
    tried = cut_lineage(asked.join(ids, "key", "left"))
    exact = tried.where("_exact").select("key", "key_jurisdiction", F.col("key").alias("case_id"))
    rest = tried.where("_exact IS NULL AND key_jurisdiction IS NOT NULL")
    if index is None:
        texts = cases.select("case_id", "jurisdiction")
        inside = least_containing(rest, texts, "case_id", "jurisdiction", "case_id", "key", "key_jurisdiction")
    else:
        inside = containing(rest, index, "key", "key_jurisdiction").groupBy("key", "scope").agg(F.min("least").alias("least"))
    return exact.unionByName(inside.select("key", F.col("scope").alias("key_jurisdiction"), F.col("least").alias("case_id")))


def case_details(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """Truncated detail of every case: text to 50,000 characters, up to 50 citations of 200."""
    refs = top_per_group(
        citations.where(F.col("cited_reference").isNotNull()).select("citing_case_id", "cited_reference"),
        ["citing_case_id"], [F.col("cited_reference")], CITATION_LIMIT,
    )
    listed = refs.groupBy(F.col("citing_case_id").alias("case_id")).agg(
        F.array_sort(F.collect_list(F.substring("cited_reference", 1, CITATION_CHARS))).alias("citations")
    )
    text = F.coalesce("full_text", F.lit(""))

    def shown(c: str) -> Column:
        return F.coalesce(c, F.lit("")).alias(c)

    return cases.join(listed, "case_id", "left").select(
        "case_id", F.coalesce("case_name", F.lit("")).alias("title"), shown("case_number"),
        F.substring(text, 1, TEXT_LIMIT).alias("full_text"),
        F.coalesce(first_text("summary"), F.substring(text, 1, SUMMARY_CHARS)).alias("summary"),
        F.coalesce("decision_date", F.lit("")).alias("date"), shown("court"), shown("jurisdiction"),
        F.coalesce("citations", F.array().cast("array<string>")).alias("citations"),
        shown("source_url"), F.length(text).alias("text_length"),
    )


def search_suggestions(query: Column, jurisdiction: Column) -> Column:
    """Advice for a query that found nothing."""
    words = F.filter(F.split(F.trim(query), r"\s+"), lambda w: w != "")
    advice = F.array(
        F.when(
            F.size(words) > 3,
            F.concat(F.lit("Search for less: '"), F.array_join(F.slice(words, 1, 3), " "), F.lit("'")),
        ),
        F.when(
            (F.size(words) == 1) & (F.length(F.get(words, F.lit(0))) > 8),
            F.lit("Shorten the word"),
        ),
        F.when(
            jurisdiction != "ALL", F.lit("Drop the jurisdiction: 'ALL'")
        ),
        F.lit("Use a wider or a related word"),
        F.lit("Look at how names are spelled"),
    )
    return F.filter(advice, lambda a: a.isNotNull())
