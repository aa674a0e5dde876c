"""Result links of landed legal web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.fixed import links as L
from lexspark.functions.arrow import unescape_entities
from lexspark.functions.citations import match_spans
from lexspark.functions.text import U, collapse_spaces, contains_any, resolve_link, strip_tags
from lexspark.operators.ranking import top_per_group
from lexspark.session import blank_to_null

PROFILE_DDL = (
    "profile STRING, host STRING, tier INT, kind STRING, jurisdiction STRING, source STRING, "
    "min_title INT, anchor STRING, href_group INT, title_group INT, year_from_part STRING, "
    "year_pattern STRING, width INT, court_pattern STRING, court_upper BOOLEAN, court_name STRING, "
    "jurisdiction_pattern STRING, skip_href ARRAY<STRING>, skip_title STRING, keep_title STRING, "
    "keep_href STRING, unique_href BOOLEAN"
)


def link_profiles(spark: SparkSession) -> DataFrame:
    """The fixed profile table, one row per profile and tier."""
    rows = []
    for profile, host, tier, kind, jurisdiction, source, min_title, href in L.LINK_PROFILES:
        anchor, h, t = L.SPECIAL_ANCHORS.get((profile, tier), (L.ANCHOR.format(href=href), 1, 2))
        part, pattern = L.YEAR_RULES.get(profile, (None, None))
        court, upper = L.COURT_RULES.get(profile, (None, False))
        keep = L.KEEP_LINK.get(profile, (None, None, None, None))
        rows.append((
            profile, host, tier, kind, jurisdiction, source, min_title, anchor, h, t, part, pattern and U + pattern,
            L.CONTEXT_WIDTH.get(profile, 0), court, upper, L.COURT_NAMES.get(profile),
            L.JURISDICTION_RULES.get(profile), L.SKIP_HREF.get((profile, tier), []),
            L.SKIP_TITLE.get((profile, tier)), keep[1], keep[3], profile in L.UNIQUE_HREF,
        ))
    return spark.createDataFrame(rows, PROFILE_DDL)


def _group(text: Column, pattern: str, group: Column) -> Column:
    """``regexp_extract`` by the pattern in a column."""
    return F.call_function("regexp_extract", text, F.col(pattern), group)


def _clean_title(inner: Column) -> Column:
    return collapse_spaces(F.trim(unescape_entities(strip_tags(inner))))


def extract_links(pages: DataFrame, profiles: DataFrame | None = None, row_limit: int | None = None) -> DataFrame:
    """Links of (page_id, url, html) pages that their site's profile accepts.

    Pages meet profiles on the host (the profile table is a fixed short list).
    A later tier counts only where the earlier ones found nothing on the page.
    ``row_limit`` keeps the first links per page and profile.
    """
    if profiles is None:
        profiles = F.broadcast(link_profiles(pages.sparkSession))
    matched = pages.withColumn("host", F.try_parse_url("url", F.lit("HOST"))).join(profiles, "host")
    # offsets are worked out only for profiles that look around the match
    around = F.when(
        F.col("width") > 0, match_spans(F.col("html"), F.col("anchor"), F.col("width"))
    ).otherwise(
        F.transform(
            F.regexp_extract_all("html", F.col("anchor"), F.lit(0)),
            lambda m: F.struct(
                m.alias("match"), F.lit(0).alias("start"), F.lit(0).alias("stop"), m.alias("context")
            ),
        )
    )
    found = matched.select(
        "page_id", "url", "host", *[c for c in profiles.columns if c != "host"],
        # the outer form: the inner one would run the patterns again for a non-empty test
        F.posexplode_outer(around).alias("position", "found"),
    ).where(F.col("found").isNotNull())
    text = F.col("found.match")
    links = found.withColumn("href", _group(text, "anchor", F.col("href_group"))).withColumn(
        "inner", _group(text, "anchor", F.col("title_group"))
    )
    links = links.withColumn("title", _clean_title(F.col("inner"))).where(
        (F.length("title") >= F.col("min_title")) & (F.length("title") > 0)
    )
    skipped = F.exists("skip_href", lambda s: F.contains(F.col("href"), s)) | F.coalesce(
        F.regexp_like("title", F.col("skip_title")), F.lit(False)
    )
    wanted = (
        F.col("keep_title").isNull()
        | F.regexp_like("title", F.col("keep_title"))
        | F.regexp_like("href", F.col("keep_href"))
    )
    links = links.where(~skipped & wanted)
    # what follows the start of the match, for the profiles that look only forward
    after = F.substr(
        F.col("found.context"), F.least(F.col("found.start"), F.col("width")) + 1, F.length("found.context")
    )
    part = (
        F.when(F.col("year_from_part") == "href", F.col("href"))
        .when(F.col("year_from_part") == "title", F.col("title"))
        .when(F.col("year_from_part") == "context", F.col("found.context"))
        .when(F.col("year_from_part") == "after", after)
    )
    year = F.when(
        F.col("year_pattern").isNotNull(), _group(part, "year_pattern", F.lit(1))
    ).try_cast("int")
    # a two-digit year in the reference number of one profile
    short = F.regexp_extract("title", r"/(\d{2})\.", 1).try_cast("int")
    short_year = F.when(F.col("profile") == "ptleg", F.when(short < 50, short + 2000).otherwise(short + 1900))
    court = F.when(F.col("court_pattern").isNotNull(), _group(F.col("href"), "court_pattern", F.lit(1)))
    code = F.when(
        F.col("jurisdiction_pattern").isNotNull(),
        _group(F.col("href"), "jurisdiction_pattern", F.lit(1)),
    )
    links = links.select(
        "page_id", "profile", "tier", "kind", "position", "href", "title",
        resolve_link(F.col("href"), F.col("url")).alias("source_url"),
        F.coalesce(F.upper(F.replace(blank_to_null(code), F.lit("-"), F.lit("_"))), "jurisdiction").alias("jurisdiction"),
        F.coalesce("court_name", F.when(F.col("court_upper"), F.upper(court)).otherwise(court), F.lit("")).alias("court"),
        F.coalesce(short_year, year).alias("year"), F.col("source").alias("_source"), "unique_href",
    )
    best_tier = links.groupBy("page_id", "profile").agg(F.min("tier").alias("tier"))
    links = links.join(best_tier, ["page_id", "profile", "tier"], "left_semi")
    # first occurrence only, for profiles that list a link once
    key = F.when(F.col("unique_href"), F.col("href")).otherwise(F.col("position").cast("string"))
    links = links.withColumn("_key", key).groupBy("page_id", "profile", "_key").agg(
        F.min_by(F.struct(*[c for c in links.columns if c not in ("page_id", "profile")]), "position").alias("r")
    ).select("page_id", "profile", "r.*").drop("unique_href")
    if row_limit is not None:
        links = top_per_group(links, ["page_id", "profile"], [F.col("position")], row_limit)
    return links


def from_year(links: DataFrame, year: int) -> DataFrame:
    """Links of ``year`` or later; a link without a year stays."""
    return links.where(F.col("year").isNull() | (F.col("year") >= year))


def enforcement_links(links: DataFrame) -> DataFrame:
    """Links about enforcement, with the indicator they stand for.

    A strong word always qualifies, a weak one only in a longer title.
    """
    title = F.lower("title")
    strong = contains_any(title, L.STRONG_WORDS)
    weak = contains_any(title, L.WEAK_WORDS) & (F.length("title") >= L.WEAK_MIN_CHARS)
    indicator = (
        F.when(
            F.contains(title, F.lit("regulation")) | F.contains(F.lower("href"), F.lit("eur-lex")),
            "customs_ip_enforcement_regulation",
        )
        .when(contains_any(title, ["statistic", "facts", "figures"]), "customs_ip_enforcement_statistics")
        .otherwise("customs_ip_enforcement_publication")
    )
    return links.where(~F.col("href").rlike(L.LANGUAGE_SELECTOR)).where(strong | weak).withColumn(
        "indicator", indicator
    )


def enrich_from_details(links: DataFrame, details: DataFrame, text: Column, max_chars: int) -> DataFrame:
    """Add the text of each link's landed detail page (url, html); a missing page leaves the title."""
    pages = details.select(F.col("url").alias("source_url"), F.substring(text, 1, max_chars).alias("_detail"))
    pages = pages.groupBy("source_url").agg(F.max("_detail").alias("_detail"))
    return links.join(pages, "source_url", "left").withColumn(
        "text", F.coalesce(blank_to_null("_detail"), F.col("title"))
    ).drop("_detail")


def year_near(html: Column, pattern: str, width: int) -> Column:
    """Years within ``width`` characters of each match of ``pattern``, in match order."""
    return F.transform(
        match_spans(html, F.lit(pattern), F.lit(width)),
        lambda s: F.regexp_extract(s["context"], U + L.YEAR_WORD, 1).try_cast("int"),
    )
