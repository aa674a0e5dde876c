"""Counts, distributions and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.fixed import analytics as A
from lexspark.functions.text import contains_any
from lexspark.operators.filters import in_years
from lexspark.operators.ranking import top_per_group
from lexspark.operators.validity import degrees
from lexspark.session import first_text, struct_rows


def _or_unknown(column: str) -> Column:
    return F.coalesce(first_text(column), F.lit("unknown"))


def jurisdiction_counts(cases: DataFrame) -> DataFrame:
    """Exact cases per jurisdiction; only that column is read."""
    return cases.groupBy("jurisdiction").agg(F.count("*").alias("cases"))


def estimated_jurisdiction_counts(cases: DataFrame, fraction: float = 0.001, seed: int = 7, top: int = 100) -> DataFrame:
    """Counts extrapolated from a row sample, the ``top`` largest."""
    sampled = cases.select("jurisdiction").sample(fraction, seed)
    scaled = F.round(F.count("*") / fraction).cast("bigint").alias("cases")
    return sampled.groupBy("jurisdiction").agg(scaled).orderBy(F.desc("cases"), "jurisdiction").limit(top)


def corpus_totals(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """One row: total cases and total citations."""
    n = citations.agg(F.count("*").alias("n")).scalar()
    return cases.agg(F.count("*").alias("total_cases")).withColumn("total_citations", n)


def classification_stats(cases: DataFrame, top: int = 50) -> DataFrame:
    """(dimension, value, n): the ``top`` values of type, subject and outcome, in one pass."""
    dims = struct_rows("dimension value", *[(c, F.col(c)) for c in ("case_type", "subject_area", "outcome")])
    counts = (
        cases.select(F.inline(dims)).where(F.col("value").isNotNull())
        .groupBy("dimension", "value").agg(F.count("*").alias("n"))
    )
    return top_per_group(counts, ["dimension"], [F.desc("n"), F.col("value")], top)


def judge_names(raw_metadata: Column) -> Column:
    """The judges of a metadata text, which names one or lists several."""
    raw = F.get_json_object(raw_metadata, "$.judge_names")
    return F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), " ")).otherwise(raw)


def judge_cases(
    cases: DataFrame, judge: str, jurisdiction: str | None = None, year_from: int | None = None,
    year_to: int | None = None,
) -> DataFrame:
    """Cases whose listed judges contain ``judge``, without regard to case."""
    rows = cases.where(F.contains(F.lower(judge_names(F.col("raw_metadata"))), F.lit(judge.lower())))
    if jurisdiction:
        rows = rows.where(F.col("jurisdiction") == jurisdiction)
    return rows.where(in_years(F.col("decision_date"), F.lit(year_from).cast("int"), F.lit(year_to).cast("int")))


def judge_summary(rows: DataFrame) -> DataFrame:
    """One row: number of cases, first and last date."""
    day = first_text("decision_date")
    return rows.agg(
        F.count("*").alias("total_cases"), F.min(day).alias("earliest_date"), F.max(day).alias("latest_date")
    )


def distributions(rows: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, dimension, value, n) of several columns in one pass; empty values are 'unknown'."""
    keys = keys or []
    dims = struct_rows("dimension value", *[(c, _or_unknown(c)) for c in columns])
    return rows.select(*keys, F.inline(dims)).groupBy(*keys, "dimension", "value").agg(F.count("*").alias("n"))


def all_judges(cases: DataFrame) -> DataFrame:
    """(judge, case columns): one row per judge and case."""
    raw = F.get_json_object("raw_metadata", "$.judge_names")
    names = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    return cases.withColumn("judge", F.explode(F.array_distinct(names))).where(F.col("judge") != "")


def judge_overview(cases: DataFrame) -> DataFrame:
    """Cases, share of each side's wins and date range of every judge."""
    rows = all_judges(cases.select("raw_metadata", "outcome", "decision_date"))
    day = first_text("decision_date")
    return rows.groupBy("judge").agg(
        F.count("*").alias("total_cases"),
        F.count_if(F.col("outcome") == "plaintiff_win").alias("plaintiff_wins"),
        F.count_if(F.col("outcome").isin(A.WINNING_RESULTS)).alias("defendant_wins"),
        F.min(day).alias("earliest_date"), F.max(day).alias("latest_date"),
    )


def latest_cases(rows: DataFrame, k: int = 10) -> DataFrame:
    """Latest ``k`` cases."""
    return rows.orderBy(F.col("decision_date").desc_nulls_last(), "case_id").limit(k).select(
        "case_id", "case_name", "decision_date"
    )


# ---- importance and trends -------------------------------------------------

def scored_importance(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """Cases with ``citation_count`` and their importance enriched by citations, content and summary."""
    zero = F.lit(0).cast("bigint")
    n = F.length(F.coalesce("summary", F.lit("")))
    cites, cited = F.coalesce("cites_count", zero), F.coalesce("cited_by_count", zero)
    score = (
        F.coalesce("importance_score", F.lit(0.0)) + 0.5 * cites + 2.0 * cited
        + F.when(F.col("has_content") == 1, 5.0).otherwise(0.0)
        + F.when(n > 1000, 3.0).when(n > 200, 1.0).otherwise(0.0)
    )
    rows = cases.join(degrees(citations), "case_id", "left")
    return rows.withColumn("importance", F.round(score, 1)).withColumn("citation_count", cites + cited).drop(
        "cites_count", "cited_by_count"
    )


def trend_landmarks(scored: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The ``k`` most important cases per group with a line of text each."""
    top = top_per_group(scored, keys, [F.desc("importance"), F.col("case_id")], k, rank="position")
    line = F.format_string(
        "%s (%s, importance: %s, citations: %d)", "case_name", F.substring("decision_date", 1, 4),
        F.col("importance").cast("string"), "citation_count",
    )
    return top.withColumn("development", F.when(F.col("case_name") != "", line))


def trend_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cases per group and the years they span."""
    day = first_text("decision_date")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("case_count"), F.min(day).alias("first_date"), F.max(day).alias("last_date")
    )


# ---- intellectual-property statistics ---------------------------------------

def enforcement_profile(stats: DataFrame, year_from: int = 2020) -> DataFrame:
    """Watch status and seizure shares per jurisdiction.

    Priority watch beats watch list; the share is that of the last row by seq.
    """
    ind, src = F.col("indicator"), F.col("source")
    row = stats.where(F.col("year") >= year_from)
    priority = (src == "ustr301") & F.contains(ind, F.lit("priority_watch"))
    watch = (src == "ustr301") & F.contains(ind, F.lit("watch_list"))

    def last_share(mark: str) -> Column:
        test = (src == "enforcement") & F.contains(ind, F.lit(mark)) & F.contains(ind, F.lit("share"))
        return F.max_by("value", F.when(test, F.col("seq")))

    status = (
        F.when(F.count_if(priority) > 0, "Priority Watch List").when(F.count_if(watch) > 0, "Watch List")
    )
    relevant = F.count_if(src.isin("ustr301", "enforcement"))
    return row.groupBy("jurisdiction").agg(
        status.alias("special_301_status"), last_share("cbp").alias("cbp_seizure_share"),
        last_share("eu").alias("eu_seizure_share"),
        F.when(relevant == 0, "no_data").otherwise("ok").alias("status"),
    )


def indicator_catalogue(stats: DataFrame) -> DataFrame:
    """(source, indicator) pairs in use; one row per pair, so no list grows with the data."""
    return stats.select("source", "indicator").distinct()


def forum_comparison(stats: DataFrame, year: int = 2023) -> DataFrame:
    """The row of each forum's indicator for ``year``, else its first row from then on, else 'no_data'."""
    forums = stats.sparkSession.createDataFrame(
        [(i, *f) for i, f in enumerate(A.FORUM_INDICATORS)],
        "place INT, forum STRING, source STRING, indicator STRING, jurisdiction STRING",
    )
    wanted = F.lit(False)
    for _, source, indicator, _ in A.FORUM_INDICATORS:
        wanted = wanted | ((F.col("source") == source) & (F.col("indicator") == indicator))
    order = F.struct((F.col("year") != year).cast("int"), F.col("seq"))
    rows = stats.where(wanted & (F.col("year") >= year)).groupBy("source", "indicator", "jurisdiction").agg(
        F.min_by(F.struct("year", "value"), order).alias("r")
    )
    return forums.join(rows, ["source", "indicator", "jurisdiction"], "left").select(
        "forum", "indicator", "jurisdiction", F.col("r.year").alias("year"), F.col("r.value").alias("value"),
        F.when(F.col("r").isNull(), "no_data").otherwise("ok").alias("status"),
    )


def search_statistics(
    stats: DataFrame, indicator: str, year_from: int | None = None, limit: int = 10
) -> DataFrame:
    """Per jurisdiction: rows of the first source, by priority, that has the indicator."""
    home = F.create_map(*[F.lit(x) for kv in A.STATS_HOME_SOURCE.items() for x in kv])
    order = F.array(*map(F.lit, A.STATS_FALLBACK))
    place = F.array_position(order, F.col("source"))
    priority = F.when(F.col("source") == F.try_element_at(home, F.col("jurisdiction")), 0).when(place > 0, place)
    rows = stats.where(F.col("indicator") == indicator)
    if year_from is not None:
        rows = rows.where(F.col("year").isNull() | (F.col("year") >= year_from))
    rows = rows.withColumn("priority", priority.cast("int")).where(F.col("priority").isNotNull())
    least = rows.groupBy("jurisdiction").agg(F.min("priority").alias("priority"))
    best = rows.join(least, ["jurisdiction", "priority"], "left_semi")
    return top_per_group(best, ["jurisdiction"], [F.col("seq")], limit, rank="position")


def statistics_of_source(stats: DataFrame, source: str, indicator: str, limit: int = 10) -> DataFrame:
    """Rows of one named source per jurisdiction; an unknown source is an error."""
    if source not in A.STATS_SOURCES:
        raise ValueError(f"Unsupported source: {source}")
    rows = stats.where((F.col("source") == source) & (F.col("indicator") == indicator))
    return top_per_group(rows, ["jurisdiction"], [F.col("seq")], limit, rank="position")


def dispute_search(
    stats: DataFrame, query: str = "", year_from: int | None = None, limit: int = 10, source: str = "auto"
) -> DataFrame:
    """Rows whose indicator or title contains ``query``, per jurisdiction in source priority order.

    'auto' stops at ``limit`` rows, 'all' keeps every source (``limit`` rows
    each), any other value reads that source only.
    """
    if source not in ("auto", "all") and source not in A.DISPUTE_SOURCES:
        raise ValueError(f"Unsupported source: {source}")
    rows = stats
    if query:
        q = F.lit(query.strip().lower())
        rows = rows.where(F.contains(F.lower("indicator"), q) | F.contains(F.lower("title"), q))
    if year_from is not None:
        rows = rows.where(F.col("year").isNull() | (F.col("year") >= year_from))
    if source == "all":
        order = F.array(*map(F.lit, A.DISPUTE_SOURCES))
    elif source == "auto":
        lists = F.create_map(*[
            x for j, names in A.DISPUTE_PRIORITY.items() for x in (F.lit(j), F.array(*map(F.lit, names)))
        ])
        order = F.coalesce(
            F.try_element_at(lists, F.col("jurisdiction")), F.array(*map(F.lit, A.DISPUTE_DEFAULT_PRIORITY))
        )
    else:
        order = F.array(F.lit(source))
    rows = rows.withColumn("priority", F.array_position(order, F.col("source")).cast("int")).where("priority > 0")
    capped = top_per_group(rows, ["jurisdiction", "priority"], [F.col("seq")], limit, rank="source_position")
    if source == "all":
        return capped
    return top_per_group(
        capped, ["jurisdiction"], [F.col("priority"), F.col("source_position")], limit, rank="position"
    )


# ---- dispute profiles --------------------------------------------------------

def matched_cases(
    cases: DataFrame, entities: list[str], year_from: int | None = None, year_to: int | None = None
) -> DataFrame:
    """Cases whose name, summary or keywords mention one of the entities."""
    space = F.lower(
        F.concat_ws(" ", F.coalesce("case_name", F.lit("")), F.coalesce("summary", F.lit("")), F.array_join("keywords", " "))
    )
    rows = cases.where(contains_any(space, [e.lower() for e in entities]))
    if year_from:
        rows = rows.where(F.col("year").isNull() | (F.col("year") >= year_from))
    if year_to:
        rows = rows.where(F.col("year").isNull() | (F.col("year") <= year_to))
    return rows


def dispute_result(result: Column, summary: Column) -> Column:
    """'win', 'loss' or NULL from the words of result and summary."""
    said = F.lower(F.concat(F.coalesce(result, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit(""))))
    return F.when(contains_any(said, A.WIN_SIGNALS), "win").when(contains_any(said, A.LOSS_SIGNALS), "loss")


def dispute_profile(matched: DataFrame, group_by: list[str] | None = None) -> DataFrame:
    """Counts, wins and losses, years and enforcement likelihood, per group."""
    kind = dispute_result(F.col("result"), F.col("summary"))
    groups = group_by or []
    wins, losses = F.col("wins"), F.col("losses")
    return (
        matched.groupBy(*groups)
        .agg(
            F.count("*").alias("n_cases"), F.count_if(kind == "win").alias("wins"),
            F.count_if(kind == "loss").alias("losses"),
            F.min("year").alias("year_from"), F.max("year").alias("year_to"),
        )
        .withColumn("partial", F.col("n_cases") - wins - losses)
        .withColumn(
            "enforcement_likelihood",
            F.when(wins > losses, "High").when(wins == losses, "Medium").otherwise("Low"),
        )
        .withColumn(
            "low_sample_note",
            F.when(F.col("n_cases") < 10, "サンプルが限られているため傾向の信頼性は低い").otherwise(""),
        )
    )


def dispute_leaders(matched: DataFrame, k: int = 5) -> DataFrame:
    """(dimension, value, n): the ``k`` leading forums and sectors."""
    dims = struct_rows(
        "dimension value",
        ("forum", F.coalesce(first_text("court", "jurisdiction"), F.lit("unknown"))),
        ("sector", F.coalesce(first_text("topic", "domain"), F.lit("unknown"))),
    )
    counts = matched.select(F.inline(dims)).groupBy("dimension", "value").agg(F.count("*").alias("n"))
    return top_per_group(counts, ["dimension"], [F.desc("n"), F.col("value")], k, rank="position")


def sector_profile(cases: DataFrame, sector: str, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """A sector is profiled like an entity of that name."""
    return dispute_profile(matched_cases(cases, [sector], year_from, year_to))
