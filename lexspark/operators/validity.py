"""Citing and cited cases, and what the citing cases say about validity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.fixed.treatment import UNKNOWN_RANK
from lexspark.functions.treatment import court_rank, treatment_keyword, treatment_type
from lexspark.operators.ranking import top_per_group
from lexspark.session import struct_rows

CASE_COLUMNS = ["case_name", "court", "jurisdiction", "decision_date"]


def citing_edges(citations: DataFrame, cases: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Resolved edges joined to their citing case; the treatment is read off before the join."""
    columns = CASE_COLUMNS if columns is None else columns
    edges = citations.where(F.col("cited_case_id").isNotNull()).select(
        "cited_case_id", "citing_case_id", "cited_reference", "citation_context",
    )
    return edges.join(
        cases.select(F.col("case_id").alias("citing_case_id"), *columns), "citing_case_id"
    )


def citing_cases(citations: DataFrame, cases: DataFrame, limit: int = 20) -> DataFrame:
    """Latest ``limit`` citing cases of every cited case, with their treatment."""
    order = [F.col("decision_date").desc_nulls_last(), F.col("citing_case_id"), F.col("cited_reference")]
    top = top_per_group(citing_edges(citations, cases), ["cited_case_id"], order, limit, rank="position")
    context = F.col("citation_context")
    return top.withColumn("treatment", treatment_type(context)).withColumn(
        "treatment_keyword", treatment_keyword(context)
    )


def cited_cases(citations: DataFrame, cases: DataFrame) -> DataFrame:
    """Every reference of every citing case; unresolved ones keep NULL case columns."""
    return citations.join(
        cases.select(F.col("case_id").alias("cited_case_id"), *CASE_COLUMNS), "cited_case_id", "left"
    ).select("citing_case_id", "cited_case_id", "cited_reference", "citation_context", *CASE_COLUMNS)


def overruling_cases(citations: DataFrame, cases: DataFrame) -> DataFrame:
    """One row per overruling citation: who overruled whom, the word used, and a higher court or not."""
    kind = treatment_type(F.col("citation_context"))
    hits = citing_edges(citations.where(kind == "overruling"), cases)
    target = cases.select(
        F.col("case_id").alias("cited_case_id"),
        court_rank(F.col("court"), F.col("jurisdiction")).alias("_target_rank"),
    )
    rank = court_rank(F.col("court"), F.col("jurisdiction"))
    return (
        hits.join(target, "cited_case_id")
        .withColumn("keyword", treatment_keyword(F.col("citation_context")))
        .withColumn("higher_court", rank < F.col("_target_rank"))
        .drop("_target_rank", "citation_context")
    )


def with_treatment(citations: DataFrame) -> DataFrame:
    """Edges with their ``treatment``: who grades them need not carry the contexts there."""
    return citations.withColumn("treatment", treatment_type(F.col("citation_context")))


def citation_treatment_counts(citations: DataFrame, cases: DataFrame) -> DataFrame:
    """Per cited case: citing, overruling and distinguishing citations, and the
    highest court among the overruling ones.

    The edges are reduced to the pair of ids and a treatment code before the
    join, and the join keeps only the rank of the citing court, so the one wide
    shuffle carries no text. Counts are partial aggregates. A column ``treatment`` is taken as it is.
    """
    treatment = F.col("treatment") if "treatment" in citations.columns else treatment_type(F.col("citation_context"))
    # a step of its own: named twice in one, the words would be looked for twice
    read = citations.where(F.col("cited_case_id").isNotNull()).select(
        "cited_case_id", "citing_case_id", treatment.alias("kind")
    )
    edges = read.select(
        "cited_case_id", "citing_case_id",
        F.when(F.col("kind") == "overruling", 1).otherwise(0).alias("overruling"),
        F.when(F.col("kind") == "distinguishing", 1).otherwise(0).alias("distinguishing"),
    )
    ranks = cases.select(
        F.col("case_id").alias("citing_case_id"),
        court_rank(F.col("court"), F.col("jurisdiction")).alias("citing_rank"),
    )
    return (
        edges.join(ranks, "citing_case_id")
        .groupBy("cited_case_id")
        .agg(
            F.count("*").alias("citing_count"),
            F.sum("overruling").alias("overruling_count"),
            F.sum("distinguishing").alias("distinguishing_count"),
            F.min(F.when(F.col("overruling") == 1, F.col("citing_rank"))).alias("overruling_rank"),
        )
    )


def case_validity(citations: DataFrame, cases: DataFrame) -> DataFrame:
    """Traffic-light signal of every case: red, yellow, green, or unknown without citing cases.

    "A citing court ranks higher than the target" holds exactly when the least
    overruling rank is below the target's, so the target joins the aggregate
    (one row per case) instead of the edges.
    """
    targets = cases.select(
        "case_id", court_rank(F.col("court"), F.col("jurisdiction")).alias("target_rank")
    )
    counts = citation_treatment_counts(citations, cases).withColumnRenamed("cited_case_id", "case_id")
    graded = targets.join(counts, "case_id", "left")
    n, over, dist = F.col("citing_count"), F.col("overruling_count"), F.col("distinguishing_count")
    higher = F.coalesce(F.col("overruling_rank"), F.lit(UNKNOWN_RANK)) < F.col("target_rank")
    signal = (
        F.when(n.isNull(), "unknown")
        .when((over > 0) & higher, "red")
        .when((over > 0) | (dist > 0), "yellow")
        .otherwise("green")
    )
    reason = (
        F.when(n.isNull(), F.format_string("No citing cases found for '%s'.", "case_id"))
        .when(
            (over > 0) & higher,
            F.format_string("Overruled by higher court. %d overruling citation(s) found.", over),
        )
        .when(
            over > 0,
            F.format_string(
                "Overruling language found in %d citation(s), but not from a clearly higher court. "
                "Manual review recommended.", over,
            ),
        )
        .when(
            dist > 0,
            F.format_string(
                "Distinguished or questioned in %d citation(s). Not overruled, but authority may be limited.",
                dist,
            ),
        )
        .otherwise(F.format_string("No negative treatment found among %d citing case(s).", n))
    )
    zero = F.lit(0).cast("bigint")
    return graded.select(
        "case_id", signal.alias("signal"), reason.alias("reason"),
        F.coalesce(n, zero).alias("citing_count"),
        F.coalesce(over, zero).alias("overruling_count"),
        F.coalesce(dist, zero).alias("distinguishing_count"),
    )


def validity_of(keys: DataFrame, citations: DataFrame, cases: DataFrame) -> DataFrame:
    """Signals for a table of case ids; an id that is no case is 'unknown'."""
    found = case_validity(citations, cases)
    return keys.select("case_id").distinct().join(found, "case_id", "left").select(
        "case_id",
        F.coalesce("signal", F.lit("unknown")).alias("signal"),
        F.coalesce("reason", F.format_string("Case '%s' not found in database.", "case_id")).alias("reason"),
        *[
            F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
            for c in ("citing_count", "overruling_count", "distinguishing_count")
        ],
    )


def degrees(citations: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(case_id, cites_count, cited_by_count) in one pass over the edges.

    With ``cases``, an incoming edge counts only if its citing case exists.
    """
    if cases is not None:
        known = cases.select(F.col("case_id").alias("citing_case_id"), F.lit(1).alias("_known"))
        citations = citations.select("citing_case_id", "cited_case_id").join(known, "citing_case_id", "left")
        incoming = F.when(F.col("_known").isNotNull(), F.col("cited_case_id"))
    else:
        incoming = F.col("cited_case_id")
    ends = struct_rows("case_id o i", (F.col("citing_case_id"), 1, 0), (incoming, 0, 1))
    return (
        citations.select(F.inline(ends))
        .where(F.col("case_id").isNotNull())
        .groupBy("case_id")
        .agg(F.sum("o").alias("cites_count"), F.sum("i").alias("cited_by_count"))
    )


def case_importance(citations: DataFrame, cases: DataFrame) -> DataFrame:
    """Every case with the number of cases citing it and of references it makes."""
    columns = ["case_id", "case_name", "jurisdiction", "court", "importance_score", "case_type", "subject_area", "outcome"]
    zero = F.lit(0).cast("bigint")
    return cases.select(*columns).join(degrees(citations, cases), "case_id", "left").select(
        *columns,
        F.coalesce("cited_by_count", zero).alias("cited_by_count"),
        F.coalesce("cites_count", zero).alias("cites_count"),
    )


def case_neighbours(citations: DataFrame, cases: DataFrame) -> DataFrame:
    """Long form of each case's neighbourhood: direction 'cited_by' or 'cites'."""
    names = ["case_name", "jurisdiction"]
    incoming = citing_edges(citations, cases, names).select(
        F.col("cited_case_id").alias("case_id"), F.lit("cited_by").alias("direction"),
        F.col("citing_case_id").alias("neighbour_id"), F.lit(None).cast("string").alias("cited_reference"), *names,
    )
    outgoing = cited_cases(citations, cases).select(
        F.col("citing_case_id").alias("case_id"), F.lit("cites").alias("direction"),
        F.col("cited_case_id").alias("neighbour_id"), "cited_reference", *names,
    )
    return incoming.unionByName(outgoing)
