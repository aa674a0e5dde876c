"""Citation strings to cases."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.text import citation_name_part, has_versus, normalize_citation
from lexspark.operators.substring import (
    ANY,
    SubstringIndex,
    containing,
    least_containing,
    read_substring_index,
    substring_index,
    write_substring_index,
)
from lexspark.session import struct_rows, write_out


class NameIndex(NamedTuple):
    """Substring indexes of the lower-cased case names, by jurisdiction, and of the case numbers."""

    names: SubstringIndex
    numbers: SubstringIndex


def _lowered(cases: DataFrame) -> DataFrame:
    return cases.select(
        "case_id", "jurisdiction", F.lower("case_name").alias("name"), F.lower("case_number").alias("number"), F.lit(None).cast("string").alias("all")
    )


def build_name_index(cases: DataFrame) -> NameIndex:
    """Index for ranks 4 and 5 of ``resolve_citations``; numbers are looked up whatever the jurisdiction."""
    lowered = _lowered(cases)
    return NameIndex(
        substring_index(lowered, "name", "jurisdiction", "case_id"), substring_index(lowered, "number", "all", "case_id")
    )


def write_name_index(cases: DataFrame, path: str) -> None:
    """Store the name index of ``cases`` under ``path``."""
    for part, index in build_name_index(cases)._asdict().items():
        write_substring_index(index, f"{path}/{part}")


def read_name_index(spark: SparkSession, path: str) -> NameIndex:
    return NameIndex(*(read_substring_index(spark, f"{path}/{part}") for part in NameIndex._fields))


def build_citation_index(cases: DataFrame) -> DataFrame:
    """(citation_string, case_id, jurisdiction): number, name and normalised name of each case."""
    forms = F.array("case_number", "case_name", normalize_citation(F.col("case_name")))
    return (
        cases.select("case_id", "jurisdiction", F.explode(forms).alias("citation_string"))
        .where(F.length("citation_string") > 2)
        .select("citation_string", "case_id", "jurisdiction")
        .dropDuplicates()
    )


def _lookup(kind: str, df: DataFrame, text: str) -> DataFrame:
    """Least case id per string within a jurisdiction, and over all of them."""
    scopes = F.explode(F.array(F.col("jurisdiction"), F.lit(ANY))).alias("scope")
    return df.where(F.col(text).isNotNull()).select(
        F.lit(kind).alias("kind"), F.col(text).alias("lookup"), scopes, "case_id"
    )


def resolve_citations(
    references: DataFrame, citation_index: DataFrame, cases: DataFrame, name_index: NameIndex | None = None
) -> DataFrame:
    """Resolve (citation_string, jurisdiction) pairs; jurisdiction may be NULL.

    Returns the distinct pairs with ``case_id`` and ``match_rank`` (NULL when
    unresolved): 1 exact string in the index, 2 normalised string, 3 exact case
    name, 4 case name contains the name part, 5 case number contains the
    string. The least case id wins inside a rank. Ranks 1 to 3 are one equi
    join on pre-aggregated lookups; only what they leave is looked up in a stored
    ``name_index``, or by default in one pass over ``cases``.
    """
    refs = references.select("citation_string", "jurisdiction").where(
        F.col("citation_string").isNotNull()
    ).distinct()
    refs = refs.withColumn("scope", F.coalesce("jurisdiction", F.lit(ANY)))
    name = F.when(has_versus(F.col("citation_string")), citation_name_part(F.col("citation_string")))

    cited, scope = F.col("citation_string"), F.col("scope")
    tries = struct_rows(
        "match_rank kind lookup scope",
        (1, "i", cited, scope), (2, "i", normalize_citation(cited), ANY), (3, "n", name, scope),
    )
    wanted = refs.select("citation_string", scope.alias("_scope"), F.inline(tries)).where(
        F.col("lookup").isNotNull()
    )
    lookup = (
        _lookup("i", citation_index, "citation_string")
        .unionByName(_lookup("n", cases, "case_name"))
        .groupBy("kind", "lookup", "scope")
        .agg(F.min("case_id").alias("case_id"))
    )
    exact = (
        wanted.join(lookup, ["kind", "lookup", "scope"])
        .groupBy("citation_string", F.col("_scope").alias("scope"))
        .agg(F.min(F.struct("match_rank", "case_id")).alias("hit"))
    )
    # every later step reads the outcome of this one, so it is written out once
    tried = write_out(refs.join(exact, ["citation_string", "scope"], "left"))
    rest = tried.where(F.col("hit").isNull()).drop("hit")
    lowered = _lowered(cases)
    by_name = _least_containing(
        rest.select("citation_string", "scope", F.lower(name).alias("_key")), lowered, "name", "jurisdiction", name_index and name_index.names
    ).withColumn("match_rank", F.lit(4))
    numbers = rest.select("citation_string", F.lit(ANY).alias("scope"), F.lower("citation_string").alias("_key")).distinct()
    by_number = rest.select("citation_string", "scope").join(
        _least_containing(numbers, lowered, "number", "all", name_index and name_index.numbers).drop("scope"), "citation_string"
    ).withColumn("match_rank", F.lit(5))
    contained = (
        by_name.unionByName(by_number)
        .groupBy("citation_string", "scope")
        .agg(F.min(F.struct("match_rank", "case_id")).alias("late"))
    )
    return tried.join(contained, ["citation_string", "scope"], "left").select(
        "citation_string", "jurisdiction", F.coalesce("hit", "late").alias("hit")
    ).select("citation_string", "jurisdiction", "hit.case_id", "hit.match_rank")


def _least_containing(wanted: DataFrame, cases: DataFrame, text: str, scope: str, index: SubstringIndex | None) -> DataFrame:
    """(citation_string, scope, case_id): the least case of the scope one of whose texts contains ``_key``."""
    if index is None:
        found = least_containing(wanted, cases, text, scope, "case_id", "_key")
    else:
        found = containing(wanted, index, "_key").groupBy("key", "scope").agg(F.min("least").alias("least"))
    found = found.select(F.col("key").alias("_key"), "scope", F.col("least").alias("case_id"))
    return wanted.join(found, ["_key", "scope"]).select("citation_string", "scope", "case_id")


def attach_resolution(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges (citing_case_id, citation_string, jurisdiction, ...) with ``cited_case_id``.

    ``resolved`` has one row per pair, so a reference that a third of all edges
    make is split by the skew join without copying rows.
    """
    hits = resolved.select(
        F.col("citation_string").alias("_cited"), F.col("jurisdiction").alias("_scope"),
        F.col("case_id").alias("cited_case_id"), "match_rank",
    )
    same = F.col("citation_string").eqNullSafe(F.col("_cited")) & F.col("jurisdiction").eqNullSafe(F.col("_scope"))
    return edges.join(hits, same, "left").drop("_cited", "_scope")
