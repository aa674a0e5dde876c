"""How a citing context treats the cited case, and how high a court ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.fixed import treatment as T
from lexspark.functions.text import contains_any, first_contained


def _words(table: dict[str, list[str]]) -> list[str]:
    return [w.lower() for words in table.values() for w in words]


def _stems(words: list[str]) -> list[str]:
    """Words that contain no other word of the list: enough to tell whether any occurs."""
    return [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]


_OVERRULING, _DISTINGUISHING = _words(T.OVERRULING_KEYWORDS), _words(T.DISTINGUISHING_KEYWORDS)


def treatment_type(context: Column) -> Column:
    """'overruling', 'distinguishing' or 'neutral'; overruling is tested first."""
    text = F.lower(context)
    return (
        F.when(contains_any(text, _stems(_OVERRULING)), "overruling")
        .when(contains_any(text, _stems(_DISTINGUISHING)), "distinguishing")
        .otherwise("neutral")
    )


def treatment_keyword(context: Column) -> Column:
    """The keyword that decided the treatment, NULL when neutral."""
    text = F.lower(context)
    kind = treatment_type(context)
    return F.when(kind == "overruling", first_contained(text, _OVERRULING)).when(
        kind == "distinguishing", first_contained(text, _DISTINGUISHING)
    )


def court_rank(court: Column, jurisdiction: Column, gb_is_uk: bool = True) -> Column:
    """Rank of a court in its jurisdiction, 0 the highest, 999 unknown.

    The hierarchy is kept under UK while corpora use GB; ``gb_is_uk`` reads one
    for the other.
    """
    name = F.lower(court)
    jur = F.when(jurisdiction == "GB", F.lit("UK")).otherwise(jurisdiction) if gb_is_uk else jurisdiction
    by_jurisdiction = None
    for code, levels in T.COURT_HIERARCHY.items():
        rank = None
        for i, level in enumerate(levels):
            rank = (F if rank is None else rank).when(F.contains(name, F.lit(level.lower())), i)
        by_jurisdiction = (F if by_jurisdiction is None else by_jurisdiction).when(jur == code, rank)
    return F.coalesce(by_jurisdiction, F.lit(T.UNKNOWN_RANK))
