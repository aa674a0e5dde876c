"""Citation strings in free text, with or without their places, by one Arrow-batched scan."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.fixed.citations import CITATION_PATTERNS
from lexspark.functions.spans import SpanFinder
from lexspark.session import write_out

_CANADIAN = ("ON", "BC", "QCC", "AB", "MB", "SK", "NS", "NB", "NLCA", "PECA", "TCC", "CMAC", "CanLII")
# A literal each pattern cannot match without, same order as the patterns. The
# regex then runs only over texts that contain it. An empty tuple: no literal.
_NEEDS = {
    "US": [("F.", "U.S.", "S.", "L."), ("U.S.",), ("v.",)],
    "EU": [("Application",), ("CELEX:",), ("Case",)],
    "UK": [("[",), ("[",)],
    "JP": [("判",), ("巻",)],
    "DE": [("BVerfG", "BGH", "BVerwG", "BAG", "BSG", "BFH"), ("Ni",), ("/",)],
    "IN": [("AIR",), ("SCC",)],
    "AU": [("[",), ("CLR",)],
    "FR": [
        ("Cass.",), ("pourvoi",), ("Bull.",), ("CE,",), ("CC,",), ("Cons.",), ("article",), ("JO",), ("Lebon",),
        ("D.", "JCP", "RTD"),
    ],
    "CA": [("SCR",), ("SCC",), ("FC",), _CANADIAN, ("DLR",)],
    "NZ": [("NZSC",), ("NZHC",), ("NZCA",), ("NZLR",)],
    "KR": [("대법원",), ("헌법재판소",), ("다",), ("헌",)],
    "BR": [("STF,",), ("RE",), ("STJ,",), ("REsp",), ("TJ",)],
    "CH": [("BGer",), ("BGE",), ("ATF",), ("DTF",), ("Urteil", "Arrêt")],
    "PL": [("/",), ("/",), ("/",), ("/",), ("Dz.U.",), ("OSN", "OSP"), ("/",)],
    "AT": [("VwGH",), ("VfGH",), ("BVwG",), ("OGH",), ("BGBl.",), ("Gz",)],
    "HK": [("HK",), ("HKLRD",)],
    "SG": [("SG",), ("SLR",)],
}


def _numbered() -> list[tuple[int, str, str, tuple[str, ...]]]:
    flat = [
        (code, pattern, needs)
        for code, patterns in CITATION_PATTERNS.items()
        for pattern, needs in zip(patterns, _NEEDS[code], strict=True)
    ]
    return [(i, *entry) for i, entry in enumerate(flat)]


# what five patterns share: most texts with a slash lack it
_PARTS = {r"\s+\d{1,4}/\d{2,4}": r"\s\d{1,4}/\d{2}"}


def extract_citations(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", jurisdiction: str = "jurisdiction"
) -> DataFrame:
    """(doc_id, citation_string, jurisdiction), each string once per document.

    Patterns of the document's own jurisdiction come first, then the others in
    table order; a string belongs to the first pattern that matched it. The
    texts are read once and never shuffled: only the matched strings are.
    """
    found = _found(docs, doc_id, text, jurisdiction, None)
    # one number orders as (foreign, pattern_no) does, and needs no sort to find its least
    many = F.lit(len(_numbered()))
    first = F.min(F.col("foreign") * many + F.col("pattern_no")).alias("w")
    return found.groupBy("id", "citation_string").agg(first).select(
        F.col("id").alias(doc_id), "citation_string", _jurisdiction(F.col("w") % many)
    )


def match_spans(text: Column, pattern: Column, width: Column) -> Column:
    """ARRAY<STRUCT<match, start, stop, context>> of a pattern's matches.

    ``split`` gives the text between the matches, so the running sum of both
    lengths is the offset of each match, in code points.
    """
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # one gap more than matches: the last pair has no match and is dropped at the end
    pieces = F.zip_with(
        matches, gaps,
        lambda m, g: F.struct(m.alias("m"), g.alias("gap"), F.length(m).alias("n")),
    )
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<match: STRING, start: INT, stop: INT>>)")
    walked = F.aggregate(
        pieces,
        F.struct(F.lit(0).alias("pos"), empty.alias("out")),
        lambda acc, p: F.struct(
            (acc["pos"] + p["gap"] + p["n"]).alias("pos"),
            F.concat(
                acc["out"],
                F.array(F.struct(
                    p["m"].alias("match"),
                    (acc["pos"] + p["gap"]).alias("start"),
                    (acc["pos"] + p["gap"] + p["n"]).alias("stop"),
                )),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.transform(
        F.filter(walked, lambda s: s["match"].isNotNull()),
        lambda s: F.struct(
            s["match"].alias("match"), s["start"].alias("start"), s["stop"].alias("stop"),
            F.substr(
                text,
                F.greatest(s["start"] - width, F.lit(0)) + 1,
                s["stop"] + width - F.greatest(s["start"] - width, F.lit(0)),
            ).alias("context"),
        ),
    )


def extract_citations_with_context(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    jurisdiction: str = "jurisdiction",
    width: int = 50,
) -> DataFrame:
    """As ``extract_citations``, plus position and surrounding text of the first match.

    One Arrow-batched scan finds all patterns of a text (``spans``); a string leaves its
    row once. What the rows give is written out, strings of one text beside each other; only
    those of ids that several rows share are grouped after that.
    """
    found = write_out(_found(docs, doc_id, text, jurisdiction, width, F.monotonically_increasing_id()))
    shared = found.groupBy("id").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least < most").select(F.col("id").alias("_id"))
    shared = write_out(shared)
    parts = "pattern_no", "start", "stop", "context"
    rows = found.select("id", "citation_string", *parts)
    if not shared.isEmpty():
        same = F.col("id").eqNullSafe(F.col("_id"))
        order = F.struct("foreign", "pattern_no", "match_no", "start", "context")
        merged = found.join(shared, same, "left_semi").groupBy("id", "citation_string").agg(F.min_by(F.struct(*parts), order).alias("w"))
        rows = rows.join(shared, same, "left_anti").unionByName(merged.select("id", "citation_string", "w.*"))
    return rows.select(F.col("id").alias(doc_id), "citation_string", _jurisdiction(F.col("pattern_no")), "start", "stop", "context")


def _jurisdiction(number: Column) -> Column:
    by_number = F.array(*[F.lit(code) for _, code, _, _ in _numbered()])
    return F.get(by_number, number).alias("jurisdiction")


def _found(docs: DataFrame, doc_id: str, text: str, jurisdiction: str, width: int | None, row: Column | None = None) -> DataFrame:
    """(id, citation_string, foreign, pattern_no), and (match_no, start, stop, context, row) with a ``width``: one row per text and matched string."""
    placed = "" if width is None else ", match_no int, start int, stop int, context string, row bigint"
    return docs.select(
        F.col(doc_id).alias("id"), F.col(text).alias("body"), F.upper(F.col(jurisdiction)).alias("own"), *([] if row is None else [row.alias("row")]),
    ).where("body IS NOT NULL").mapInArrow(
        _spans(width), f"id {docs.schema[doc_id].dataType.simpleString()}, citation_string string, foreign int, pattern_no int{placed}"
    )


def _spans(width: int | None):
    """Arrow batches of (id, body, own) to one row per text and matched string, with places where a ``width`` is given."""
    numbered = [(code, pattern, needs) for _, code, pattern, needs in _numbered()]
    names = ["id", "citation_string", "foreign", "pattern_no"]
    types = [pa.string(), pa.int32(), pa.int32()]
    if width is not None:
        names, types = [*names, "match_no", "start", "stop", "context"], [*types, *[pa.int32()] * 3, pa.string()]

    def rows(batch: pa.RecordBatch, finder: SpanFinder):
        # the number of the text in the batch stands for its id
        for at, (body, own) in enumerate(zip(batch.column("body").to_pylist(), batch.column("own").to_pylist(), strict=True)):
            first = {}
            for number, n, start, stop in finder.find(body):
                key = (int(numbered[number][0] != own), number, n, start, stop)
                string = body[start:stop]
                if string not in first or key < first[string]:
                    first[string] = key
            for string, (foreign, number, n, start, stop) in first.items():
                if width is None:
                    yield at, string, foreign, number
                else:
                    yield at, string, foreign, number, n, start, stop, body[max(0, start - width) : stop + width]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = SpanFinder([(pattern, needs) for _, pattern, needs in numbered], _PARTS)
        for batch in batches:
            found = rows(batch, finder)
            while part := list(islice(found, 4096)):
                at, *columns = zip(*part, strict=True)
                arrays, at = [pa.array(c, t) for c, t in zip(columns, types, strict=True)], pa.array(at, pa.int32())
                of_row = [] if width is None else [batch.column("row").take(at)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(at), *arrays, *of_row], [*names, "row"][: 1 + len(arrays) + len(of_row)])

    return find


def count_citations(docs: DataFrame, doc_id: str, text: str, jurisdiction: str) -> DataFrame:
    """Distinct citation strings per pattern jurisdiction over all documents."""
    return (
        extract_citations(docs, doc_id, text, jurisdiction)
        .groupBy("jurisdiction")
        .agg(F.count("*").alias("citations"), F.countDistinct(doc_id).alias("documents"))
    )
