"""Result blocks and label tables inside landed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.arrow import unescape_entities
from lexspark.functions.text import basic_entities, celex_year, collapse_spaces, doc_id_from_path, strip_tags, year_in_text
from lexspark.session import blank_to_null


def _clean(col: Column) -> Column:
    return collapse_spaces(unescape_entities(strip_tags(col)))


def _blocks(pages: DataFrame, separator: str) -> DataFrame:
    """(page_id, position, block): what follows each separator."""
    parts = F.split("html", separator, -1)
    return pages.select(
        "page_id", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("position", "block")
    )


def eu_results(pages: DataFrame) -> DataFrame:
    """EU search results: title, CELEX number, year, journal reference, status.

    Consolidated texts, short and date-only titles and bare format links are
    dropped; a CELEX number counts once per page.
    """
    block = F.col("block")
    first = r'(?is)<a[^>]+href="[^"]*CELEX:(\d+[A-Z]\d+)[^"]*"[^>]*class="title"[^>]*>(.*?)</a>'
    second = r'(?is)<a[^>]+class="title"[^>]+href="[^"]*CELEX:(\d+[A-Z]\d+)[^"]*"[^>]*>(.*?)</a>'

    def either(group: int) -> Column:
        return F.coalesce(*[blank_to_null(F.regexp_extract(block, p, group)) for p in (first, second)])

    journal = F.regexp_extract(
        block, r'(?s)class="[^"]*textUnderTitle[^"]*showInPdf[^"]*"[^>]*>\s*<i>(.*?)</i>', 1
    )
    status = F.regexp_extract(block, r'(?s)class="forceIndicator"[^>]*>(.*?)</p>', 1)
    rows = _blocks(pages, r'<div[^>]*class="SearchResult"[^>]*>').select(
        "page_id", "position", either(1).alias("celex"), either(2).alias("_title"),
        journal.alias("_journal"), status.alias("_status"),
    )
    rows = rows.withColumn("title", _clean(F.col("_title"))).where(
        (F.length("title") >= 10) & ~F.col("title").rlike(r"^\d{2}/\d{2}/\d{4}$") & ~F.col("celex").startswith("0")
    )
    reference = F.regexp_extract(
        _clean(F.col("_journal")), r"^(OJ\s+[A-Z]\s+\d+,\s+[\d.]+,\s+pp?\.\s*[\d\s–-]+)", 1
    )
    out = rows.select(
        "page_id", "position", "title", F.concat(F.lit("CELEX:"), "celex").alias("work"),
        celex_year(F.col("celex")).alias("year"), F.lit("EU").alias("jurisdiction"),
        F.concat(F.lit("https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:"), "celex").alias("source_url"),
        F.trim(blank_to_null(reference)).alias("oj_reference"), blank_to_null(_clean(F.col("_status"))).alias("status"),
        F.lit("eurlex_html").alias("_source"),
    )
    rest = [c for c in out.columns if c not in ("page_id", "work")]
    return out.groupBy("page_id", "work").agg(F.min_by(F.struct(*rest), "position").alias("r")).select(
        "page_id", "work", "r.*"
    )


def indian_results(pages: DataFrame) -> DataFrame:
    """Result articles: title, court, year, snippet and document link."""
    block = F.col("block")
    heading = r'(?s)<h4\s+class="result_title">\s*(?:\[.*?\]\s*)?<a\s+href="([^"]+)"[^>]*>(.*?)</a>'
    rows = _blocks(pages, r'<article\s+class="result"').select(
        "page_id", "position", F.regexp_extract(block, heading, 1).alias("href"),
        F.regexp_extract(block, heading, 2).alias("_title"),
        F.regexp_extract(block, r'(?s)<div\s+class="headline">(.*?)</div>', 1).alias("_line"),
        F.regexp_extract(block, r'(?s)<span\s+class="docsource">(.*?)</span>', 1).alias("_court"),
    ).where(F.col("href") != "")
    number = doc_id_from_path(F.col("href"))
    rows = rows.withColumn("case_name", _clean(F.col("_title"))).where(F.col("case_name") != "")
    snippet = blank_to_null(F.substring(_clean(F.col("_line")), 1, 300))
    return rows.select(
        "page_id", "position", "case_name", F.lit("IN").alias("jurisdiction"), _clean(F.col("_court")).alias("court"),
        year_in_text(F.col("case_name")).alias("year"), F.lit("Unknown").alias("result"),
        F.coalesce(snippet, F.concat(F.lit("Doc ID: "), number)).alias("summary"),
        F.when(number != "", F.concat(F.lit("https://indiankanoon.org/doc/"), number, F.lit("/"))).otherwise("").alias("url"),
        F.lit("indiankanoon_web").alias("_source"),
    )


def preformatted_text(html: Column, min_chars: int = 50, max_chars: int = 5000) -> Column:
    """Judgment text of a page's <pre> blocks longer than ``min_chars``, joined and truncated."""
    raw = F.regexp_extract_all(html, F.lit(r"(?s)<pre[^>]*>(.*?)</pre>"), F.lit(1))
    parts = F.filter(
        F.transform(raw, lambda b: collapse_spaces(basic_entities(strip_tags(b)))), lambda t: F.length(t) > min_chars
    )
    full = F.array_join(parts, "\n")
    return F.when(F.length(full) > max_chars, F.concat(F.substring(full, 1, max_chars), F.lit("..."))).otherwise(full)


def label_table(html: Column) -> Column:
    """MAP<label, value> of two-cell table rows; the last value of a label wins."""
    rows = F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1))

    def pair(row: Column) -> Column:
        cells = F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
        label = F.regexp_replace(F.trim(F.regexp_replace(F.get(cells, F.lit(0)), "<[^>]+>", "")), ":+$", "")
        return F.struct(label.alias("label"), collapse_spaces(strip_tags(F.get(cells, F.lit(1)))).alias("value"))

    pairs = F.filter(
        F.transform(rows, pair), lambda p: (F.length(p["label"]) > 0) & (F.length(p["value"]) > 0)
    )
    return F.aggregate(
        pairs, F.expr("CAST(map() AS MAP<STRING, STRING>)"),
        lambda acc, p: F.map_concat(
            F.map_filter(acc, lambda k, _: k != p["label"]), F.create_map(p["label"], p["value"])
        ),
    )


def portuguese_judgments(pages: DataFrame) -> DataFrame:
    """Judgment records of detail pages laid out as label tables."""
    m = F.col("meta")

    def field(*labels: str) -> Column:
        return F.coalesce(*[F.try_element_at(m, F.lit(x)) for x in labels], F.lit(""))

    rows = pages.select("page_id", "url", label_table(F.col("html")).alias("meta"))
    process, day = field("Processo"), field("Data do Acordão", "Data do Acórdão")
    descriptors, area, summary = field("Descritores"), field("Área Temática"), F.substring(field("Sumário"), 1, 500)
    year = F.coalesce(
        F.regexp_extract(day, r"(\d{4})", 1).try_cast("int"), F.regexp_extract(process, r"(\d{4})", 1).try_cast("int")
    )
    decision = F.substring(field("Decisão"), 1, 100)

    def labelled(label: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(label), value))

    return rows.where(process != "").select(
        "page_id", process.alias("case_number"), field("Relator").alias("judge"), year.alias("year"),
        F.when(decision != "", decision).otherwise("Unknown").alias("result"),
        F.concat_ws(
            " | ", process, labelled("Descritores: ", descriptors), labelled("Área: ", area), labelled("Sumário: ", summary)
        ).alias("text"),
        F.lit("PT").alias("jurisdiction"), F.col("url").alias("source_url"), F.lit("dgsi_pt").alias("_source"),
    )
