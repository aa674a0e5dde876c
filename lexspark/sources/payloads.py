"""JSON and XML payloads of legal APIs to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import basic_entities, leading_year, year_in_text
from lexspark.session import blank_to_null


# ---- JSON -------------------------------------------------------------------

def _items(payloads: DataFrame, *paths: str) -> DataFrame:
    """(url, position, item): elements of the first non-empty list among the JSON paths, as JSON text."""
    lists = [F.from_json(F.get_json_object("payload", p), "array<string>") for p in paths]
    first = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    return payloads.select("url", F.posexplode(first).alias("position", "item"))


def pick(item: Column, *keys: str) -> Column:
    """First non-empty field among ``keys``, trimmed; NULL if none."""
    return F.coalesce(*[blank_to_null(F.trim(F.get_json_object(item, f"$.{k}"))) for k in keys])


def _or_blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def patent_board(payloads: DataFrame) -> DataFrame:
    """Patent board proceedings."""
    i = F.col("item")
    number = pick(i, "proceeding_number", "proceedingNumber", "trial_number")
    patent = pick(i, "patent_number", "patentNumber")
    joined = blank_to_null(F.concat_ws(" - ", number, patent))
    name = F.coalesce(
        pick(i, "case_name", "proceeding_title", "proceeding_number", "application_number"), joined,
        F.lit("PTAB Proceeding"),
    )
    status = pick(i, "result", "disposition", "status", "proceeding_status")
    decision = pick(i, "decision_type", "trial_type")
    filed = pick(i, "filing_date", "filingDate", "decision_date", "decisionDate")
    return _items(payloads, "$", "$.proceedings", "$.results", "$.items", "$.data").select(
        "url", "position", name.alias("case_name"), F.lit("US").alias("jurisdiction"), F.lit("PTAB").alias("court"),
        leading_year(filed).alias("year"), F.coalesce(status, decision, F.lit("Unknown")).alias("result"),
        F.coalesce(blank_to_null(F.concat_ws(" | ", decision, status, filed)), name).alias("text"),
        F.coalesce(pick(i, "url", "detail_url", "document_url", "proceeding_url"), F.col("url")).alias("source_url"),
        F.lit("ptab").alias("_source"),
    )


def us_opinions(payloads: DataFrame) -> DataFrame:
    """United States opinions of a search response."""
    i = F.col("item")
    name = _or_blank(pick(i, "caseName", "caseNameFull"))
    court = _or_blank(pick(i, "court", "court_citation_string"))
    filed, docket = pick(i, "dateFiled"), _or_blank(pick(i, "docketNumber"))
    path = pick(i, "absolute_url")
    snippets = F.transform(
        F.from_json(F.get_json_object(i, "$.opinions"), "array<struct<snippet: string>>"), lambda o: F.trim(o["snippet"])
    )
    parts = F.array(
        name, F.when(court != "", F.concat(F.lit("Court: "), court)), F.concat(F.lit("Filed: "), filed),
        F.when(docket != "", F.concat(F.lit("Docket: "), docket)),
    )
    lines = F.filter(
        F.concat(parts, F.coalesce(snippets, F.array().cast("array<string>"))), lambda x: F.length(x) > 0
    )
    return _items(payloads, "$.results").select(
        "url", "position", name.alias("case_name"), F.lit("US").alias("jurisdiction"), court.alias("court"),
        leading_year(filed).alias("year"), docket.alias("result"), F.array_join(lines, "\n").alias("text"),
        _or_blank(F.concat(F.lit("https://www.courtlistener.com"), path)).alias("source_url"),
        F.lit("courtlistener_search_api").alias("_source"),
    )


def human_rights_cases(payloads: DataFrame) -> DataFrame:
    """European human-rights judgments."""
    i = F.get_json_object("item", "$.columns")
    day = _or_blank(pick(i, "judgementdate", "kpdate"))
    number, ecli, item = pick(i, "appno"), pick(i, "ecli"), pick(i, "itemid")
    return _items(payloads, "$.results").select(
        "url", "position", _or_blank(pick(i, "docname")).alias("case_name"), F.lit("ECHR").alias("jurisdiction"),
        F.lit("European Court of Human Rights").alias("court"), year_in_text(day).alias("year"),
        F.coalesce(F.substring(pick(i, "conclusion"), 1, 300), F.lit("Unknown")).alias("result"),
        _or_blank(F.concat(F.lit("https://hudoc.echr.coe.int/eng?i="), item)).alias("source_url"),
        F.coalesce(
            F.concat(F.lit("Application no. "), number), F.concat(F.lit("ECLI: "), ecli), day
        ).alias("summary"),
        pick(i, "respondent").alias("respondent"), F.lit("hudoc").alias("_source"),
    )


def canadian_cases(payloads: DataFrame, query: str = "", database: str = "scc") -> DataFrame:
    """Canadian case lists, narrowed to titles, citations or dockets that contain ``query``."""
    i = F.col("item")
    title = _or_blank(F.coalesce(pick(i, "title", "caseName"), blank_to_null(F.get_json_object(i, "$.caseId.en"))))
    citation, docket = _or_blank(pick(i, "citation")), _or_blank(pick(i, "docketNumber"))
    rows = _items(payloads, "$.cases")
    if query:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", title, citation, docket)), F.lit(query.lower())))
    return rows.select(
        "url", "position", title.alias("case_name"), F.lit("CA").alias("jurisdiction"), F.lit(database).alias("court"),
        year_in_text(_or_blank(pick(i, "decisionDate"))).alias("year"), F.lit("Unknown").alias("result"),
        F.when(citation != "", citation).otherwise(docket).alias("summary"), F.lit("canlii_api").alias("_source"),
    )


def canadian_legislation(payloads: DataFrame, query: str = "") -> DataFrame:
    """Canadian legislation lists."""
    i = F.col("item")
    title, citation = _or_blank(pick(i, "title", "name")), _or_blank(pick(i, "citation"))
    rows = _items(payloads, "$.legislations")
    if query:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", title, citation)), F.lit(query.lower())))
    return rows.select(
        "url", "position", title.alias("law_name"), F.lit("CA").alias("jurisdiction"), citation.alias("citation"),
        F.coalesce(pick(i, "type"), F.lit("statute")).alias("type"), F.lit("canlii_api").alias("_source"),
    )


def canadian_databases(payloads: DataFrame) -> DataFrame:
    i = F.col("item")
    return _items(payloads, "$.databases").select(
        "url", "position", pick(i, "databaseId").alias("database_id"), pick(i, "name").alias("name")
    )


def french_records(payloads: DataFrame, fund: str, decisions: bool = False) -> DataFrame:
    """French statutes, or court decisions with their chamber and solution."""
    i = F.col("item")
    keys = ("dateDecision", "dateTexte", "date") if decisions else ("dateTexte", "date")
    chamber = pick(i, "formation", "chamber")
    court = F.concat_ws(" - ", F.lit(fund), chamber) if decisions else F.lit(fund)
    result = F.coalesce(pick(i, "solution"), F.lit("Unknown")) if decisions else F.lit("Unknown")
    summary = pick(i, "resume", "sommaire", "id") if decisions else pick(i, "resume", "id")
    return _items(payloads, "$.results", "$.listResult").select(
        "url", "position", _or_blank(pick(i, "titre", "title", "id")).alias("case_name"),
        F.lit("FR").alias("jurisdiction"), court.alias("court"),
        year_in_text(_or_blank(pick(i, *keys))).alias("year"), result.alias("result"),
        _or_blank(summary).alias("summary"), pick(i, "id").alias("document_id"), F.lit("legifrance_api").alias("_source"),
    )


def swedish_statutes(payloads: DataFrame) -> DataFrame:
    """Swedish statutes of a document list."""
    i = F.col("item")
    page = "https://www.riksdagen.se/sv/dokument-och-lagar/dokument/svensk-forfattningssamling/"
    return _items(payloads, "$.dokumentlista.dokument").select(
        "url", "position", F.coalesce(pick(i, "titel", "undertitel", "id"), F.lit("Unknown")).alias("law_name"),
        F.lit("SE").alias("jurisdiction"),
        F.concat(F.lit(page), _or_blank(pick(i, "id")), F.lit("/")).alias("text"),
        F.lit("legislation").alias("theme"), _or_blank(pick(i, "datum")).alias("date"),
        F.lit("riksdagen_api").alias("_source"),
    )


# ---- XML --------------------------------------------------------------------

def _elements(xml: Column, name: str) -> Column:
    """Source text of the elements called ``name`` (namespace prefixes ignored); not nested in themselves."""
    return F.regexp_extract_all(xml, F.lit(rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>.*?</(?:\w+:)?{name}>"), F.lit(0))


def _inner(xml: Column, name: str) -> Column:
    return F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>", 1)


def _plain(xml: Column, glue: str = "") -> Column:
    return F.trim(basic_entities(F.regexp_replace(xml, "<[^>]+>", glue)))


def japanese_law_list(payloads: DataFrame, query: str = "") -> DataFrame:
    """(law_name, law_num) pairs of a law list, each once per payload."""
    rows = payloads.select("url", F.posexplode(_elements(F.col("payload"), "LawNameListInfo")).alias("position", "item"))
    item = F.col("item")
    rows = rows.select(
        "url", "position", _plain(_inner(item, "LawName")).alias("law_name"), _plain(_inner(item, "LawNo")).alias("law_num")
    ).where((F.col("law_name") != "") & (F.col("law_num") != ""))
    if query:
        rows = rows.where(F.contains(F.lower("law_name"), F.lit(query.strip().lower())))
    return rows.groupBy("url", "law_name", "law_num").agg(F.min("position").alias("position")).withColumn(
        "jurisdiction", F.lit("JP")
    )


def japanese_articles(payloads: DataFrame) -> DataFrame:
    """Articles of a law document with their title and whole text."""
    law = F.coalesce(
        blank_to_null(_plain(_inner(F.col("payload"), "LawTitle"))), blank_to_null(_plain(_inner(F.col("payload"), "LawName"))),
        F.lit(""),
    )
    rows = payloads.select(
        "url", law.alias("law_name"), F.posexplode(_elements(F.col("payload"), "Article")).alias("position", "item")
    )
    return rows.select(
        "url", "position", "law_name", F.lit("JP").alias("jurisdiction"),
        blank_to_null(_plain(_inner(F.col("item"), "ArticleTitle"))).alias("article"),
        _plain(F.col("item")).alias("text"), F.lit("egov").alias("_source"),
    )


def german_norms(payloads: DataFrame) -> DataFrame:
    """Norms of a law document; paragraphs joined by line breaks, empty norms dropped."""
    rows = payloads.select("url", F.posexplode(_elements(F.col("payload"), "norm")).alias("position", "item"))
    item = F.col("item")
    paragraphs = F.filter(F.transform(_elements(item, "P"), lambda p: _plain(p, " ")), lambda t: t != "")
    return rows.select(
        "url", "position", _plain(_inner(item, "jurabk")).alias("law_name"), F.lit("DE").alias("jurisdiction"),
        blank_to_null(_plain(_inner(item, "enbez"))).alias("article"),
        F.trim(F.array_join(paragraphs, "\n")).alias("text"), blank_to_null(_plain(_inner(item, "titel"))).alias("theme"),
        F.lit("destatis").alias("_source"),
    ).where(F.col("article").isNotNull() | (F.col("text") != ""))


def dutch_entries(payloads: DataFrame) -> DataFrame:
    """Case entries of an Atom feed."""
    rows = payloads.select("url", F.posexplode(_elements(F.col("payload"), "entry")).alias("position", "item"))
    item = F.col("item")
    title, ecli = _plain(_inner(item, "title")), _plain(_inner(item, "id"))
    summary, updated = _plain(_inner(item, "summary")), _plain(_inner(item, "updated"))
    link = F.regexp_extract(item, r'<(?:\w+:)?link(?=[^>]*rel="alternate")[^>]*href="([^"]*)"', 1)
    return rows.select(
        "url", "position", title.alias("case_name"), F.lit("NL").alias("jurisdiction"),
        _or_blank(F.trim(F.get(F.split(title, ", "), F.lit(1)))).alias("court"),
        year_in_text(F.concat_ws(" ", ecli, updated)).alias("year"), F.lit("Unknown").alias("result"),
        F.when(summary != "-", summary).otherwise(title).alias("text"), link.alias("source_url"),
        ecli.alias("summary"), F.lit("rechtspraak_nl").alias("_source"),
    )
