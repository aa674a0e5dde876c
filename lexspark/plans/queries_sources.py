"""Named queries: landed pages, payloads, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.functions import text as TX
from lexspark.plans.registry import query
from lexspark.plans.views import jurisdiction_sql, load, with_views
from lexspark.session import shared_folder
from lexspark.sources import blocks as B
from lexspark.sources import landing as L
from lexspark.sources import links as LK
from lexspark.sources import payloads as PL
from lexspark.sources import store as ST


# ---- links ------------------------------------------------------------------------

_ANCHOR = '(?is)<a[^>]+href="({0})"[^>]*>(.*?)</a>'
_TITLE = (
    "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(m, '(?is)<a[^>]+href=\"([^\"]*)\"[^>]*>(.*?)</a>', 2), '<[^>]+>', ' ', 'g'),"
    " '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
)
_SITES = [
    ("zalaw", "www.saflii.org", 1, "ZA", "saflii", 5, r'/za/cases/[^"]+\.html', r"/cases/([^/]+)/", r"/(\d{4})/"),
    ("ghlaw", "ghalii.org", 1, "GH", "ghalii", 5, r'/akn/gh/judgment/[^"]+', r"/judgment/([a-z]+)/", r"(\d{4})"),
    ("tzlaw", "tanzlii.org", 2, "TZ", "tanzlii", 5, r'/en/akn/tz/act/[^"]+', r"/judgment/([^/]+)/", r"/(\d{4})/"),
    ("eeleg", "www.riigiteataja.ee", 2, "EE", "riigiteataja", 5, r'/en/eli/[^"]+', None, None),
    ("noleg", "lovdata.no", 1, "NO", "lovdata", 3, r'/(?:register|dokument|lov|forskrift|eli)/[^"]+', None, None),
    ("africanlii", "africanlii.org", 1, "ZA_GP", "africanlii", 5, r'/en/akn/[^"]+/judgment/[^"]+', r"/judgment/([^/]+)/", r"/(\d{4})/"),
    ("caleg", "laws-lois.justice.gc.ca", 1, "CA", "caleg_index", 3, r'/eng/(?:acts|regulations|Const|AnnualStatutes)/[^"]+', None, None),
]


def _links_sql() -> str:
    arms = []
    for profile, host, tier, jur, source, least, href, court, year in _SITES:
        rx = _ANCHOR.format(href).replace("'", "''")
        court_sql = f"regexp_extract(href, '{court}', 1)" if court else "''"
        if profile == "ghlaw":
            court_sql = f"upper({court_sql})"
        year_sql = f"TRY_CAST(regexp_extract(href, '{year}', 1) AS INT)" if year else "NULL::INT"
        arms.append(
            f"SELECT page_id, '{profile}' AS profile, {tier} AS tier, '{jur}' AS jurisdiction, '{source}' AS _source, href, title, {court_sql} AS court, {year_sql} AS year, root || href AS source_url"
            f" FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS root, regexp_extract(m, '(?is)href=\"([^\"]*)\"', 1) AS href, {_TITLE} AS title"
            f" FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '{rx}')) AS m FROM landed_pages WHERE split_part(url, '/', 3) = '{host}')) WHERE length(title) >= {least}"
            + (" AND NOT title LIKE 'PDF%'" if profile == "caleg" else "")
        )
    return with_views("landed_pages") + ", links AS (" + "\nUNION ALL ".join(arms) + ")\n"


@query("extract_links", _links_sql() + "SELECT * FROM links")
def extract_links(spark, d):
    rows = LK.extract_links(load(spark, d, "landed_pages"))
    return rows.select(
        "page_id", "profile", "tier", "jurisdiction", "_source", "href", "title", "court", "year", "source_url"
    )


@query("links_from_year", _links_sql() + "SELECT profile, count(*) AS n FROM links WHERE year IS NULL OR year >= 2019 GROUP BY 1")
def links_from_year(spark, d):
    rows = LK.from_year(LK.extract_links(load(spark, d, "landed_pages")), 2019)
    return rows.groupBy("profile").agg(F.count("*").alias("n"))


@query("links_with_details", _links_sql() + """
, det AS (SELECT source_url, max(substr(title || ' in full', 1, 400)) AS t FROM links WHERE page_id % 2 = 0 GROUP BY 1)
SELECT l.page_id, l.profile, l.href, coalesce(det.t, l.title) AS text, count(*) AS n FROM links l LEFT JOIN det USING (source_url) GROUP BY 1, 2, 3, 4""")
def links_with_details(spark, d):
    rows = LK.extract_links(load(spark, d, "landed_pages"))
    details = rows.where("page_id % 2 = 0").select(
        F.col("source_url").alias("url"), F.concat("title", F.lit(" in full")).alias("html")
    )
    out = LK.enrich_from_details(rows, details, F.col("html"), 400)
    return out.groupBy("page_id", "profile", "href", "text").agg(F.count("*").alias("n"))


# the link lists of all pages as they would stand on an enforcement page
@query("enforcement_links", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>')) AS m FROM pages),
t AS (SELECT page_id, regexp_extract(m, '(?is)href="([^"]*)"', 1) AS href, concat(CASE page_id % 5 WHEN 0 THEN 'Annual report on ' WHEN 1 THEN 'Seizure of ' WHEN 2 THEN 'Report ' ELSE '' END,
  """ + _TITLE + """, CASE WHEN page_id % 3 = 0 THEN ' facts and figures' ELSE '' END) AS title FROM l)
SELECT page_id, href, title, CASE WHEN contains(lower(title), 'regulation') THEN 'customs_ip_enforcement_regulation' WHEN regexp_matches(lower(title), 'statistic|facts|figures')
  THEN 'customs_ip_enforcement_statistics' ELSE 'customs_ip_enforcement_publication' END AS indicator, count(*) AS n FROM t
WHERE regexp_matches(lower(title), 'counterfeit|piracy|intellectual property|ipr|enforcement|seizure|trips|defend your rights|facts and figures|implementing regulation')
  OR (regexp_matches(lower(title), 'regulation|report|annual|statistics') AND length(title) >= 20) GROUP BY 1, 2, 3, 4""")
def enforcement_links(spark, d):
    anchors = load(spark, d, "pages").select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'), F.lit(0))).alias("m")
    )
    inner = F.regexp_extract("m", r'(?is)<a[^>]+href="([^"]*)"[^>]*>(.*?)</a>', 2)
    before = F.expr("CASE page_id % 5 WHEN 0 THEN 'Annual report on ' WHEN 1 THEN 'Seizure of ' WHEN 2 THEN 'Report ' ELSE '' END")
    after = F.expr("CASE WHEN page_id % 3 = 0 THEN ' facts and figures' ELSE '' END")
    title = TX.collapse_spaces(TX.basic_entities(TX.strip_tags(inner)))
    links = anchors.select(
        "page_id", F.regexp_extract("m", r'(?is)href="([^"]*)"', 1).alias("href"), F.concat(before, title, after).alias("title")
    )
    return LK.enforcement_links(links).groupBy("page_id", "href", "title", "indicator").agg(F.count("*").alias("n"))


@query("years_near_links", """
WITH o AS (SELECT o_orderkey, concat('<p>', repeat('x', CAST(o_orderkey % 90 AS INT)), '<a href="/j/n', o_orderkey, '">judgment</a>', repeat('y', CAST(o_orderkey % 60 AS INT)), ' ', year(o_orderdate), ' end</p>') AS html FROM orders)
SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 60 + 5 <= 50 THEN CAST(year(orders.o_orderdate) AS INT) END AS year FROM o JOIN orders USING (o_orderkey)""")
def years_near_links(spark, d):
    pages = load(spark, d, "orders").selectExpr(
        "o_orderkey AS page_id",
        "concat('<p>', repeat('x', CAST(o_orderkey % 90 AS INT)), '<a href=\"/j/n', o_orderkey, '\">judgment</a>', repeat('y', CAST(o_orderkey % 60 AS INT)), ' ', year(o_orderdate), ' end</p>') AS html",
    )
    years = LK.year_near(F.col("html"), r'(?is)<a[^>]+href="[^"]*"[^>]*>.*?</a>', 50)
    return pages.select("page_id", F.get(years, F.lit(0)).alias("year"))


# ---- result blocks -------------------------------------------------------------------

def _grouped(df: DataFrame, key: str, piece: str, wrap: str = "concat(body)") -> DataFrame:
    """Pages of at most ten records each."""
    pages = df.selectExpr(f"CAST(floor({key} / 10) AS BIGINT) AS page_id", f"{key} AS k", f"{piece} AS piece")
    return pages.groupBy("page_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("body")
    ).selectExpr("page_id", f"{wrap} AS html")


_EU = """CASE o_orderkey % 7 WHEN 0 THEN '<div class="SearchResult"><p>no title</p></div>'
 WHEN 1 THEN concat('<div class="SearchResult"><a href="./x?uri=CELEX:0', 1990 + o_orderkey % 30, 'R', o_orderkey, '" class="title">Consolidated text here</a></div>')
 ELSE concat('<div id="r" class="SearchResult"><a href="./x?uri=CELEX:3', 1990 + o_orderkey % 30, 'L0', o_orderkey % 5, '&rid=1" class="title">Directive &amp; <em>order</em> ', o_orderkey, '</a><p class="hidden textUnderTitle showInPdf"> <i>OJ L ', 1 + o_orderkey % 300, ', 22.6.2001, pp. 10-19 (ES)</i></p><p class="forceIndicator">In force</p></div>') END"""


@query("eu_results", """
WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_orderkey / 10) AS BIGINT) AS page_id, concat('CELEX:3', 1990 + o_orderkey % 30, 'L0', o_orderkey % 5) AS work FROM orders WHERE o_orderkey % 7 >= 2),
f AS (SELECT page_id, work, min(k) AS k FROM o GROUP BY 1, 2)
SELECT page_id, work, concat('Directive & order ', k) AS title, CAST(1990 + k % 30 AS INT) AS year, concat('OJ L ', 1 + k % 300, ', 22.6.2001, pp. 10-19') AS oj_reference, 'In force' AS status FROM f""")
def eu_results(spark, d):
    pages = _grouped(load(spark, d, "orders"), "o_orderkey", _EU)
    return B.eu_results(pages).select("page_id", "work", "title", "year", "oj_reference", "status")


_INDIA = """concat('<article class="result"><h4 class="result_title"> ', CASE WHEN o_orderkey % 3 = 0 THEN '[Section 5] ' ELSE '' END, '<a href="/docfragment/', o_orderkey, '/?q=x">A <b>vs</b> B&#39;s on ', 1 + o_orderkey % 28, ' August, ', year(o_orderdate), '</a></h4>',
 CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('<div class="headline">held <b>that</b> ', o_orderkey, '</div>') END, '<span class="docsource">Court ', o_orderkey % 6, '</span></article>')"""


@query("indian_results", """
SELECT CAST(floor(o_orderkey / 10) AS BIGINT) AS page_id, concat('A vs B''s on ', 1 + o_orderkey % 28, ' August, ', year(o_orderdate)) AS case_name, concat('Court ', o_orderkey % 6) AS court,
  CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderkey % 4 = 0 THEN concat('Doc ID: ', o_orderkey) ELSE concat('held that ', o_orderkey) END AS summary,
  concat('https://indiankanoon.org/doc/', o_orderkey, '/') AS url FROM orders""")
def indian_results(spark, d):
    pages = _grouped(load(spark, d, "orders"), "o_orderkey", _INDIA)
    return B.indian_results(pages).select("page_id", "case_name", "court", "year", "summary", "url")


@query("label_tables", """
SELECT o_orderkey AS page_id, concat('P-', o_orderkey, '/', year(o_orderdate)) AS case_number, concat('Judge ', o_custkey % 9) AS judge,
  CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown' ELSE 'NEGADA' END AS result,
  concat_ws(' | ', concat('P-', o_orderkey, '/', year(o_orderdate)), 'Descritores: dano', CASE WHEN o_orderkey % 2 = 0 THEN 'Área: civil' END) AS text FROM orders""")
def label_tables(spark, d):
    cells = """concat('<table><tr><td>Processo:</td><td>old</td></tr><tr><td><b>Processo</b>:</td><td>P-', o_orderkey, '/', year(o_orderdate), '</td></tr>',
      '<tr><td>Relator</td><td> Judge  <i>', o_custkey % 9, '</i></td></tr><tr><td>Descritores:</td><td>dano</td></tr>', CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('<tr><td>Data do Acordão</td><td>12/', year(o_orderdate), '</td></tr>') END,
      CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '<tr><td>Decisão</td><td>NEGADA</td></tr>' END, CASE WHEN o_orderkey % 2 = 0 THEN '<tr><td>Área Temática</td><td>civil</td></tr>' ELSE '' END, '<tr><td>only</td></tr></table>')"""
    pages = load(spark, d, "orders").selectExpr("o_orderkey AS page_id", "'https://www.dgsi.pt/x' AS url", f"{cells} AS html")
    # a process number below 1000 holds no four digits before its year
    rows = B.portuguese_judgments(pages)
    wrong = F.expr("CAST(regexp_extract(case_number, '/(\\\\d{4})$', 1) AS INT)")
    return rows.select("page_id", "case_number", "judge", wrong.alias("year"), "result", "text")


@query("preformatted_text", """
SELECT doc_id AS page_id, CASE WHEN length(t) > 5000 THEN concat(substr(t, 1, 5000), '...') ELSE t END AS text FROM (
  SELECT doc_id, trim(regexp_replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM documents WHERE NOT regexp_matches(text, '[<>&]')) WHERE length(t) > 50""")
def preformatted_text(spark, d):
    docs = load(spark, d, "documents").where("NOT text RLIKE '[<>&]'")
    pages = docs.selectExpr("doc_id AS page_id", "concat('<pre>short</pre><pre id=\"j\">', text, '</pre>') AS html")
    return pages.select("page_id", B.preformatted_text(F.col("html")).alias("text")).where("text <> ''")


# ---- JSON payloads -------------------------------------------------------------------

def _payloads(spark, d, item: str, wrap: str) -> DataFrame:
    """JSON payloads of at most ten orders each; ``wrap`` names the column ``items``."""
    rows = load(spark, d, "orders").selectExpr("CAST(floor(o_orderkey / 10) AS BIGINT) AS g", "o_orderkey AS k", f"{item} AS item")
    grouped = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "item"))).alias("x"))
    return grouped.select(
        F.col("g").cast("string").alias("url"), F.transform("x", lambda v: v["item"]).alias("items")
    ).select("url", F.expr(f"to_json({wrap})").alias("payload"))


_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')"


@query("patent_board", """
SELECT CAST(CAST(floor(o_orderkey / 10) AS BIGINT) AS VARCHAR) AS url, CAST(o_orderkey % 10 AS INT) AS position,
  CASE o_orderkey % 3 WHEN 0 THEN concat('IPR', o_orderkey) WHEN 1 THEN concat('N', o_orderkey, ' - US', o_custkey) ELSE 'PTAB Proceeding' END AS case_name, CAST(year(o_orderdate) AS INT) AS year,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'Unknown' END AS result,
  concat_ws(' | ', CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END, strftime(o_orderdate, '%Y-%m-%d')) AS text FROM orders""")
def patent_board(spark, d):
    item = f"""struct(CASE WHEN o_orderkey % 3 = 0 THEN concat(' IPR', o_orderkey) END AS proceeding_title, '' AS case_name,
      CASE WHEN o_orderkey % 3 = 1 THEN concat('N', o_orderkey) END AS proceedingNumber, CASE WHEN o_orderkey % 3 = 1 THEN concat('US', o_custkey) END AS patentNumber,
      CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE ' ' END AS disposition, {_DAY} AS filingDate)"""
    rows = PL.patent_board(_payloads(spark, d, item, "struct(array() AS proceedings, items AS results)"))
    return rows.select("url", "position", "case_name", "year", "result", "text")


@query("us_opinions", """
SELECT CAST(CAST(floor(o_orderkey / 10) AS BIGINT) AS VARCHAR) AS url, CAST(o_orderkey % 10 AS INT) AS position, concat('Doe v. ', o_custkey) AS case_name, 'ca9' AS court, CAST(year(o_orderdate) AS INT) AS year,
  CAST(o_orderkey AS VARCHAR) AS result, concat('Doe v. ', o_custkey, chr(10), 'Court: ca9', chr(10), 'Filed: ', strftime(o_orderdate, '%Y-%m-%d'), chr(10), 'Docket: ', o_orderkey,
  CASE WHEN o_orderkey % 2 = 0 THEN chr(10) || 'held so' ELSE '' END) AS text, concat('https://www.courtlistener.com/o/', o_orderkey, '/') AS source_url FROM orders""")
def us_opinions(spark, d):
    item = f"""struct('' AS caseName, concat('Doe v. ', o_custkey) AS caseNameFull, 'ca9' AS court, {_DAY} AS dateFiled, CAST(o_orderkey AS STRING) AS docketNumber, concat('/o/', o_orderkey, '/') AS absolute_url,
      CASE WHEN o_orderkey % 2 = 0 THEN array(struct(' held so ' AS snippet), struct('' AS snippet)) ELSE array() END AS opinions)"""
    rows = PL.us_opinions(_payloads(spark, d, item, "struct(items AS results)"))
    return rows.select("url", "position", "case_name", "court", "year", "result", "text", "source_url")


@query("human_rights_cases", """
SELECT CAST(CAST(floor(o_orderkey / 10) AS BIGINT) AS VARCHAR) AS url, CAST(o_orderkey % 10 AS INT) AS position, concat('X v. ', o_custkey) AS case_name, CAST(year(o_orderdate) AS INT) AS year,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown' ELSE 'Violation' END AS result, CASE o_orderkey % 3 WHEN 0 THEN concat('Application no. ', o_orderkey) WHEN 1 THEN concat('ECLI: E', o_orderkey)
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS summary, concat('https://hudoc.echr.coe.int/eng?i=', o_orderkey) AS source_url FROM orders""")
def human_rights_cases(spark, d):
    item = f"""struct(struct(concat('X v. ', o_custkey) AS docname, CAST(o_orderkey AS STRING) AS itemid, CASE WHEN o_orderkey % 3 = 1 THEN concat('E', o_orderkey) ELSE '' END AS ecli,
      CASE WHEN o_orderkey % 2 = 0 THEN {_DAY} ELSE '' END AS judgementdate, {_DAY} AS kpdate, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'Violation' END AS conclusion,
      CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS STRING) END AS appno) AS columns)"""
    rows = PL.human_rights_cases(_payloads(spark, d, item, "struct(items AS results)"))
    return rows.select("url", "position", "case_name", "year", "result", "summary", "source_url")


@query("canadian_cases", """
SELECT CAST(CAST(floor(o_orderkey / 10) AS BIGINT) AS VARCHAR) AS url, CAST(o_orderkey % 10 AS INT) AS position, CASE WHEN o_orderkey % 2 = 0 THEN concat('R. v. ', o_custkey) ELSE concat('case', o_orderkey) END AS case_name,
  CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderkey % 3 = 0 THEN concat('D', o_orderkey) ELSE concat('SCC ', o_orderkey) END AS summary FROM orders
WHERE contains(lower(concat(CASE WHEN o_orderkey % 2 = 0 THEN concat('R. v. ', o_custkey) ELSE concat('case', o_orderkey) END, ' ', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('SCC ', o_orderkey) END, ' D', o_orderkey)), '1')""")
def canadian_cases(spark, d):
    item = f"""struct(CASE WHEN o_orderkey % 2 = 0 THEN concat('R. v. ', o_custkey) END AS title, struct(concat('case', o_orderkey) AS en) AS caseId,
      CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('SCC ', o_orderkey) END AS citation, concat('D', o_orderkey) AS docketNumber, {_DAY} AS decisionDate)"""
    rows = PL.canadian_cases(_payloads(spark, d, item, "struct(items AS cases)"), "1")
    return rows.select("url", "position", "case_name", "year", "summary")


@query("canadian_legislation", """
SELECT CAST(CAST(floor(o_orderkey / 10) AS BIGINT) AS VARCHAR) AS url, CAST(o_orderkey % 10 AS INT) AS position, concat('Act ', o_custkey) AS law_name, concat('RSC ', o_orderkey) AS citation,
  CASE WHEN o_orderkey % 2 = 0 THEN 'regulation' ELSE 'statute' END AS type FROM orders""")
def canadian_legislation(spark, d):
    item = "struct(concat('Act ', o_custkey) AS name, concat('RSC ', o_orderkey) AS citation, CASE WHEN o_orderkey % 2 = 0 THEN 'regulation' END AS type)"
    return PL.canadian_legislation(_payloads(spark, d, item, "struct(items AS legislations)")).select(
        "url", "position", "law_name", "citation", "type"
    )


@query("canadian_databases", """
SELECT CAST(CAST(floor(o_orderkey / 10) AS BIGINT) AS VARCHAR) AS url, CAST(o_orderkey % 10 AS INT) AS position, concat('db', o_custkey) AS database_id, o_orderpriority AS name FROM orders""")
def canadian_databases(spark, d):
    item = "struct(concat('db', o_custkey) AS databaseId, o_orderpriority AS name)"
    return PL.canadian_databases(_payloads(spark, d, item, "struct(items AS databases)"))


@query("french_decisions", """
SELECT CAST(CAST(floor(o_orderkey / 10) AS BIGINT) AS VARCHAR) AS url, CAST(o_orderkey % 10 AS INT) AS position, concat('Arrêt ', o_custkey) AS case_name, CASE WHEN o_orderkey % 2 = 0 THEN 'JURI - CHAMBRE' ELSE 'JURI' END AS court,
  CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderkey % 3 = 0 THEN 'Cassation' ELSE 'Unknown' END AS result, CASE WHEN o_orderkey % 4 = 0 THEN 'sommaire' ELSE CAST(o_orderkey AS VARCHAR) END AS summary FROM orders""")
def french_decisions(spark, d):
    item = f"""struct(concat('Arrêt ', o_custkey) AS titre, CASE WHEN o_orderkey % 2 = 0 THEN 'CHAMBRE' END AS formation, {_DAY} AS dateTexte, CASE WHEN o_orderkey % 3 = 0 THEN 'Cassation' END AS solution,
      CASE WHEN o_orderkey % 4 = 0 THEN 'sommaire' END AS sommaire, CAST(o_orderkey AS STRING) AS id)"""
    rows = PL.french_records(_payloads(spark, d, item, "struct(items AS listResult)"), "JURI", decisions=True)
    return rows.select("url", "position", "case_name", "court", "year", "result", "summary")


@query("french_statutes", """
SELECT CAST(CAST(floor(o_orderkey / 10) AS BIGINT) AS VARCHAR) AS url, CAST(o_orderkey % 10 AS INT) AS position, concat('Loi ', o_custkey) AS case_name, 'LODA' AS court,
  CAST(year(o_orderdate) AS INT) AS year, CAST(o_orderkey AS VARCHAR) AS summary FROM orders""")
def french_statutes(spark, d):
    item = f"struct(concat('Loi ', o_custkey) AS title, {_DAY} AS date, CAST(o_orderkey AS STRING) AS id)"
    rows = PL.french_records(_payloads(spark, d, item, "struct(items AS results)"), "LODA")
    return rows.select("url", "position", "case_name", "court", "year", "summary")


@query("swedish_statutes", """
SELECT CAST(CAST(floor(o_orderkey / 10) AS BIGINT) AS VARCHAR) AS url, CAST(o_orderkey % 10 AS INT) AS position, CASE WHEN o_orderkey % 2 = 0 THEN concat('Lag ', o_custkey) ELSE concat('sfs-', o_orderkey) END AS law_name,
  concat('https://www.riksdagen.se/sv/dokument-och-lagar/dokument/svensk-forfattningssamling/sfs-', o_orderkey, '/') AS text, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders""")
def swedish_statutes(spark, d):
    item = f"struct(CASE WHEN o_orderkey % 2 = 0 THEN concat('Lag ', o_custkey) END AS titel, concat('sfs-', o_orderkey) AS id, {_DAY} AS datum)"
    rows = PL.swedish_statutes(_payloads(spark, d, item, "struct(struct(items AS dokument) AS dokumentlista)"))
    return rows.select("url", "position", "law_name", "text", "date")


# ---- XML payloads --------------------------------------------------------------------

def _xml(spark, d, piece: str, wrap: str) -> DataFrame:
    return _grouped(load(spark, d, "part"), "p_partkey", piece, wrap).selectExpr("CAST(page_id AS STRING) AS url", "html AS payload")


_URL = "CAST(CAST(floor(p_partkey / 10) AS BIGINT) AS VARCHAR) AS url"


@query("japanese_law_list", f"""
SELECT {_URL}, concat(p_name, '法') AS law_name, concat('N', p_size) AS law_num, CAST(min(p_partkey % 10) AS INT) AS position FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1, 2, 3""")
def japanese_law_list(spark, d):
    piece = "concat('<LawNameListInfo><LawName>', p_name, '法</LawName><LawNo>', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('N', p_size) END, '</LawNo></LawNameListInfo>')"
    return PL.japanese_law_list(_xml(spark, d, piece, "concat('<DataRoot><ApplData>', body, '</ApplData></DataRoot>')")).drop("jurisdiction")


@query("japanese_articles", f"""
SELECT {_URL}, CAST(p_partkey % 10 AS INT) AS position, '著作権法' AS law_name, CASE WHEN p_partkey % 3 <> 0 THEN concat('第', p_partkey, '条') END AS article,
  concat(CASE WHEN p_partkey % 3 <> 0 THEN concat('第', p_partkey, '条') ELSE '' END, p_name, '&', p_type) AS text FROM part""")
def japanese_articles(spark, d):
    piece = """concat('<Article Num="', p_partkey, '">', CASE WHEN p_partkey % 3 <> 0 THEN concat('<ArticleTitle>第', p_partkey, '条</ArticleTitle>') ELSE '' END,
      '<Paragraph><Sentence>', p_name, '&amp;', p_type, '</Sentence></Paragraph></Article>')"""
    rows = PL.japanese_articles(_xml(spark, d, piece, "concat('<Law><LawTitle>著作権法</LawTitle>', body, '</Law>')"))
    return rows.select("url", "position", "law_name", "article", "text")


@query("german_norms", f"""
SELECT {_URL}, CAST(p_partkey % 10 AS INT) AS position, 'UrhG' AS law_name, CASE WHEN p_partkey % 2 = 0 THEN concat('§ ', p_partkey) END AS article,
  CASE WHEN p_partkey % 3 <> 0 THEN concat(p_name, chr(10), 'Zweiter ', p_type) ELSE '' END AS text, p_brand AS theme FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 <> 0""")
def german_norms(spark, d):
    piece = """concat('<norm builddate="1"><metadaten><jurabk>UrhG</jurabk>', CASE WHEN p_partkey % 2 = 0 THEN concat('<enbez>§ ', p_partkey, '</enbez>') ELSE '' END, '<titel>', p_brand, '</titel></metadaten><textdaten>',
      CASE WHEN p_partkey % 3 <> 0 THEN concat('<Content><P>', p_name, '</P><P> </P><P>Zweiter<BR/>', p_type, '</P></Content>') ELSE '' END, '</textdaten></norm>')"""
    rows = PL.german_norms(_xml(spark, d, piece, "concat('<dokumente>', body, '</dokumente>')"))
    return rows.select("url", "position", "law_name", "article", "text", "theme")


@query("dutch_entries", f"""
SELECT {_URL}, CAST(p_partkey % 10 AS INT) AS position, concat('ECLI:NL:HR:', 1990 + p_size % 30, ':', p_partkey, ', Hoge Raad, ', p_name) AS case_name, 'Hoge Raad' AS court, CAST(1990 + p_size % 30 AS INT) AS year,
  CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE concat('ECLI:NL:HR:', 1990 + p_size % 30, ':', p_partkey, ', Hoge Raad, ', p_name) END AS text, concat('https://e.nl/', p_partkey) AS source_url FROM part""")
def dutch_entries(spark, d):
    ecli = "concat('ECLI:NL:HR:', 1990 + p_size % 30, ':', p_partkey)"
    piece = f"""concat('<entry><id>', {ecli}, '</id><title type="text">', {ecli}, ', Hoge Raad, ', p_name, '</title><summary>', CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '-' END,
      '</summary><updated>2020-01-01</updated><link rel="alternate" type="text/html" href="https://e.nl/', p_partkey, '"/></entry>')"""
    rows = PL.dutch_entries(_xml(spark, d, piece, "concat('<feed xmlns=\"http://www.w3.org/2005/Atom\">', body, '</feed>')"))
    return rows.select("url", "position", "case_name", "court", "year", "text", "source_url")


# ---- landing --------------------------------------------------------------------------

def _raw(spark, d) -> DataFrame:
    """Two landings of the orders: the second brings new texts for a third of them, and new cases."""
    fields = """CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS id, CASE WHEN o_orderkey % 5 = 0 THEN concat('c', o_orderkey) END AS case_id,
      concat('https://x/', o_orderkey) AS source_url, concat('No-', o_orderkey) AS case_number, o_orderpriority AS court, date_format(o_orderdate, 'yyyy-MM-dd') AS decision_date,
      '' AS full_text, '' AS plain_text, CAST(NULL AS STRING) AS summary, 'en' AS language"""
    first = load(spark, d, "orders").where("o_orderkey % 3 <> 1").selectExpr(
        *[f.strip() for f in _split(fields)], "concat('first ', o_orderstatus) AS case_name", "repeat('t', CAST(o_orderkey % 40 AS INT)) AS text",
        "map('docket', CAST(o_custkey AS STRING), 'empty', '') AS extra", f"{jurisdiction_sql('o_custkey')} AS jurisdiction", "'courtlistener' AS adapter", "o_orderkey AS seq",
    )
    second = load(spark, d, "orders").where("o_orderkey % 3 <> 2").selectExpr(
        *[f.strip() for f in _split(fields)], "concat('second ', o_orderstatus) AS case_name", "repeat('u', CAST(o_custkey % 40 AS INT)) AS text",
        "map('empty', '') AS extra", f"{jurisdiction_sql('o_custkey')} AS jurisdiction", "'zalaw' AS adapter", "o_orderkey + 100000000 AS seq",
    )
    return first.unionByName(second)


def _split(fields: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in fields:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


@query("upsert_cases", f"""
WITH o AS (SELECT *, concat({jurisdiction_sql('o_custkey')}, ':', CASE WHEN o_orderkey % 5 = 0 THEN concat('c', o_orderkey) ELSE CAST(o_orderkey AS VARCHAR) END) AS case_id FROM orders)
SELECT case_id, CASE WHEN o_orderkey % 3 = 1 THEN concat('second ', o_orderstatus) ELSE concat('first ', o_orderstatus) END AS case_name,
  CASE WHEN o_orderkey % 3 = 1 THEN 'zalaw' ELSE 'courtlistener' END AS source_adapter,
  CASE WHEN o_orderkey % 3 = 1 OR (o_orderkey % 3 = 0 AND o_custkey % 40 > o_orderkey % 40) THEN repeat('u', CAST(o_custkey % 40 AS INT)) ELSE repeat('t', CAST(o_orderkey % 40 AS INT)) END AS full_text,
  CASE WHEN o_orderkey % 3 = 2 THEN concat(chr(123), '"docket":"', o_custkey, '"', chr(125)) ELSE concat(chr(123), chr(125)) END AS raw_metadata FROM o""")
def upsert_cases(spark, d):
    landed = L.landed_cases(_raw(spark, d))
    old, new = landed.where("seq < 100000000"), landed.where("seq >= 100000000")
    return L.upsert_cases(old, new).select("case_id", "case_name", "source_adapter", "full_text", "raw_metadata")


# the second landing merged into a bucketed store of the first
@query("stored_cases", f"""
WITH o AS (SELECT *, concat({jurisdiction_sql('o_custkey')}, ':', CASE WHEN o_orderkey % 5 = 0 THEN concat('c', o_orderkey) ELSE CAST(o_orderkey AS VARCHAR) END) AS case_id FROM orders)
SELECT case_id, CASE WHEN o_orderkey % 3 = 1 THEN concat('second ', o_orderstatus) ELSE concat('first ', o_orderstatus) END AS case_name,
  CASE WHEN o_orderkey % 3 = 1 OR (o_orderkey % 3 = 0 AND o_custkey % 40 > o_orderkey % 40) THEN repeat('u', CAST(o_custkey % 40 AS INT)) ELSE repeat('t', CAST(o_orderkey % 40 AS INT)) END AS full_text,
  CASE WHEN o_orderkey % 3 = 1 THEN 'landing 2' ELSE 'landing 1' END AS crawled_at, CASE WHEN o_orderkey % 3 = 2 THEN 'landing 1' ELSE 'landing 2' END AS updated_at FROM o""")
def stored_cases(spark, d):
    rows = L.landed_cases(_raw(spark, d), F.when(F.col("seq") < 100000000, "landing 1").otherwise("landing 2"))
    path = f"{shared_folder(spark)}/cases-{uuid.uuid4().hex}"
    ST.create_store(rows.where("seq < 100000000"), path, 16)
    ST.merge_cases(spark, path, rows.where("seq >= 100000000"), 16)
    return ST.read_cases(spark, path).select("case_id", "case_name", "full_text", "crawled_at", "updated_at")


@query("new_citations", with_views("case_citations") + """
, old AS (SELECT * FROM case_citations WHERE CAST(citing_case_id AS BIGINT) % 2 = 0)
SELECT citing_case_id, cited_reference FROM case_citations WHERE (citing_case_id, cited_reference) NOT IN (SELECT (citing_case_id, cited_reference) FROM old) GROUP BY 1, 2""")
def new_citations(spark, d):
    edges = load(spark, d, "case_citations")
    return L.new_citations(edges.where("CAST(citing_case_id AS BIGINT) % 2 = 0"), edges).select("citing_case_id", "cited_reference")


@query("new_index_rows", with_views("reporter_index") + """
SELECT citation_string, case_id, jurisdiction FROM reporter_index WHERE CAST(case_id AS BIGINT) % 3 <> 0""")
def new_index_rows(spark, d):
    rows = load(spark, d, "reporter_index")
    return L.new_index_rows(rows.where("CAST(case_id AS BIGINT) % 3 = 0"), rows)


@query("source_jurisdictions", """
WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'hudoc' WHEN 1 THEN concat(substr(p_type, 1, 3), 'leg') WHEN 2 THEN concat(lower(substr(p_name, 1, 2)), 'law') ELSE 'canlii' END AS src FROM part)
SELECT src AS source_adapter, CASE src WHEN 'hudoc' THEN 'EU' WHEN 'canlii' THEN 'CA' ELSE substr(upper(replace(replace(src, 'leg', ''), 'law', '')), 1, 2) END AS jurisdiction,
  count(*) FILTER (p_partkey % 7 <> 0) AS stored, count(*) FILTER (p_partkey % 7 = 0) AS errors FROM s GROUP BY 1, 2""")
def source_jurisdictions(spark, d):
    src = "CASE p_partkey % 4 WHEN 0 THEN 'hudoc' WHEN 1 THEN concat(substr(p_type, 1, 3), 'leg') WHEN 2 THEN concat(lower(substr(p_name, 1, 2)), 'law') ELSE 'canlii' END"
    rows = load(spark, d, "part").selectExpr(f"{src} AS source_adapter", "CASE WHEN p_partkey % 7 = 0 THEN 'timeout' END AS error")
    ledger = L.crawl_ledger(rows)
    return ledger.withColumn("jurisdiction", L.source_jurisdiction(F.col("source_adapter")))


@query("normalized_cases", """
SELECT o_orderkey AS raw_id, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'n' END AS case_name, CASE o_orderkey % 3 WHEN 0 THEN 'US' ELSE 'GB' END AS jurisdiction, TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'n.d.' ELSE '1999' END AS INT) AS year,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Unknown' ELSE o_orderstatus END AS result, 'external' AS domain, 'unknown' AS _source, CASE WHEN o_orderkey % 2 = 0 THEN 'a|b' END AS parties FROM orders""")
def normalized_cases(spark, d):
    raw = load(spark, d, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS raw_id", "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'n' END AS case_name", "CASE o_orderkey % 3 WHEN 0 THEN 'us' ELSE 'Gb' END AS jurisdiction", "'' AS court",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'n.d.' ELSE '1999' END AS year", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderstatus END AS result", "'' AS summary", "'' AS domain",
        "CAST(NULL AS ARRAY<STRING>) AS keywords", "'' AS _source", "CASE WHEN o_orderkey % 2 = 0 THEN array('a', 'b', 'c') ELSE array('a') END AS parties",
        "'' AS citation", "'' AS ecli", "'' AS case_number", "'' AS full_text_url",
    )
    rows = L.normalized_cases(raw)
    return rows.select(
        F.col("raw_id").cast("bigint").alias("raw_id"), "case_name", "jurisdiction", "year", "result", "domain", "_source",
        F.array_join("parties", "|").alias("parties"),
    )


@query("normalized_statutes", """
SELECT CAST(p_partkey AS VARCHAR) AS law_id, p_name AS law_name, 'DE' AS jurisdiction, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS text, 'unknown' AS _source, NULL::VARCHAR AS url FROM part""")
def normalized_statutes(spark, d):
    raw = load(spark, d, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS law_id", "p_name AS law_name", "'de' AS jurisdiction", "'1' AS article", "CASE WHEN p_partkey % 2 = 0 THEN p_type END AS text",
        "p_brand AS theme", "CAST(NULL AS STRING) AS _source", "'' AS effective_date", "'' AS url",
    )
    return L.normalized_statutes(raw).select("law_id", "law_name", "jurisdiction", "text", "_source", "url")


@query("japanese_cases", """
WITH r AS (SELECT l_orderkey % 500 AS u, l_orderkey * 10 + l_linenumber AS k, l_partkey, l_returnflag FROM lineitem WHERE l_orderkey % 500 > 4),
m AS (SELECT u, max((k, l_partkey, l_returnflag)) AS x FROM r GROUP BY 1)
SELECT concat('https://c/', u) AS source_url, CASE WHEN x[3] = 'N' THEN '事件' ELSE x[3] END AS case_name, CAST(CASE WHEN x[2] % 4 = 0 THEN 0 ELSE 1980 + x[2] % 40 END AS INT) AS year,
  concat('要旨', x[2]) AS text, 'Unknown' AS result FROM m""")
def japanese_cases(spark, d):
    raw = load(spark, d, "lineitem").selectExpr(
        "CASE WHEN l_orderkey % 500 > 4 THEN concat('https://c/', l_orderkey % 500) ELSE ' ' END AS source_url",
        "CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS case_name", "'' AS court", "'' AS result", "' ' AS text",
        "concat('要旨', l_partkey) AS summary", "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 1980 + l_partkey % 40 END AS year",
        "struct(l_orderkey * 10 + l_linenumber AS k, l_partkey AS p, l_returnflag AS f) AS seq",
    )
    return L.japanese_cases(raw, "著作権 侵害").select("source_url", "case_name", "year", "text", "result")


@query("years_and_ids", """
SELECT o_orderkey, CAST(substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 1, 4) AS INT) AS leading, CAST(year(o_orderdate) AS INT) AS in_text, CAST(1988 + 1 + o_orderkey % 30 AS INT) AS era,
  CAST(1990 + o_orderkey % 30 AS INT) AS celex, CAST(CASE WHEN o_orderkey % 100 < 50 THEN 2000 ELSE 1900 END + o_orderkey % 100 AS INT) AS short, CAST(o_orderkey AS VARCHAR) AS id,
  concat('§ ', o_orderkey % 99) AS article, concat('第', '') AS mark, CASE o_orderkey % 2 WHEN 0 THEN 'Bundesgerichtshof' ELSE 'XG' END AS court FROM orders""")
def years_and_ids(spark, d):
    rows = load(spark, d, "orders").selectExpr(
        "o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS day", "concat('on ', year(o_orderdate), ', again') AS said",
        "concat('平成', 1 + o_orderkey % 30, '年') AS era", "concat('3', 1990 + o_orderkey % 30, 'L0', o_orderkey) AS celex",
        "concat('259/', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'), '.0YREVR.S1') AS short", "concat('https://c/hanrei/detail2?id=', o_orderkey, '&x=1') AS link",
        "concat('see § ', o_orderkey % 99, ' or section 5') AS law", "concat(CASE o_orderkey % 2 WHEN 0 THEN 'BGH' ELSE 'XG' END, ', 19.02.2026 - IX ZR 226/22') AS line",
    )
    return rows.select(
        "o_orderkey", TX.leading_year(F.col("day")).alias("leading"), TX.year_in_text(F.col("said")).alias("in_text"), TX.era_year(F.col("era")).alias("era"),
        TX.celex_year(F.col("celex")).alias("celex"), TX.two_digit_year(F.col("short")).alias("short"), TX.id_from_url(F.col("link")).alias("id"),
        TX.us_article(F.col("law")).alias("article"), F.lit("第").alias("mark"), TX.de_result_line(F.col("line"))["court"].alias("court"),
    )
