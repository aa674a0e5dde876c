"""Legal-corpus views derived from star-schema tables.

Each view is one SQL text that Spark and an ANSI engine both read; ``{name}``
stands for a base table or another view, ``{S}`` for the string type.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# jurisdiction of each nation key
CODES = [
    "US", "GB", "EU", "JP", "AU", "CA", "DE", "FR", "IN", "CH", "CN", "BR", "PL",
    "AT", "KR", "NZ", "HK", "SG", "IT", "NL", "ZA", "KE", "SE", "NO", "MX",
]


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {expr} {arms} ELSE '{values[-1]}' END"


def jurisdiction_sql(expr: str) -> str:
    return _case(f"{expr} % {len(CODES)}", CODES)


_SOURCES = [
    "wipo_adr", "itc337", "epo_opposition", "ptab", "ustr301", "enforcement", "upc", "gipc_index",
    "euipo_opposition", "court_stats", "sep_frand", "upov", "cipo", "ip_india",
]
_STATS = ["wipo", "uspto", "epo", "worldbank", "oecd", "jpo", "euipo", "gii", "cnipa", "kipo"]
_INDICATORS = [
    "udrp_cases_filed", "section337_investigations", "oppositions_filed", "ipr_petitions_filed",
    "priority_watch_list", "cbp_seizure_share", "upc_cases_filed", "watch_list", "tm_oppositions_filed",
    "eu_seizure_share", "mediation_cases", "pgr_petitions_filed",
]

VIEWS = {
    "cases": f"""
SELECT CAST(o.o_orderkey AS {{S}}) AS case_id, {jurisdiction_sql('n.n_nationkey')} AS jurisdiction,
  CASE o.o_orderkey % 4 WHEN 0 THEN 'Supreme Court' WHEN 1 THEN 'Court of Appeals'
       WHEN 2 THEN 'District Court' ELSE 'Tax Tribunal' END AS court,
  concat(c.c_name, ' v. Supplier#', CAST(o.o_orderkey % 10 AS {{S}})) AS case_name,
  concat('No-', CAST(o.o_orderkey AS {{S}})) AS case_number,
  CAST(CAST(o.o_orderdate AS DATE) AS {{S}}) AS decision_date,
  CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderpriority END AS case_type,
  CASE WHEN o.o_orderkey % 13 = 0 THEN '1-URGENT' END AS case_type_suggested,
  c.c_mktsegment AS subject_area,
  CASE WHEN o.o_orderkey % 17 = 0 THEN 'FURNITURE' END AS subject_area_suggested,
  CASE WHEN o.o_orderkey % 29 = 0 THEN NULL WHEN o.o_orderstatus = 'F' THEN 'defendant_win'
       WHEN o.o_orderstatus = 'O' THEN 'plaintiff_win' ELSE 'dismissed' END AS outcome,
  d.text AS full_text, substr(d.text, 1, 500) AS summary,
  CASE WHEN d.doc_id IS NULL THEN 0 ELSE 1 END AS has_content,
  CASE WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE CAST(o.o_orderkey % 50 AS DOUBLE) / 10 END AS importance_score,
  concat('https://law.example.org/case/', CAST(o.o_orderkey AS {{S}})) AS source_url,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL
       WHEN o.o_orderkey % 5 = 1 THEN concat(chr(123), '"judge_names": "Judge', CAST(o.o_custkey % 23 AS {{S}}), '"', chr(125))
       ELSE concat(chr(123), '"judge_names": ["Judge', CAST(o.o_custkey % 23 AS {{S}}), '", "Judge',
                   CAST(o.o_orderkey % 7 AS {{S}}), '"]', chr(125)) END AS raw_metadata
FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey
JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
LEFT JOIN {{documents}} d ON d.doc_id = o.o_orderkey""",
    "case_citations": """
SELECT citing_case_id, cited_case_id, cited_reference, min(ctx) AS citation_context FROM (
  SELECT CAST(l_orderkey AS {S}) AS citing_case_id,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_partkey AS {S}) END AS cited_case_id,
    concat('No-', CAST(l_partkey AS {S})) AS cited_reference,
    CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 'that holding was Overruled on appeal'
         WHEN l_returnflag = 'A' AND l_quantity >= 49 THEN 'the court distinguished it'
         ELSE 'see also' END AS ctx
  FROM {lineitem}) x
GROUP BY citing_case_id, cited_case_id, cited_reference""",
    # judgment texts: the document of the case, then a sentence per citation
    "opinions": f"""
SELECT o.o_orderkey AS doc_id, {jurisdiction_sql('o.o_custkey')} AS jurisdiction,
  concat(coalesce(d.text, ''), ' ', s.body, ' Decided on ', CAST(CAST(o.o_orderdate AS DATE) AS {{S}}), '. ',
    CASE o.o_orderstatus WHEN 'F' THEN 'The defendant prevailed, motion is granted. '
         WHEN 'O' THEN 'The action is dismissed. ' ELSE 'The parties settled. ' END,
    'Filed ', CAST(1 + o.o_orderkey % 28 AS {{S}}), ' March ', CAST(1980 + o.o_orderkey % 14 AS {{S}}),
    '. Damages of $ ', CAST(1000 + o.o_orderkey % 9000 AS {{S}}), '.00 under Section ', CAST(1 + o.o_orderkey % 90 AS {{S}}),
    ' were sought before Judge Alder', CASE o.o_orderkey % 3 WHEN 0 THEN ' Beck' WHEN 1 THEN ' Cole' ELSE '' END,
    ', in Case D2020-', CAST(1000 + o.o_orderkey % 9000 AS {{S}}), '.') AS text
FROM {{orders}} o
JOIN (SELECT l_orderkey, {{AGG}} AS body FROM (
    SELECT l_orderkey, concat(
      CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 'It overruled '
           WHEN l_returnflag = 'A' AND l_quantity >= 49 THEN 'The court distinguished ' ELSE 'See ' END,
      CASE l_suppkey % 12
        WHEN 0 THEN concat('[', CAST(1990 + l_partkey % 30 AS {{S}}), '] UKSC ', CAST(1 + l_partkey % 90 AS {{S}}))
        WHEN 1 THEN concat('Case C-', CAST(1 + l_partkey % 900 AS {{S}}), '/', CAST(10 + l_partkey % 80 AS {{S}}))
        WHEN 2 THEN concat('BGH, ', CAST(1 + l_partkey % 9 AS {{S}}), ' ZR ', CAST(1 + l_partkey % 500 AS {{S}}), '/05')
        WHEN 3 THEN concat('AIR 20', CAST(10 + l_partkey % 10 AS {{S}}), ' SC ', CAST(1 + l_partkey % 4000 AS {{S}}))
        WHEN 4 THEN concat(CAST(2000 + l_partkey % 24 AS {{S}}), ' SCC ', CAST(1 + l_partkey % 90 AS {{S}}))
        WHEN 5 THEN concat('BGE ', CAST(100 + l_partkey % 50 AS {{S}}), ' III ', CAST(1 + l_partkey % 500 AS {{S}}))
        WHEN 6 THEN concat('No-', CAST(l_partkey AS {{S}}))
        ELSE concat(CAST(CAST(1 + (l_partkey - l_partkey % 9000) / 9000 AS BIGINT) AS {{S}}), ' U.S. ', CAST(1 + l_partkey % 9000 AS {{S}})) END,
      '.') AS line FROM {{lineitem}}) l GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey
LEFT JOIN {{documents}} d ON d.doc_id = o.o_orderkey""",
    # reporter citations of the cases, beside their numbers and names
    "reporter_index": f"""
SELECT concat(CAST(CAST(1 + (o_orderkey - o_orderkey % 9000) / 9000 AS BIGINT) AS {{S}}), ' U.S. ',
              CAST(1 + o_orderkey % 9000 AS {{S}})) AS citation_string,
  CAST(o_orderkey AS {{S}}) AS case_id, {jurisdiction_sql('o_custkey')} AS jurisdiction FROM {{orders}}""",
    "citation_refs": f"""
SELECT CAST(l_orderkey AS {{S}}) AS citing_case_id,
  CASE l_linenumber
    WHEN 1 THEN concat('No-', CAST(l_partkey AS {{S}}))
    WHEN 2 THEN concat('Customer#', lpad(CAST(l_suppkey AS {{S}}), 9, '0'), ' v. Supplier#', CAST(l_partkey % 10 AS {{S}}), ', 12 F.3d 9')
    WHEN 3 THEN concat('CUSTOMER#', lpad(CAST(l_suppkey AS {{S}}), 9, '0'), ' v.  Supplier#', CAST(l_partkey % 10 AS {{S}}))
    WHEN 4 THEN concat('omer#', lpad(CAST(l_suppkey % 40 AS {{S}}), 9, '0'), ' v. Supp, 9 F.2d 1')
    WHEN 5 THEN concat('o-', CAST(l_partkey AS {{S}}))
    ELSE concat('Unknown ', CAST(l_partkey % 100 AS {{S}}), ' v. Nobody') END AS citation_string,
  CASE WHEN l_suppkey % 2 = 0 THEN NULL ELSE {jurisdiction_sql('l_suppkey')} END AS jurisdiction
FROM {{lineitem}}""",
    "party_cases": f"""
SELECT CAST(o.o_orderkey AS {{S}}) AS case_id,
  concat(c.c_name, ' v. Supplier#', CAST(CASE WHEN o.o_orderkey % 3 = 0 THEN 0 ELSE o.o_orderkey % 97 END AS {{S}})) AS case_name,
  c.c_name AS plaintiff,
  concat('Supplier#', CAST(CASE WHEN o.o_orderkey % 3 = 0 THEN 0 ELSE o.o_orderkey % 97 END AS {{S}})) AS defendant,
  {jurisdiction_sql('c.c_nationkey % 6')} AS jurisdiction,
  CAST(year(o.o_orderdate) AS INT) AS year,
  CASE WHEN o.o_orderkey % 7 = 0 THEN 'settled' WHEN o.o_orderstatus = 'F' THEN 'defendant_win'
       WHEN o.o_orderstatus = 'O' THEN 'plaintiff_win' ELSE 'dismissed' END AS result
FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey""",
    "ip_stats": f"""
SELECT {_case(f'user_id % {len(_SOURCES)}', _SOURCES)} AS source,
  {_case(f'event_id % {len(_INDICATORS)}', _INDICATORS)} AS indicator,
  {jurisdiction_sql('user_id % 9')} AS jurisdiction, CAST(2018 + event_id % 7 AS INT) AS year,
  value, 'count' AS unit, concat(event_type, ' report ', CAST(event_id AS {{S}})) AS title, event_id AS seq
FROM {{events}}""",
    "national_stats": f"""
SELECT {_case(f'user_id % {len(_STATS)}', _STATS)} AS source,
  CASE event_type WHEN 'purchase' THEN 'trademark_applications' WHEN 'error' THEN 'design_applications'
       ELSE 'patent_applications' END AS indicator,
  {jurisdiction_sql('user_id % 12')} AS jurisdiction, CAST(2018 + event_id % 7 AS INT) AS year,
  value, 'count' AS unit, event_id AS seq
FROM {{events}}""",
    "ip_disputes": f"""
SELECT o.o_orderkey AS dispute_id, concat('Dispute ', c.c_name) AS title, d.text AS full_text,
  {_case('o.o_orderkey % 6', ['udrp', 'ptab', 'epo_opposition', 'itc337', 'upc', 'wipo_adr'])} AS dispute_type,
  {jurisdiction_sql('c.c_nationkey')} AS jurisdiction, CAST(CAST(o.o_orderdate AS DATE) AS {{S}}) AS decision_date
FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey
LEFT JOIN {{documents}} d ON d.doc_id = o.o_orderkey""",
    "statutes": f"""
SELECT p.p_partkey AS statute_id, concat(p.p_name, ' Act') AS law_name, {jurisdiction_sql('p.p_partkey')} AS jurisdiction,
  concat('Section ', CAST(p.p_size AS {{S}})) AS article, coalesce(d.text, p.p_type) AS text, p.p_type AS theme,
  concat(p.p_name, ' Act') AS title, coalesce(d.text, p.p_type) AS full_text,
  CAST(date '1990-01-01' + CAST(p.p_partkey % 9000 AS INT) AS {{S}}) AS effective_date,
  {_case('p.p_size % 4', ['local', 'uscode', 'eurlex', 'egov'])} AS _source
FROM {{part}} p LEFT JOIN {{documents}} d ON d.doc_id = p.p_partkey""",
    "local_cases": f"""
SELECT o.o_orderkey AS seq, concat(c.c_name, ' v. Supplier#', CAST(o.o_orderkey % 10 AS {{S}})) AS case_name,
  {jurisdiction_sql('c.c_nationkey')} AS jurisdiction,
  CASE o.o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'High Court' WHEN 2 THEN 'District Court'
       WHEN 3 THEN 'Patent Court' ELSE 'Tax Court' END AS court,
  CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE CAST(year(o.o_orderdate) AS INT) END AS year,
  CASE o.o_orderstatus WHEN 'F' THEN 'Defendant win' WHEN 'O' THEN 'Plaintiff win' ELSE 'pending' END AS result,
  concat(o.o_orderpriority, ' ', CASE o.o_orderkey % 6 WHEN 0 THEN 'relief granted' WHEN 1 THEN 'claim denied' ELSE 'n/a' END) AS summary,
  lower(c.c_mktsegment) AS domain, CASE WHEN o.o_orderkey % 4 = 0 THEN '' ELSE concat('topic', CAST(o.o_orderkey % 9 AS {{S}})) END AS topic,
  concat('kw', CAST(o.o_custkey % 31 AS {{S}})) AS keyword
FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey""",
    "matters": f"""
SELECT o_orderkey AS matter_id, {jurisdiction_sql('o_custkey')} AS jurisdiction,
  CASE o_orderkey % 4 WHEN 0 THEN 'Repeat uploads' WHEN 1 THEN 'an ongoing stream' ELSE 'single upload' END AS situation,
  CASE WHEN o_orderkey % 2 = 0 THEN true ELSE false END AS notification_sent,
  CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END AS response_received,
  CASE o_orderkey % 5 WHEN 0 THEN 'actual' WHEN 1 THEN 'Constructive' WHEN 2 THEN 'none' WHEN 3 THEN 'rumour' END AS knowledge_level
FROM {{orders}}""",
    "host_requests": """
SELECT concat('host', CAST(user_id AS {S})) AS host,
  CASE WHEN (event_id + user_id * user_id) % 5 = 0 THEN 1 ELSE 0 END AS referrer_policy,
  CASE WHEN (event_id + user_id) % 3 < user_id % 3 THEN 1 ELSE 0 END AS cf_ray,
  CASE WHEN event_type IN ('click', 'view', 'error') AND user_id % 2 = 0 THEN 1 ELSE 0 END AS cf_cache_status,
  CASE WHEN (event_id + user_id) % 7 < user_id % 7 THEN 1 ELSE 0 END AS range_206,
  CASE WHEN event_type <> 'signup' AND user_id % 4 < 2 THEN 1 ELSE 0 END AS x_amz
FROM {events}""",
    "forum_profiles": f"""
SELECT o_orderkey AS profile_id, {jurisdiction_sql('o_custkey')} AS server_location,
  {_case('o_orderkey % 4', ['com', 'EU', 'jp', ''])} AS target_domain_tld,
  {_case('o_orderkey % 3', ['Copyright', 'trademark', 'patent'])} AS ip_right_type,
  {_case('o_custkey % 3', ['cdn', 'streaming', 'marketplace'])} AS target_service_type,
  {jurisdiction_sql('o_orderkey')} AS market,
  CASE WHEN o_orderkey % 6 = 0 THEN 'large_scale' ELSE 'medium' END AS evidence_of_scale,
  CASE WHEN o_orderkey % 5 = 0 THEN 'DMCA notice' ELSE 'letter' END AS prior_action
FROM {{orders}}""",
    "jurisdiction_rules": f"""
SELECT {jurisdiction_sql('s_nationkey')} AS jurisdiction,
  {_case('s_suppkey % 3', ['512(b)', '512(c)', 'direct_liability'])} AS category,
  min(s_name) AS provision, max(s_name) AS requirement
FROM {{supplier}} WHERE s_nationkey < 20 GROUP BY 1, 2""",
    "entities": f"""
SELECT concat('e', CAST(c_custkey AS {{S}})) AS canonical_id,
  concat({_case('c_custkey % 6', ['Northern ', 'Atlas ', 'Blue River ', 'Granite ', 'Sun Valley ', 'Old Harbour '])},
         substr(md5(CAST(c_custkey AS {{S}})), 1, 9)) AS canonical_name,
  {jurisdiction_sql('c_nationkey')} AS country_code,
  {_case('c_custkey % 5', ['corporation', 'npe', 'university', 'government', 'individual'])} AS entity_type,
  lower(c_mktsegment) AS industry,
  CASE WHEN c_custkey % 10 <> 0 THEN concat('e', CAST(c_custkey - c_custkey % 10 AS {{S}})) END AS parent_id,
  concat(substr(md5(CAST(c_custkey AS {{S}})), 1, 9), ' Holdings') AS alias_1,
  CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE concat('Grupo ', substr(md5(CAST(c_custkey AS {{S}})), 1, 9)) END AS alias_2
FROM {{customer}}""",
    # names as written in filings: exact, decorated, misspelled, or unknown
    "party_names": f"""
SELECT canonical_id AS name_id, CASE right(canonical_id, 1)
    WHEN '0' THEN canonical_name WHEN '1' THEN concat(upper(canonical_name), ', Inc.') WHEN '2' THEN alias_1
    WHEN '3' THEN concat(substr(canonical_name, 1, 4), substr(canonical_name, 6))
    WHEN '4' THEN concat('x', canonical_name) WHEN '5' THEN concat('The  ', alias_2, '  GmbH')
    ELSE concat('Unlisted ', canonical_id) END AS raw_name FROM {{entities}}""",
    "snapshots": f"""
SELECT {_case('user_id % 3', ['ptab', 'upc', 'wipo_adr'])} AS source_id, event_type AS indicator,
  {jurisdiction_sql('user_id % 9')} AS country_code, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value,
  CAST(CAST(ts AS DATE) AS {{S}}) AS snapshot_day
FROM {{events}} GROUP BY 1, 2, 3, 5""",
    "query_log": f"""
SELECT item_id AS qid, lower(concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 4))) AS query, {jurisdiction_sql('item_id % 6')} AS jurisdiction
FROM {{benchmark}}""",
}

_SITES = [
    ("https://www.saflii.org/", "/za/cases/ZASCA/2019/{B1}.html"),
    ("https://ghalii.org/", "/akn/gh/judgment/ghasc/2018/{B1}"),
    ("https://tanzlii.org/", "/en/akn/tz/act/2010/{B1}"),
    ("https://www.riigiteataja.ee/en/", "/en/eli/{B1}"),
    ("https://lovdata.no/", "/lov/{B1}"),
    ("https://africanlii.org/en/", "/en/akn/za-gp/judgment/zagp/2021/{B1}"),
    ("https://laws-lois.justice.gc.ca/eng/", "/eng/acts/{B1}"),
]
# landed pages: the page table as seen on legal sites
VIEWS["landed_pages"] = (
    "SELECT page_id, CASE page_id % 8 "
    + " ".join(f"WHEN {i} THEN '{url}'" for i, (url, _) in enumerate(_SITES))
    + " ELSE url END AS url, CASE page_id % 8 "
    + " ".join(
        f"WHEN {i} THEN regexp_replace(html, 'href=\"/([^\"]*)\"', 'href=\"{path}\"'{{G}})"
        for i, (_, path) in enumerate(_SITES)
    )
    + " ELSE html END AS html FROM {pages}"
)

# the spellings that differ between the engines
_SPARK = {
    "{S}": "STRING",
    "{AGG}": "listagg(line, ' ') WITHIN GROUP (ORDER BY line)",
        "{G}": "", "{B1}": "$1",
}
_ANSI = {
    "{S}": "VARCHAR",
    "{AGG}": "string_agg(line, ' ' ORDER BY line)",
        "{G}": ", 'g'", "{B1}": "\\1",
}


def _spell(sql: str, words: dict[str, str]) -> str:
    for mark, text in words.items():
        sql = sql.replace(mark, text)
    return sql


def _parts(sql: str) -> list[str]:
    names = re.findall(r"\{(\w+)\}", sql)
    return [n for n in dict.fromkeys(names) if n in VIEWS or n in TABLES]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a view over the tables in ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _spell(VIEWS[name], _SPARK)
    return spark.sql(sql, **{part: load(spark, sf_dir, part) for part in _parts(sql)})


def with_views(*names: str) -> str:
    """``WITH ...`` prefix that defines the views for an ANSI engine."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        sql = _spell(VIEWS[name], _ANSI)
        for part in _parts(sql):
            if part in VIEWS and part not in done:
                add(part)
        done.setdefault(name, re.sub(r"\{(\w+)\}", r"\1", sql))

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({sql})" for n, sql in done.items()) + "\n"
