"""SQL fragments that the equivalents of several queries share."""

from __future__ import annotations

from lexspark.fixed import treatment as T
from lexspark.plans.views import with_views


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words_of(table: dict[str, list[str]]) -> list[str]:
    return [w.lower() for words in table.values() for w in words]


def any_word(expr: str, words: list[str]) -> str:
    return f"regexp_matches({expr}, {quoted('|'.join(words))})"


def treatment(expr: str) -> str:
    low = f"lower(coalesce({expr}, ''))"
    return (
        f"CASE WHEN {any_word(low, words_of(T.OVERRULING_KEYWORDS))} THEN 'overruling' "
        f"WHEN {any_word(low, words_of(T.DISTINGUISHING_KEYWORDS))} THEN 'distinguishing' ELSE 'neutral' END"
    )


def keyword(expr: str) -> str:
    low = f"lower(coalesce({expr}, ''))"
    arms = " ".join(
        f"WHEN contains({low}, {quoted(w)}) THEN {quoted(w)}"
        for w in words_of(T.OVERRULING_KEYWORDS) + words_of(T.DISTINGUISHING_KEYWORDS)
    )
    return f"CASE {arms} END"


def rank(court: str, jurisdiction: str) -> str:
    arms = []
    for code, levels in T.COURT_HIERARCHY.items():
        inner = " ".join(
            f"WHEN contains(lower({court}), {quoted(level.lower())}) THEN {i}" for i, level in enumerate(levels)
        )
        codes = "('UK', 'GB')" if code == "UK" else f"('{code}')"
        arms.append(f"WHEN {jurisdiction} IN {codes} THEN CASE {inner} ELSE {T.UNKNOWN_RANK} END")
    return f"CASE {' '.join(arms)} ELSE {T.UNKNOWN_RANK} END"


def validity_ctes() -> str:
    """Views, ``ranked`` cases and ``treated`` edges joined to their citing case."""
    return with_views("cases", "case_citations") + f""",
ranked AS (SELECT *, {rank('court', 'jurisdiction')} AS rnk FROM cases),
treated AS (SELECT cc.cited_case_id, cc.citing_case_id, cc.cited_reference, cc.citation_context,
  r.case_name, r.court, r.jurisdiction, r.decision_date, r.rnk, {treatment('cc.citation_context')} AS kind
  FROM case_citations cc JOIN ranked r ON r.case_id = cc.citing_case_id WHERE cc.cited_case_id IS NOT NULL)
"""


NORM = "lower(regexp_replace(regexp_replace(trim({0}), '\\s+', ' ', 'g'), '\\.\\s+', '.', 'g'))"


def resolve_ctes(refs: str, more_index: str = "") -> str:
    """``best(citation_string, jurisdiction, b)`` with b = (rank, case id) for the rows of ``refs``.

    Needs ``cases``; ``more_index`` is a query of further index rows (string, case id, jurisdiction).
    """
    more = f" UNION ALL {more_index}" if more_index else ""
    return f"""
refs AS ({refs}),
idx AS (SELECT DISTINCT unnest([case_number, case_name, {NORM.format('case_name')}]) AS s, case_id, jurisdiction AS j FROM cases{more}),
named AS (SELECT *, CASE WHEN contains(citation_string, ' v. ') OR contains(citation_string, ' v ') THEN
    trim(regexp_replace(regexp_replace(citation_string, ',\\s*\\d.*$', ''), '\\s+', ' ', 'g')) END AS nm FROM refs),
keyed AS (SELECT *, lower(nm) AS lnm, lower(citation_string) AS lcs FROM named),
names AS (SELECT DISTINCT lower(case_name) AS lname FROM cases),
r1 AS (SELECT r.citation_string, r.jurisdiction, 1 AS k, i.case_id FROM named r JOIN idx i ON i.s = r.citation_string AND (r.jurisdiction IS NULL OR r.jurisdiction = i.j)),
r2 AS (SELECT r.citation_string, r.jurisdiction, 2 AS k, i.case_id FROM named r JOIN idx i ON i.s = {NORM.format('r.citation_string')}),
r3 AS (SELECT r.citation_string, r.jurisdiction, 3 AS k, c.case_id FROM named r JOIN cases c ON c.case_name = r.nm AND (r.jurisdiction IS NULL OR r.jurisdiction = c.jurisdiction)),
rest AS (SELECT * FROM keyed x WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3) u
  WHERE u.citation_string = x.citation_string AND u.jurisdiction IS NOT DISTINCT FROM x.jurisdiction)),
namehit AS (SELECT DISTINCT q.lnm, n.lname FROM (SELECT DISTINCT lnm FROM rest WHERE lnm <> '') q JOIN names n ON contains(n.lname, q.lnm)),
r4 AS (SELECT r.citation_string, r.jurisdiction, 4 AS k, c.case_id FROM rest r JOIN namehit h ON h.lnm = r.lnm JOIN cases c ON lower(c.case_name) = h.lname
  AND (r.jurisdiction IS NULL OR r.jurisdiction = c.jurisdiction)),
numhit AS (SELECT q.lcs, min(c.case_id) AS case_id FROM (SELECT DISTINCT lcs FROM rest) q JOIN cases c ON contains(lower(c.case_number), q.lcs) GROUP BY 1),
r5 AS (SELECT r.citation_string, r.jurisdiction, 5 AS k, h.case_id FROM rest r JOIN numhit h USING (lcs)),
best AS (SELECT citation_string, jurisdiction, min((k, case_id)) AS b FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3
  UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5) GROUP BY 1, 2)
"""


def terms(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def bm25_ctes(docs: str, doc_id: str, name: str, text: str, queries: str, match_all: bool = True) -> str:
    """``hits(qid, doc_id, score)`` of ``queries(qid, query)`` over ``docs``; starts with a comma."""
    return f""",
tok AS (SELECT {doc_id} AS doc_id, {terms(f"coalesce({name}, '')")} AS n, {terms(f"coalesce({text}, '')")} AS t FROM {docs}),
flat AS (SELECT doc_id, unnest(n) AS term, 1 AS a, 0 AS b, len(n) + len(t) AS dl FROM tok
  UNION ALL SELECT doc_id, unnest(t), 0, 1, len(n) + len(t) FROM tok),
post AS (SELECT doc_id, term, sum(a) AS a, sum(b) AS b, max(dl) AS dl FROM flat GROUP BY ALL),
corpus AS (SELECT count(*) AS n, avg(len(n) + len(t)) AS avgdl FROM tok),
freq AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
want AS (SELECT DISTINCT qid, unnest({terms('query')}) AS term FROM {queries}),
need AS (SELECT qid, count(*) AS n FROM want GROUP BY 1),
hits AS (SELECT w.qid, p.doc_id, round(sum(greatest(ln((c.n - f.df + 0.5) / (f.df + 0.5)), 0.000001)
    * (10.0 * p.a + p.b) * 2.2 / ((10.0 * p.a + p.b) + 1.2 * (0.25 + 0.75 * p.dl / c.avgdl))), 9) AS score
  FROM want w JOIN post p USING (term) JOIN freq f USING (term) CROSS JOIN corpus c JOIN need USING (qid)
  GROUP BY w.qid, p.doc_id, need.n {'HAVING count(*) = need.n' if match_all else ''})
"""
