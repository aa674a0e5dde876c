"""Named queries: parties, statistics, disputes, scores, entities, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.fixed import analytics as AV
from lexspark.operators import aggregates as A
from lexspark.operators import entities as E
from lexspark.operators import events as EV
from lexspark.operators import filters as FL
from lexspark.operators import party as PT
from lexspark.operators import scoring as SC
from lexspark.plans import sql_parts as P
from lexspark.plans.registry import query
from lexspark.plans.views import load, with_views


def _party_cases(spark, d):
    return load(spark, d, "party_cases").withColumn("parties", F.array("plaintiff", "defendant")).withColumn(
        "defendants", F.when(F.length("case_id") % 2 == 0, F.array("defendant")).otherwise(F.array().cast("array<string>"))
    )


# ---- parties ---------------------------------------------------------------------

_PARTY = with_views("party_cases") + """,
r AS (SELECT defendant AS entity, case_id, jurisdiction, year, CASE WHEN result IN ('defendant_win', 'dismissed') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS win FROM party_cases),
base AS (SELECT entity, count(*) AS n_cases, CAST(sum(win) AS BIGINT) AS wins, CAST(sum(win) AS BIGINT)::DOUBLE / count(*) AS metric_value FROM r GROUP BY 1),
yr AS (SELECT entity, year, avg(win) AS rate FROM r WHERE year <> 0 GROUP BY 1, 2),
tr AS (SELECT entity, CASE WHEN count(*) >= 3 THEN coalesce(regr_slope(rate, year), 0) ELSE 0 END AS slope FROM yr GROUP BY 1),
seg AS (SELECT entity, jurisdiction, avg(win) AS rate, count(*) AS n FROM r GROUP BY 1, 2),
weak AS (SELECT entity, min((rate, jurisdiction)) AS w FROM seg GROUP BY 1),
perf AS (SELECT b.*, CASE WHEN n_cases >= 30 THEN 'reliable' WHEN n_cases >= 10 THEN 'limited' ELSE 'unreliable' END AS sample_quality,
  metric_value - 0.55 AS benchmark_delta, CASE WHEN slope > 0.01 THEN 'improving' WHEN slope < -0.01 THEN 'declining' ELSE 'stable' END AS trend,
  slope, w[2] AS weakest_segment, w[1] AS weakest_rate FROM base b JOIN tr USING (entity) JOIN weak USING (entity))
"""


@query("defendant_performance", _PARTY + """
SELECT entity, n_cases, wins, round(metric_value, 6) AS metric_value, sample_quality, 0.55::DOUBLE AS sector_benchmark,
  round(benchmark_delta, 6) AS benchmark_delta, trend, round(slope, 6) AS trend_rate, weakest_segment, round(weakest_rate, 6) AS weakest_rate FROM perf""")
def defendant_performance(spark, d):
    rows = PT.defendant_performance(_party_cases(spark, d), interval=False)
    return rows.select(
        "entity", "n_cases", "wins", F.round("metric_value", 6).alias("metric_value"), "sample_quality", "sector_benchmark",
        F.round("benchmark_delta", 6).alias("benchmark_delta"), "trend", F.round("trend_rate", 6).alias("trend_rate"),
        "weakest_segment", F.round("weakest_rate", 6).alias("weakest_rate"),
    )


def _pct(x: str) -> str:
    return f"concat(printf('%.1f', floor(({x}) * 1000 + 0.5) / 10), '%')"


# P(Beta(w + 1, l + 1) <= x) is the chance of more than w successes in n + 1 trials; a bound rounded
# to three places is the number of grid midpoints below it
_INTERVALS = _PARTY + f"""
, wn AS (SELECT DISTINCT n_cases AS n, wins AS w FROM perf),
tails AS (SELECT n, w, g, sum(exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n + 2 - j) + j * ln((g + 0.5) / 1000) + (n + 1 - j) * ln(1 - (g + 0.5) / 1000))) AS c
  FROM (SELECT n, w, unnest(range(w + 1, n + 2)) AS j FROM wn), range(0, 1000) t(g) GROUP BY n, w, g),
bounds AS (SELECT n, w, count(*) FILTER (c < 0.025) / 1000.0::DOUBLE AS lo, count(*) FILTER (c < 0.975) / 1000.0::DOUBLE AS hi FROM tails GROUP BY n, w),
judged AS (SELECT p.*, lo AS ci_lower, hi AS ci_upper, trend = 'declining' AND abs(slope) > {PT.TREND_SLOPE} AS falls, coalesce(weakest_rate < metric_value * 0.5, false) AS weak
  FROM perf p JOIN bounds ON n = n_cases AND w = wins)
"""


@query("defendant_intervals", _INTERVALS + f"""
SELECT entity, n_cases, wins, ci_lower, ci_upper, concat_ws(' | ',
  CASE WHEN n_cases < 10 THEN concat('Just ', n_cases, ' cases: too few to conclude from. Gather ten or more first.')
    WHEN n_cases < 30 THEN concat(n_cases, ' cases only: the interval is broad, so read the rate as a rough guide.') END,
  CASE WHEN falls THEN concat('Declining win rate: -', {_pct('abs(slope)')}, ' per year') END,
  CASE WHEN weak THEN concat('Critical weakness in ', weakest_segment, ': ', {_pct('weakest_rate')}, ' vs overall ', {_pct('metric_value')}) END,
  CASE WHEN ci_upper - ci_lower > 0.3 THEN concat('The interval is ', {_pct('ci_upper - ci_lower')}, ' wide, so little is certain') END) AS red_flags FROM judged""")
def defendant_intervals(spark, d):
    rows = PT.red_flags(PT.defendant_performance(_party_cases(spark, d)))
    return rows.select("entity", "n_cases", "wins", "ci_lower", "ci_upper", F.array_join("red_flags", " | ").alias("red_flags"))


@query("defendant_cases", with_views("party_cases") + """
SELECT defendant AS entity, case_id, jurisdiction, year, CASE WHEN result IN ('defendant_win', 'dismissed') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS win FROM party_cases""")
def defendant_cases(spark, d):
    return PT.defendant_cases(_party_cases(spark, d))


@query("yearly_win_rates", _PARTY + "SELECT entity, year, round(rate, 6) AS rate FROM yr")
def yearly_win_rates(spark, d):
    rows = PT.yearly_rates(PT.defendant_cases(_party_cases(spark, d)))
    return rows.select("entity", "year", F.round("rate", 6).alias("rate"))


@query("segment_win_rates", _PARTY + "SELECT entity, jurisdiction, round(rate, 6) AS rate, n FROM seg")
def segment_win_rates(spark, d):
    rows = PT.segment_rates(PT.defendant_cases(_party_cases(spark, d)))
    return rows.select("entity", "jurisdiction", F.round("rate", 6).alias("rate"), "n")


# the overall rate is moved so that some segments lie three deviations off
@query("segment_outliers", _PARTY + """
, s AS (SELECT entity, stddev_samp(rate) AS sd FROM seg GROUP BY 1 HAVING count(*) >= 3)
SELECT entity, jurisdiction, round((rate - metric_value - 0.25) / sd, 6) AS z FROM seg JOIN base USING (entity) JOIN s USING (entity)
WHERE sd > 0 AND abs((rate - metric_value - 0.25) / sd) >= 3""")
def segment_outliers(spark, d):
    rows = PT.defendant_cases(_party_cases(spark, d))
    overall = rows.groupBy("entity").agg((F.sum("win") / F.count("*") + 0.25).alias("metric_value"))
    return PT.segment_outliers(PT.segment_rates(rows), overall).select("entity", "jurisdiction", F.round("z", 6).alias("z"))


@query("recommendations", _PARTY + """
SELECT entity, priority, count(*) AS n FROM (
  SELECT entity, 'URGENT' AS priority FROM perf WHERE n_cases < 10 UNION ALL SELECT entity, 'URGENT' FROM perf WHERE weakest_rate < metric_value * 0.5
  UNION ALL SELECT entity, 'SHORT_TERM' FROM perf WHERE trend = 'declining' UNION ALL SELECT entity, 'MID_TERM' FROM perf WHERE benchmark_delta < -0.05) GROUP BY 1, 2""")
def recommendations(spark, d):
    rows = PT.recommendations(PT.red_flags(PT.defendant_performance(_party_cases(spark, d))))
    return rows.groupBy("entity", "priority").agg(F.count("*").alias("n"))


@query("recommendation_texts", _INTERVALS + f"""
, y0 AS (SELECT entity, min(year) AS since FROM yr GROUP BY 1)
SELECT entity, r['rank'] AS rank, r['priority'] AS priority, r['icon'] AS icon, r['action'] AS action, r['rationale'] AS rationale FROM (
  SELECT entity, unnest([
    CASE WHEN n_cases < 10 THEN {{'rank': 0, 'priority': 'URGENT', 'icon': '🔴', 'action': 'Collect at least ten cases',
      'rationale': concat('With ', n_cases, ' cases the rate may lie anywhere from ', {_pct('ci_lower')}, ' to ', {_pct('ci_upper')}, '.')}} END,
    CASE WHEN weak THEN {{'rank': 0, 'priority': 'URGENT', 'icon': '🔴', 'action': concat('Avoid trial in ', weakest_segment, ': contest venue or settle'),
      'rationale': concat('Only ', {_pct('weakest_rate')}, ' of the cases in ', weakest_segment, ' are won, against ', {_pct('metric_value')}, ' in all; a trial there costs more than it brings.')}} END,
    CASE WHEN falls THEN {{'rank': 1, 'priority': 'SHORT_TERM', 'icon': '🟡', 'action': concat('Find out why the rate falls by ', {_pct('abs(slope)')}, ' a year'),
      'rationale': concat('Each year since ', since, ' has cost ', {_pct('abs(slope)')}, ' of the win rate, and nothing has stopped it so far.')}} END,
    CASE WHEN benchmark_delta < -0.05 THEN {{'rank': 2, 'priority': 'MID_TERM', 'icon': '🟢', 'action': concat('Catch up ', printf('%.1f', floor(abs(benchmark_delta) * 1000 + 0.5) / 10), ' points on the sector'),
      'rationale': concat('The sector wins 55.0%, this party ', {_pct('metric_value')}, ': compare its counsel, its notices procedure and its standard defences with those of its peers.')}} END
  ]) AS r FROM judged LEFT JOIN y0 USING (entity)) WHERE r IS NOT NULL""")
def recommendation_texts(spark, d):
    return PT.recommendations(PT.red_flags(PT.defendant_performance(_party_cases(spark, d))))


@query("sector_benchmarks", _PARTY + """
, bm AS (SELECT * FROM (VALUES ('cdn_provider', 0.55), ('streaming_platform', 0.48), ('ecommerce_marketplace', 0.52)) v(sector, value))
SELECT sector, count(*) FILTER (metric_value > value) AS above, count(*) FILTER (metric_value <= value) AS below FROM base, bm GROUP BY 1""")
def sector_benchmarks(spark, d):
    rows = PT.defendant_cases(_party_cases(spark, d)).groupBy("entity").agg((F.sum("win") / F.count("*")).alias("rate"))
    marks = {s: m["win_rate_defendant"] for s, m in AV.SECTOR_BENCHMARKS.items()}
    per = rows.select("rate", F.explode(F.create_map(*[F.lit(x) for kv in marks.items() for x in kv])).alias("sector", "value"))
    return per.groupBy("sector").agg(
        F.count_if(F.col("rate") > F.col("value")).alias("above"), F.count_if(F.col("rate") <= F.col("value")).alias("below")
    )


# ---- statistics -------------------------------------------------------------------

@query("enforcement_profile", with_views("ip_stats") + """
, s AS (SELECT *, source = 'ustr301' AND contains(indicator, 'priority_watch') AS pw, source = 'ustr301' AND contains(indicator, 'watch_list') AS wl,
  source = 'enforcement' AND contains(indicator, 'cbp') AND contains(indicator, 'share') AS c,
  source = 'enforcement' AND contains(indicator, 'eu') AND contains(indicator, 'share') AS e FROM ip_stats WHERE year >= 2020)
SELECT jurisdiction, CASE WHEN count(*) FILTER (pw) > 0 THEN 'Priority Watch List' WHEN count(*) FILTER (wl) > 0 THEN 'Watch List' END AS special_301_status,
  arg_max(value, seq) FILTER (c) AS cbp_seizure_share, arg_max(value, seq) FILTER (e) AS eu_seizure_share,
  CASE WHEN count(*) FILTER (source IN ('ustr301', 'enforcement')) = 0 THEN 'no_data' ELSE 'ok' END AS status FROM s GROUP BY 1""")
def enforcement_profile(spark, d):
    return A.enforcement_profile(load(spark, d, "ip_stats"))


_FORUMS = ", ".join(f"('{f}', '{s}', '{i}', '{j}')" for f, s, i, j in AV.FORUM_INDICATORS)


@query("forum_comparison", with_views("ip_stats") + f"""
, f AS (SELECT * FROM (VALUES {_FORUMS}) v(forum, source, indicator, jurisdiction)),
r AS (SELECT f.forum, s.year, s.value, row_number() OVER (PARTITION BY f.forum ORDER BY CASE WHEN s.year = 2021 THEN 0 ELSE 1 END, s.seq) AS n
  FROM f JOIN ip_stats s USING (source, indicator, jurisdiction) WHERE s.year >= 2021)
SELECT f.forum, f.indicator, f.jurisdiction, r.year, r.value, CASE WHEN r.forum IS NULL THEN 'no_data' ELSE 'ok' END AS status
FROM f LEFT JOIN r ON r.forum = f.forum AND r.n = 1""")
def forum_comparison(spark, d):
    return A.forum_comparison(load(spark, d, "ip_stats"), 2021)


@query("indicator_catalogue", with_views("ip_stats") + "SELECT DISTINCT source, indicator FROM ip_stats")
def indicator_catalogue(spark, d):
    return A.indicator_catalogue(load(spark, d, "ip_stats"))


_HOME = " ".join(f"WHEN '{j}' THEN '{s}'" for j, s in AV.STATS_HOME_SOURCE.items())


@query("search_statistics", with_views("national_stats") + f"""
, p AS (SELECT *, CASE WHEN source = CASE jurisdiction {_HOME} END THEN 0 WHEN source = 'wipo' THEN 1 WHEN source = 'worldbank' THEN 2
  WHEN source = 'oecd' THEN 3 WHEN source = 'gii' THEN 4 END AS priority FROM national_stats WHERE indicator = 'patent_applications' AND year >= 2019),
b AS (SELECT *, min(priority) OVER (PARTITION BY jurisdiction) AS m FROM p WHERE priority IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction ORDER BY seq) AS position FROM b WHERE priority = m)
SELECT jurisdiction, source, year, value, CAST(position AS INT) AS position FROM n WHERE position <= 10""")
def search_statistics(spark, d):
    return A.search_statistics(load(spark, d, "national_stats"), "patent_applications", 2019).select(
        "jurisdiction", "source", "year", "value", "position"
    )


@query("statistics_of_source", with_views("national_stats") + """
, n AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction ORDER BY seq) AS position FROM national_stats
  WHERE source = 'oecd' AND indicator = 'trademark_applications')
SELECT jurisdiction, year, value, CAST(position AS INT) AS position FROM n WHERE position <= 10""")
def statistics_of_source(spark, d):
    return A.statistics_of_source(load(spark, d, "national_stats"), "oecd", "trademark_applications").select(
        "jurisdiction", "year", "value", "position"
    )


def _priority(column: str) -> str:
    arms = " ".join(
        f"WHEN '{j}' THEN list_position([{', '.join(P.quoted(s) for s in order)}], source)" for j, order in AV.DISPUTE_PRIORITY.items()
    )
    default = ", ".join(P.quoted(s) for s in AV.DISPUTE_DEFAULT_PRIORITY)
    return f"CASE {column} {arms} ELSE list_position([{default}], source) END"


@query("dispute_search", with_views("ip_stats") + f"""
, p AS (SELECT *, {_priority('jurisdiction')} AS pr FROM ip_stats WHERE (contains(indicator, 'filed') OR contains(lower(title), 'filed')) AND year >= 2019),
c AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction, pr ORDER BY seq) AS k FROM p WHERE pr > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction ORDER BY pr, k) AS position FROM c WHERE k <= 10)
SELECT jurisdiction, source, indicator, seq, CAST(position AS INT) AS position FROM n WHERE position <= 10""")
def dispute_search(spark, d):
    return A.dispute_search(load(spark, d, "ip_stats"), "filed", 2019).select(
        "jurisdiction", "source", "indicator", "seq", "position"
    )


@query("dispute_search_all", with_views("ip_stats") + """
, c AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction, source ORDER BY seq) AS k FROM ip_stats WHERE contains(indicator, 'share'))
SELECT jurisdiction, source, indicator, seq FROM c WHERE k <= 10""")
def dispute_search_all(spark, d):
    return A.dispute_search(load(spark, d, "ip_stats"), "share", source="all").select("jurisdiction", "source", "indicator", "seq")


# ---- disputes ---------------------------------------------------------------------

@query("search_disputes", with_views("ip_disputes") + """
SELECT dispute_id, title, dispute_type, jurisdiction, decision_date FROM ip_disputes WHERE (contains(lower(title), 'ing') OR contains(lower(full_text), 'ing'))
  AND dispute_type = 'udrp' AND jurisdiction = 'GB' ORDER BY decision_date DESC, dispute_id LIMIT 20""")
def search_disputes(spark, d):
    return FL.search_disputes(load(spark, d, "ip_disputes"), "ing", "udrp", "GB").drop("full_text")


def _local(spark, d):
    return load(spark, d, "local_cases").withColumn("keywords", F.array("keyword", "domain"))


_SPACE = "lower(concat_ws(' ', coalesce(topic, ''), coalesce(summary, ''), coalesce(domain, ''), keyword, domain))"


@query("local_cases", with_views("local_cases") + f"""
SELECT seq, case_name, court, year FROM local_cases WHERE jurisdiction = 'US' AND (year IS NULL OR (year >= 1996 AND year <= 1999))
  AND contains({_SPACE}, 'urgent') AND (contains({_SPACE}, 'kw1') OR contains({_SPACE}, 'granted'))""")
def local_cases(spark, d):
    return FL.local_cases(_local(spark, d), "us ", "Urgent", ["KW1", "granted"], 1996, 1999).select("seq", "case_name", "court", "year")


@query("local_statutes", with_views("statutes") + """
SELECT statute_id, law_name, article FROM statutes WHERE jurisdiction = 'GB' AND contains(lower(article), 'section 1')
  AND (contains(lower(concat_ws(' ', law_name, article, text, theme)), 'promo') OR contains(lower(concat_ws(' ', law_name, article, text, theme)), 'ring'))""")
def local_statutes(spark, d):
    return FL.local_statutes(load(spark, d, "statutes"), "gb", article="Section 1", keywords=["promo", "ring"]).select(
        "statute_id", "law_name", "article"
    )


_STATUTE_HOME = " ".join(f"WHEN '{j}' THEN '{s}'" for j, s in AV.STATUTE_HOME_SOURCE.items())


@query("statutes_by_source", with_views("statutes") + f"""
, p AS (SELECT *, CASE WHEN _source = CASE jurisdiction {_STATUTE_HOME} END THEN 1 WHEN _source = 'local' THEN 2 END AS pr FROM statutes
  WHERE contains(lower(law_name), 'ring')),
b AS (SELECT *, min(pr) OVER (PARTITION BY jurisdiction) AS m FROM p WHERE pr IS NOT NULL)
SELECT statute_id, jurisdiction, _source FROM b WHERE pr = m""")
def statutes_by_source(spark, d):
    rows = FL.statutes_by_source(load(spark, d, "statutes"), AV.STATUTE_HOME_SOURCE, law_name="ring")
    return rows.select("statute_id", "jurisdiction", "_source")


@query("article_lookup", with_views("statutes") + """
SELECT statute_id, contains(regexp_replace(lower(article), '\\s+', '', 'g'), 'section1') AS starts, regexp_replace(lower(article), '\\s+', '', 'g') = 'section12' AS same
FROM statutes WHERE contains(regexp_replace(lower(article), '\\s+', '', 'g'), 'section1')""")
def article_lookup(spark, d):
    a = F.col("article")
    starts, same = FL.article_matches(a, " Section 1 "), FL.article_matches(a, "SECTION 12", exact=True)
    return load(spark, d, "statutes").where(starts).select("statute_id", starts.alias("starts"), same.alias("same"))


_DISPUTE = with_views("local_cases") + """,
m AS (SELECT *, lower(concat(coalesce(result, ''), ' ', coalesce(summary, ''))) AS said FROM local_cases
  WHERE contains(lower(concat_ws(' ', case_name, summary, keyword, domain)), 'supplier#3') OR contains(lower(concat_ws(' ', case_name, summary, keyword, domain)), 'kw7')),
k AS (SELECT *, CASE WHEN regexp_matches(said, '勝訴|plaintiff win|prevailed|complainant win|transfer ordered|granted') THEN 'win'
  WHEN regexp_matches(said, '敗訴|defendant win|dismissed|denied|rejected') THEN 'loss' END AS kind FROM m)
"""
_PROFILE = """count(*) AS n_cases, count(*) FILTER (kind = 'win') AS wins, count(*) FILTER (kind = 'loss') AS losses, min(year) AS year_from, max(year) AS year_to,
  count(*) - count(*) FILTER (kind = 'win') - count(*) FILTER (kind = 'loss') AS partial,
  CASE WHEN count(*) FILTER (kind = 'win') > count(*) FILTER (kind = 'loss') THEN 'High' WHEN count(*) FILTER (kind = 'win') = count(*) FILTER (kind = 'loss') THEN 'Medium' ELSE 'Low' END AS enforcement_likelihood,
  CASE WHEN count(*) < 10 THEN 'サンプルが限られているため傾向の信頼性は低い' ELSE '' END AS low_sample_note"""


@query("dispute_profile", _DISPUTE + f"SELECT jurisdiction, {_PROFILE} FROM k GROUP BY 1")
def dispute_profile(spark, d):
    return A.dispute_profile(A.matched_cases(_local(spark, d), ["Supplier#3", "kw7"]), ["jurisdiction"])


@query("dispute_leaders", _DISPUTE + """
, u AS (SELECT 'forum' AS dimension, coalesce(nullif(court, ''), nullif(jurisdiction, ''), 'unknown') AS value FROM m
  UNION ALL SELECT 'sector', coalesce(nullif(topic, ''), nullif(domain, ''), 'unknown') FROM m),
c AS (SELECT dimension, value, count(*) AS n FROM u GROUP BY 1, 2)
SELECT dimension, value, n, CAST(position AS INT) AS position FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, value) AS position FROM c) WHERE position <= 5""")
def dispute_leaders(spark, d):
    return A.dispute_leaders(A.matched_cases(_local(spark, d), ["Supplier#3", "kw7"]))


@query("sector_profile", _DISPUTE.replace("'supplier#3'", "'machinery'").replace("'kw7'", "'machinery'") + f"SELECT {_PROFILE} FROM k WHERE year IS NULL OR year >= 1997")
def sector_profile(spark, d):
    return A.sector_profile(_local(spark, d), "Machinery", 1997)


# ---- scores -----------------------------------------------------------------------

@query("legal_risk", with_views("matters") + """
, x AS (SELECT *, notification_sent AND NOT coalesce(response_received, false) AS silent, lower(coalesce(knowledge_level, 'none')) AS lv,
  regexp_matches(lower(situation), 'repeat|systemic|ongoing') AS rep FROM matters),
s AS (SELECT *, silent AND jurisdiction IN ('JP', 'EU') AS post FROM x),
t AS (SELECT *, CAST(1 + notification_sent::INT + silent::INT + CASE lv WHEN 'none' THEN -1 WHEN 'constructive' THEN 1 WHEN 'actual' THEN 2 ELSE 0 END + rep::INT + post::INT AS INT) AS score FROM s)
SELECT matter_id, score, CASE WHEN score <= 1 THEN 'Low' WHEN score <= 3 THEN 'Medium' ELSE 'High' END AS risk_level,
  concat('Grounds: ', concat_ws(', ', CASE WHEN notification_sent THEN 'a notice was sent' END, CASE WHEN silent THEN 'the notice went unanswered' END,
    'knowledge: ' || lv, CASE WHEN rep THEN 'the conduct recurs' END,
    CASE WHEN post THEN 'courts there look at what follows a notice' END), '.') AS basis FROM t""")
def legal_risk(spark, d):
    return SC.legal_risk(load(spark, d, "matters")).select("matter_id", "score", "risk_level", "basis")


# a catalogue in the shape of the forum list
FORUMS = [
    {"forum": "US Federal Court", "forum_id": "us_federal_court", "suitability_base_score": 3,
     "applicability": {"server_locations": ["US", "CA"], "tlds": ["com"], "ip_types": ["copyright", "patent"], "service_types": ["cdn"]}},
    {"forum": "EU Court", "forum_id": "eu_court", "suitability_base_score": 2,
     "applicability": {"server_locations": ["EU", "DE", "FR"], "tlds": ["eu"], "ip_types": ["trademark"], "service_types": ["marketplace"]}},
    {"forum": "Tokyo District Court", "forum_id": "jp_tokyo", "suitability_base_score": 1,
     "applicability": {"server_locations": ["JP"], "tlds": ["jp"], "ip_types": ["copyright"], "service_types": ["streaming", "cdn"]}},
]


def _profiles(spark, d):
    return load(spark, d, "forum_profiles").withColumn("target_server_locations", F.array(F.lower("server_location"))).withColumn(
        "user_market_focus", F.array("market")
    ).withColumn("prior_actions", F.array("prior_action"))


def _forum_sql() -> str:
    arms = []
    for f in FORUMS:
        app = f["applicability"]
        lists = {k: ", ".join(P.quoted(x) for x in v) for k, v in app.items()}
        arms.append(
            f"SELECT profile_id, {P.quoted(f['forum'])} AS forum, least(10, {f['suitability_base_score']} + CASE WHEN server_location IN ({lists['server_locations']}) THEN 2 ELSE 0 END"
            f" + CASE WHEN lower(target_domain_tld) IN ({lists['tlds']}) THEN 1 ELSE 0 END + CASE WHEN lower(ip_right_type) IN ({lists['ip_types']}) THEN 2 ELSE 0 END"
            f" + CASE WHEN target_service_type IN ({lists['service_types']}) THEN 1 ELSE 0 END + CASE WHEN market IN ({lists['server_locations']}) THEN 1 ELSE 0 END"
            f" + CASE WHEN prior_action LIKE 'DMCA%' AND {str(f['forum_id'] == 'us_federal_court').lower()} THEN 1 ELSE 0 END"
            f" + CASE WHEN evidence_of_scale = 'large_scale' THEN 1 ELSE 0 END) AS score FROM forum_profiles"
        )
    return ", fs AS (" + " UNION ALL ".join(arms) + "), sc AS (SELECT *, CASE WHEN score >= 7 THEN 'High' WHEN score >= 5 THEN 'Medium' ELSE 'Low' END AS suitability FROM fs WHERE score >= 3)\n"


@query("score_forums", with_views("forum_profiles") + _forum_sql() + "SELECT profile_id, forum, CAST(score AS INT) AS score, suitability FROM sc")
def score_forums(spark, d):
    return SC.score_forums(_profiles(spark, d), FORUMS).drop("forum_id")


@query("enforcement_strategy", with_views("forum_profiles") + _forum_sql() + """
, g AS (SELECT profile_id, string_agg('File action in ' || forum, '|' ORDER BY -score, forum) FILTER (suitability = 'High') AS h,
  string_agg('Evaluate ' || forum, '|' ORDER BY -score, forum) FILTER (suitability = 'Medium') AS m FROM sc GROUP BY 1)
SELECT profile_id, concat_ws('|', h, 'Send Search notices immediately') AS short_term, coalesce(m, 'Weigh administrative and voluntary routes') AS mid_term FROM g""")
def enforcement_strategy(spark, d):
    rows = SC.enforcement_strategy(SC.score_forums(_profiles(spark, d), FORUMS), "Search")
    return rows.select("profile_id", F.array_join("short_term", "|").alias("short_term"), F.array_join("mid_term", "|").alias("mid_term"))


@query("classify_hosts", with_views("host_requests") + """
, r AS (SELECT host, sum(referrer_policy)::DOUBLE / count(*) AS a, sum(cf_ray)::DOUBLE / count(*) AS b, sum(cf_cache_status)::DOUBLE / count(*) AS c,
  sum(range_206)::DOUBLE / count(*) AS e, sum(x_amz)::DOUBLE / count(*) AS f FROM host_requests GROUP BY 1),
n AS (SELECT *, CASE WHEN a > 0.5 THEN 'P3' WHEN b <= 0.5 THEN 'E1' WHEN c <= 0.5 THEN CASE WHEN e <= 0.5 THEN 'P4' ELSE 'P1' END WHEN f <= 0.5 THEN 'P2a' ELSE 'E2' END AS node FROM r)
SELECT host, CASE node WHEN 'P1' THEN 'R2 Direct' WHEN 'P2a' THEN 'R2+CDN' WHEN 'P3' THEN 'Pages' WHEN 'P4' THEN 'Workers' WHEN 'E1' THEN 'S3 Direct' ELSE 'S3+CDN' END AS origin_estimate,
  CASE WHEN node IN ('P1', 'P2a', 'P4') THEN '512(b)' WHEN node = 'P3' THEN '512(c)' ELSE 'direct_liability' END AS legal_category,
  CASE WHEN abs(a - 0.5) < 0.05 OR abs(b - 0.5) < 0.05 THEN 0.75::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM n""")
def classify_hosts(spark, d):
    return SC.classify_hosts(SC.host_rates(load(spark, d, "host_requests")))


@query("assess_safe_harbor", with_views("matters", "jurisdiction_rules") + """
, q AS (SELECT matter_id, jurisdiction, CASE matter_id % 4 WHEN 0 THEN 'R2 Direct' WHEN 1 THEN 'P3' WHEN 2 THEN 'E2' ELSE 'nowhere' END AS origin_estimate FROM matters),
c AS (SELECT *, CASE WHEN origin_estimate = 'R2 Direct' THEN '512(b)' WHEN origin_estimate = 'P3' THEN '512(c)' ELSE 'direct_liability' END AS category FROM q)
SELECT c.matter_id, c.jurisdiction, c.category, r.provision, r.requirement,
  CASE WHEN c.jurisdiction NOT IN (SELECT jurisdiction FROM jurisdiction_rules) THEN concat('Unsupported jurisdiction: ', c.jurisdiction) END AS error
FROM c LEFT JOIN jurisdiction_rules r USING (jurisdiction, category)""")
def assess_safe_harbor(spark, d):
    asked = load(spark, d, "matters").selectExpr(
        "matter_id", "jurisdiction",
        "CASE matter_id % 4 WHEN 0 THEN 'R2 Direct' WHEN 1 THEN 'P3' WHEN 2 THEN 'E2' ELSE 'nowhere' END AS origin_estimate",
    )
    return SC.assess_safe_harbor(asked, load(spark, d, "jurisdiction_rules")).drop("origin_estimate")


# ---- entities ---------------------------------------------------------------------

def _entities(spark, d):
    return load(spark, d, "entities").withColumn("aliases", F.array("alias_1", "alias_2"))


def _norm(expr: str) -> str:
    forms = "|".join(AV.LEGAL_SUFFIXES)
    plain = f"trim(regexp_replace(regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace(regexp_replace({plain}, '(\\s+({forms}))+$', ''), '^the\\s+', ''))"


_RESOLVED = with_views("entities", "party_names") + f""",
nm AS (SELECT DISTINCT canonical_id, unnest([canonical_name, canonical_id, alias_1, alias_2]) AS name FROM entities),
kn AS (SELECT *, {_norm('name')} AS norm FROM nm),
asked AS (SELECT DISTINCT raw_name, {_norm('raw_name')} AS q FROM party_names),
ex AS (SELECT raw_name, min(canonical_id) AS id FROM asked JOIN nm ON name = raw_name GROUP BY 1),
no AS (SELECT raw_name, min(canonical_id) AS id FROM asked JOIN kn ON norm = q WHERE raw_name NOT IN (SELECT raw_name FROM ex) GROUP BY 1),
fz AS (SELECT raw_name, canonical_id, 1.0 - levenshtein(q, norm)::DOUBLE / greatest(length(q), length(norm)) AS s FROM asked, kn
  WHERE raw_name NOT IN (SELECT raw_name FROM ex UNION SELECT raw_name FROM no) AND norm <> '' AND q <> '' AND abs(length(q) - length(norm)) <= 0.15 * greatest(length(q), length(norm)) + 0.001
  AND levenshtein(q, norm) <= floor(greatest(length(q), length(norm)) * 0.15 + 0.000001)),
fb AS (SELECT raw_name, min((-s, canonical_id)) AS m FROM fz GROUP BY 1),
res AS (SELECT raw_name, id AS canonical_id, 1.0::DOUBLE AS confidence, 'exact' AS match_level FROM ex UNION ALL SELECT raw_name, id, 0.95, 'normalized' FROM no
  UNION ALL SELECT raw_name, m[2], round(-m[1], 3), 'fuzzy' FROM fb)
"""


@query("resolve_names", _RESOLVED + "SELECT a.raw_name, r.canonical_id, r.confidence, r.match_level FROM asked a LEFT JOIN res r USING (raw_name)")
def resolve_names(spark, d):
    return E.resolve_names(load(spark, d, "party_names"), _entities(spark, d))


@query("candidate_entities", _RESOLVED + """
, cand AS (SELECT raw_name, canonical_id, confidence FROM res UNION ALL SELECT DISTINCT a.raw_name, n.canonical_id, NULL::DOUBLE FROM asked a JOIN nm n ON contains(lower(n.name), lower(a.raw_name))
  WHERE (a.raw_name, n.canonical_id) NOT IN (SELECT (raw_name, canonical_id) FROM res)),
t AS (SELECT *, row_number() OVER (PARTITION BY raw_name ORDER BY confidence DESC NULLS LAST, canonical_id) AS position FROM cand)
SELECT t.raw_name, t.canonical_id, t.confidence, CAST(t.position AS INT) AS position, e.canonical_name, e.country_code, e.parent_id,
  concat_ws('|', least(alias_1, alias_2), greatest(alias_1, alias_2)) AS aliases_sample FROM t JOIN entities e USING (canonical_id) WHERE position <= 5""")
def candidate_entities(spark, d):
    rows = E.candidate_entities(load(spark, d, "party_names"), _entities(spark, d))
    return rows.select(
        "raw_name", "canonical_id", "confidence", "position", "canonical_name", "country_code", "parent_id",
        F.array_join("aliases_sample", "|").alias("aliases_sample"),
    )


@query("party_entities", _RESOLVED + """
SELECT p.name_id, CASE WHEN r.confidence >= 0.85 THEN r.canonical_id END AS normalized_entity_id FROM party_names p LEFT JOIN res r USING (raw_name)""")
def party_entities(spark, d):
    names = load(spark, d, "party_names")
    return E.resolve_parties(names, E.resolve_names(names, _entities(spark, d))).select("name_id", "normalized_entity_id")


@query("search_entities", with_views("entities") + """
SELECT canonical_id, canonical_name, entity_type FROM entities WHERE (contains(canonical_id, 'river') OR contains(lower(canonical_name), 'river') OR contains(lower(alias_1), 'river') OR contains(lower(alias_2), 'river'))
  AND country_code = 'GB' AND contains(lower(industry), 'a') ORDER BY canonical_id LIMIT 20""")
def search_entities(spark, d):
    return E.search_entities(_entities(spark, d), "River", "gb", None, "A").select("canonical_id", "canonical_name", "entity_type")


@query("entity_search_terms", with_views("entities") + """
, own AS (SELECT canonical_id, unnest([canonical_name, canonical_id, alias_1, alias_2]) AS term FROM entities),
rel AS (SELECT canonical_id, unnest([canonical_name, alias_1, alias_2]) AS term FROM entities),
lk AS (SELECT canonical_id, parent_id AS r FROM entities WHERE parent_id IS NOT NULL UNION ALL SELECT parent_id, canonical_id FROM entities WHERE parent_id IS NOT NULL)
SELECT canonical_id, count(DISTINCT term) AS terms FROM (SELECT * FROM own UNION ALL SELECT lk.canonical_id, rel.term FROM lk JOIN rel ON rel.canonical_id = lk.r
  WHERE lk.canonical_id IN (SELECT canonical_id FROM entities)) GROUP BY 1""")
def entity_search_terms(spark, d):
    return E.search_terms_of(_entities(spark, d), group=True).groupBy("canonical_id").agg(F.count("*").alias("terms"))


# titles of the statistics mention entities by their first alias
@query("entity_profile", with_views("entities", "ip_stats") + """
, st AS (SELECT jurisdiction, source, seq, lower(concat(title, ' of ', substr(md5(CAST(seq % 97 AS VARCHAR)), 1, 9), ' holdings')) AS title FROM ip_stats),
tm AS (SELECT canonical_id, country_code, lower(unnest([canonical_name, canonical_id, alias_1, alias_2])) AS term FROM entities),
h AS (SELECT DISTINCT t.canonical_id, s.source, s.seq FROM tm t JOIN st s ON s.jurisdiction = t.country_code AND contains(s.title, t.term)),
c AS (SELECT canonical_id, source, count(*) AS n FROM h GROUP BY 1, 2)
SELECT canonical_id, count(*) AS sources_with_data, CAST(sum(n) AS BIGINT) AS total_data_points FROM c GROUP BY 1""")
def entity_profile(spark, d):
    stats = load(spark, d, "ip_stats").withColumn(
        "title", F.expr("concat(title, ' of ', substr(md5(CAST(seq % 97 AS STRING)), 1, 9), ' holdings')")
    )
    entities = _entities(spark, d)
    return E.entity_totals(E.entity_activity(E.search_terms_of(entities), entities, stats))


# ---- events -----------------------------------------------------------------------

_CHANGES = with_views("snapshots") + """,
l AS (SELECT *, lag(value) OVER (PARTITION BY source_id, indicator, country_code ORDER BY snapshot_day) AS old FROM snapshots),
ch AS (SELECT *, CASE WHEN old <> 0 THEN (value - old) / abs(old) * 100.0 END AS pct FROM l),
ev AS (SELECT *, CASE WHEN abs(pct) >= 50 THEN 'critical' WHEN abs(pct) >= 25 THEN 'warning' WHEN abs(pct) >= 10 THEN 'info' END AS severity FROM ch)
"""


@query("detect_changes", _CHANGES + """
SELECT severity, source_id, indicator, country_code, old AS old_value, value AS new_value, round(pct, 6) AS change_pct, snapshot_day AS detected_at,
  concat('change_', severity) AS rule_id, concat(source_id, ' ', indicator, ' ', country_code, CASE WHEN pct > 0 THEN ' rose' ELSE ' fell' END) AS title FROM ev WHERE severity IS NOT NULL""")
def detect_changes(spark, d):
    rows = EV.detect_changes(load(spark, d, "snapshots"), at="snapshot_day")
    return rows.withColumn("change_pct", F.round("change_pct", 6)).drop("description")


@query("latest_changes", _CHANGES + """
SELECT severity, source_id, indicator, country_code, old AS old_value, value AS new_value FROM ev e WHERE severity IS NOT NULL
  AND snapshot_day = (SELECT max(snapshot_day) FROM snapshots s WHERE s.source_id = e.source_id AND s.indicator = e.indicator AND s.country_code = e.country_code)""")
def latest_changes(spark, d):
    rows = EV.latest_changes(load(spark, d, "snapshots"), at="snapshot_day")
    return rows.select("severity", "source_id", "indicator", "country_code", "old_value", "new_value")


@query("filter_events", _CHANGES + """
SELECT severity, source_id, indicator, country_code, snapshot_day AS detected_at FROM ev WHERE severity IS NOT NULL AND source_id = 'ptab' AND country_code = 'US'
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, snapshot_day DESC, source_id, indicator, country_code LIMIT 20""")
def filter_events(spark, d):
    events = EV.detect_changes(load(spark, d, "snapshots"), at="snapshot_day")
    return EV.filter_events(events, None, "ptab", "US").select("severity", "source_id", "indicator", "country_code", "detected_at")


@query("event_history", _CHANGES + """
SELECT severity, source_id, indicator, country_code, snapshot_day AS detected_at FROM ev WHERE severity = 'critical' AND CAST(snapshot_day AS TIMESTAMP) >= TIMESTAMP '2024-01-25 00:00:00'
ORDER BY snapshot_day DESC, source_id, indicator, country_code LIMIT 20""")
def event_history(spark, d):
    events = EV.detect_changes(load(spark, d, "snapshots"), at="snapshot_day")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return EV.event_history(events, 7, "critical", now=now).select("severity", "source_id", "indicator", "country_code", "detected_at")


@query("take_snapshot", with_views("ip_stats") + """
SELECT source AS source_id, indicator, jurisdiction AS country_code, arg_max(value, seq) AS value FROM ip_stats GROUP BY 1, 2, 3""")
def take_snapshot(spark, d):
    return EV.snapshot_rows(load(spark, d, "ip_stats")).drop("snapshot_ts")


@query("snapshot_counts", with_views("ip_stats") + """
SELECT count(*) AS snapshots_saved, count(DISTINCT source) AS sources_processed FROM (SELECT DISTINCT source, indicator, jurisdiction FROM ip_stats)""")
def snapshot_counts(spark, d):
    return EV.snapshot_counts(EV.snapshot_rows(load(spark, d, "ip_stats")))
