"""Benchmarks, risk weights, category maps and source priorities."""

# Fixed values.
SECTOR_BENCHMARKS = {
    "cdn_provider": {
        "win_rate_defendant": 0.55, "win_rate_plaintiff": 0.48, "settlement_rate": 0.18,
        "injunction_rate": 0.12, "median_duration_days": 450.0,
    },
    "streaming_platform": {
        "win_rate_defendant": 0.48, "win_rate_plaintiff": 0.62, "settlement_rate": 0.25,
        "injunction_rate": 0.35, "median_duration_days": 540.0,
    },
    "ecommerce_marketplace": {
        "win_rate_defendant": 0.52, "win_rate_plaintiff": 0.58, "settlement_rate": 0.30,
        "injunction_rate": 0.22, "median_duration_days": 480.0,
    },
}
WINNING_RESULTS = ["defendant_win", "dismissed"]

# Outcome words of a dispute profile; the win list is tested first.
WIN_SIGNALS = ["勝訴", "plaintiff win", "prevailed", "complainant win", "transfer ordered", "granted"]
LOSS_SIGNALS = ["敗訴", "defendant win", "dismissed", "denied", "rejected"]

# Fixed values of the risk score.
KNOWLEDGE_WEIGHTS = {"none": -1, "constructive": 1, "actual": 2}
REPEAT_WORDS = ["repeat", "systemic", "ongoing"]
POST_NOTICE_JURISDICTIONS = ["JP", "EU"]
RISK_CASES = {
    "US": ["Mon Cheri Bridals v. Cloudflare (N.D.Cal., 2025)", "Viacom v. YouTube (2d Cir., 2012)"],
    "JP": ["集英社他 v. Cloudflare (東京地裁, 2025)"],
    "EU": ["UMG v. Cloudflare (DE to CJEU, 2020-)", "AGCOM v. Cloudflare (IT administrative, 2026)"],
}
RISK_ACTIONS = {
    "Low": ["continue monitoring and preserve logs", "keep notice workflow documented"],
    "Medium": [
        "validate notice-and-action SLA", "perform targeted host review", "prepare counsel briefing memo",
    ],
    "High": [
        "escalate to external counsel immediately", "execute urgent takedown or access restriction",
        "preserve evidence and decision timeline",
    ],
}

# Fixed values of the host classification: node -> origin, node -> category.
ORIGIN_BY_NODE = {
    "P1": "R2 Direct", "P2a": "R2+CDN", "P3": "Pages", "P4": "Workers", "E1": "S3 Direct", "E2": "S3+CDN",
}
CATEGORY_BY_NODE = {
    "P1": "512(b)", "P2a": "512(b)", "P4": "512(b)", "P3": "512(c)",
    "E1": "direct_liability", "E2": "direct_liability",
}

# Forums compared across sources.
FORUM_INDICATORS = [
    ("WIPO UDRP", "wipo_adr", "udrp_cases_filed", "GLOBAL"),
    ("WIPO Mediation", "wipo_adr", "mediation_cases", "GLOBAL"),
    ("USITC Section 337", "itc337", "section337_investigations", "US"),
    ("EPO Opposition", "epo_opposition", "oppositions_filed", "EP"),
    ("USPTO PTAB IPR", "ptab", "ipr_petitions_filed", "US"),
    ("USPTO PTAB PGR", "ptab", "pgr_petitions_filed", "US"),
    ("UPC (Unified Patent Court)", "upc", "upc_cases_filed", "EU"),
    ("EUIPO TM Opposition", "euipo_opposition", "tm_oppositions_filed", "EU"),
]

# Statistics sources in fallback order, and the home source.
STATS_HOME_SOURCE = {
    "JP": "jpo", "CN": "cnipa", "KR": "kipo", "EU": "euipo",
    "EP": "epo", "US": "uspto", "GLOBAL": "wipo", "INTL": "wipo",
}
STATS_FALLBACK = ["wipo", "worldbank", "oecd", "gii"]
STATS_SOURCES = ["wipo", "uspto", "epo", "worldbank", "oecd", "jpo", "euipo", "gii", "cnipa", "kipo"]

# Preferred statute source per jurisdiction.
STATUTE_HOME_SOURCE = {
    "JP": "egov", "EU": "eurlex", "DE": "destatis", "UK": "ukleg", "FR": "legifrance",
    "WIPO": "wipolex", "US": "uscode", "AU": "auleg", "CA": "caleg", "KR": "krleg",
}

# Dispute sources, and the order they are read in per jurisdiction.
DISPUTE_SOURCES = [
    "wipo_adr", "itc337", "epo_opposition", "ptab", "ustr301", "enforcement", "upc", "gipc_index",
    "euipo_opposition", "oecd_counterfeit", "wipo_madrid", "wipo_hague", "wipo_lisbon", "wto_trips",
    "court_stats", "sep_frand", "upov", "wipo_tech_trends", "ieee_sa", "wipo_copyright_treaties",
    "us_copyright", "autm", "ip_australia", "cipo", "inpi_brazil", "ip_india", "ipos_singapore",
    "de_ip_courts",
]
DISPUTE_PRIORITY = {
    "US": [
        "ptab", "itc337", "ustr301", "enforcement", "us_copyright", "autm", "wipo_adr", "epo_opposition",
        "gipc_index", "wipo_madrid", "wipo_hague", "wipo_lisbon", "wto_trips", "court_stats", "sep_frand",
        "ieee_sa", "wipo_tech_trends", "wipo_copyright_treaties", "upov", "oecd_counterfeit", "upc",
        "euipo_opposition",
    ],
    "EP": [
        "epo_opposition", "wipo_adr", "enforcement", "upc", "euipo_opposition", "gipc_index", "wipo_madrid",
        "wipo_hague", "wipo_lisbon", "wto_trips", "court_stats", "sep_frand", "ieee_sa", "wipo_tech_trends",
        "wipo_copyright_treaties", "upov", "oecd_counterfeit",
    ],
    "EU": [
        "epo_opposition", "enforcement", "wipo_adr", "upc", "euipo_opposition", "gipc_index", "wipo_madrid",
        "wipo_hague", "wipo_lisbon", "wto_trips", "court_stats", "sep_frand", "ieee_sa", "wipo_tech_trends",
        "wipo_copyright_treaties", "upov", "oecd_counterfeit",
    ],
    "DE": [
        "de_ip_courts", "epo_opposition", "upc", "euipo_opposition", "wipo_adr", "enforcement", "sep_frand",
        "wipo_madrid", "wipo_hague", "wto_trips", "court_stats", "gipc_index", "oecd_counterfeit", "ieee_sa",
        "wipo_tech_trends",
    ],
    "AU": [
        "ip_australia", "upov", "wipo_adr", "enforcement", "gipc_index", "wipo_madrid", "wipo_hague",
        "wto_trips", "court_stats", "oecd_counterfeit", "wipo_tech_trends", "wipo_copyright_treaties",
    ],
    "CA": [
        "cipo", "autm", "upov", "wipo_adr", "enforcement", "gipc_index", "wipo_madrid", "wipo_hague",
        "wto_trips", "court_stats", "oecd_counterfeit", "wipo_tech_trends", "wipo_copyright_treaties",
    ],
    "BR": [
        "inpi_brazil", "upov", "wipo_adr", "enforcement", "ustr301", "gipc_index", "wipo_madrid",
        "wipo_hague", "wto_trips", "court_stats", "oecd_counterfeit", "wipo_tech_trends",
    ],
    "IN": [
        "ip_india", "upov", "wipo_adr", "enforcement", "ustr301", "gipc_index", "wipo_madrid",
        "wipo_hague", "wto_trips", "court_stats", "oecd_counterfeit", "wipo_tech_trends",
    ],
    "SG": [
        "ipos_singapore", "wipo_adr", "enforcement", "gipc_index", "wipo_madrid", "wipo_hague",
        "wto_trips", "court_stats", "oecd_counterfeit", "wipo_tech_trends", "wipo_copyright_treaties",
    ],
    "GLOBAL": [
        "wipo_adr", "ustr301", "enforcement", "ptab", "itc337", "epo_opposition", "upc", "gipc_index",
        "euipo_opposition", "oecd_counterfeit", "wipo_madrid", "wipo_hague", "wipo_lisbon", "wto_trips",
        "court_stats", "sep_frand", "upov", "wipo_tech_trends", "ieee_sa", "wipo_copyright_treaties",
        "us_copyright", "autm", "ip_australia", "cipo", "inpi_brazil", "ip_india", "ipos_singapore",
        "de_ip_courts",
    ],
}
# any other jurisdiction reads the first twenty sources of the global order
DISPUTE_DEFAULT_PRIORITY = DISPUTE_PRIORITY["GLOBAL"][:20]

# Our own values: relative change of an indicator that raises an event.
CHANGE_RULES = [("info", 10.0), ("warning", 25.0), ("critical", 50.0)]

# Our own values: confidence of each entity match level; the threshold is fixed.
MATCH_CONFIDENCE = {"exact": 1.0, "normalized": 0.95}
RESOLVE_THRESHOLD = 0.85
LEGAL_SUFFIXES = ["inc", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "gmbh", "ag", "sa", "kk"]
