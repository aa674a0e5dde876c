"""Treatment keywords and court hierarchies."""

# Fixed values. Languages and words in scan order; the first contained word wins.
OVERRULING_KEYWORDS = {
    "en": [
        "overruled", "overrule", "overrules", "overruling",
        "reversed", "reverse", "reverses", "reversing",
        "vacated", "vacate", "vacates", "vacating",
        "abrogated", "abrogate", "abrogates", "abrogating",
        "no longer good law", "superseded", "supersede",
        "overturned", "overturn", "overturns", "overturning",
    ],
    "ja": ["変更", "破棄", "取消", "取り消し", "廃棄", "判例変更", "先例変更", "覆す", "覆した"],
    "de": ["aufgehoben", "aufheben", "aufhebung", "überholt", "geändert", "abweichung", "nicht mehr anwendbar"],
    "fr": [
        "infirmé", "infirmer", "cassé", "casser", "annulé", "annuler",
        "renversé", "renverser", "abrogé", "abroger", "réformé", "réformer",
    ],
    "pl": ["uchylony", "uchylić", "uchylenie", "zmieniony", "zmienić", "zmiana", "nieważny", "unieważnić"],
    "it": ["annullato", "annullare", "cassato", "cassare", "riformato", "riformare", "revocato", "revocare"],
}

DISTINGUISHING_KEYWORDS = {
    "en": [
        "distinguished", "distinguish", "distinguishes", "distinguishing",
        "limited", "limiting", "narrowed", "narrowing",
        "questioned", "questioning", "doubted", "doubting",
        "criticized", "criticised", "criticizing", "criticising",
        "declined to follow", "declined to extend", "not followed", "not binding",
    ],
    "ja": ["区別", "射程外", "射程を限定", "限定解釈", "本件と事案を異にする", "事案が異なる", "疑問を呈", "批判"],
    "de": [
        "eingeschränkt", "einschränken", "einschränkung", "abweichend", "abweichung",
        "nicht anwendbar", "nicht einschlägig",
    ],
    "fr": ["distingué", "distinguer", "limité", "limiter", "critiqué", "critiquer", "nuancé", "nuancer"],
}

# Fixed values. Highest court first.
COURT_HIERARCHY = {
    "US": ["Supreme Court", "Circuit Court", "Court of Appeals", "District Court", "Bankruptcy Court"],
    "JP": ["最高裁判所", "高等裁判所", "地方裁判所", "簡易裁判所", "家庭裁判所"],
    "UK": ["Supreme Court", "Court of Appeal", "High Court", "Crown Court", "County Court"],
    "EU": ["Court of Justice", "General Court", "Board of Appeal"],
    "DE": ["Bundesverfassungsgericht", "Bundesgerichtshof", "Oberlandesgericht", "Landgericht", "Amtsgericht"],
    "FR": ["Cour de cassation", "Conseil d'État", "Conseil constitutionnel", "Cour d'appel", "Tribunal judiciaire"],
    "CH": [
        "Bundesgericht", "Tribunal fédéral", "Bundesverwaltungsgericht", "Bundesstrafgericht",
        "Kantonsgericht", "Obergericht", "Bezirksgericht",
    ],
    "AU": ["High Court", "Federal Court", "Supreme Court", "District Court", "Magistrates Court"],
    "CA": ["Supreme Court", "Federal Court of Appeal", "Court of Appeal", "Superior Court", "Federal Court"],
    "IN": ["Supreme Court", "High Court", "District Court"],
    "PL": [
        "Sąd Najwyższy", "Trybunał Konstytucyjny", "Naczelny Sąd Administracyjny",
        "Sąd Apelacyjny", "Sąd Okręgowy", "Sąd Rejonowy",
    ],
    "AT": [
        "Verfassungsgerichtshof", "Verwaltungsgerichtshof", "Oberster Gerichtshof",
        "Oberlandesgericht", "Landesgericht", "Bezirksgericht",
    ],
}
UNKNOWN_RANK = 999
