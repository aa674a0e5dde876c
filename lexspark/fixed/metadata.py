"""Patterns and keyword lists of judgment metadata."""

MONTHS = (
    "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|"
    "Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
)

# Date formats in the order they are tried.
DATE_ISO = r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
DATE_MONTH_FIRST = rf"(?i)({MONTHS})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})"
DATE_DAY_FIRST = rf"(?i)(\d{{1,2}})\s+({MONTHS})\.?\s+(\d{{4}})"
DATE_REIWA = r"令和(\d+)年(\d{1,2})月(\d{1,2})日"
DATE_HEISEI = r"平成(\d+)年(\d{1,2})月(\d{1,2})日"
DATE_KANJI = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
MONTH_KEYS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ERA_BASE = {"令和": 2018, "平成": 1988, "昭和": 1925}

# Amounts.
AMOUNT_OKU = r"([\d,]+(?:\.\d+)?)\s*億\s*円"
AMOUNT_MAN = r"([\d,]+(?:\.\d+)?)\s*万\s*円"
AMOUNT_SYMBOL = r"(?i)(€|\$|USD|EUR|JPY|¥)\s*([\d,]+(?:\.\d+)?)(?:\s*(million|billion|M|B)\b)?"
AMOUNT_SYMBOL_LOOSE = r"(?i)(€|\$|USD|EUR|JPY|¥)\s*([\d,]+(?:\.\d+)?)\s*(million|billion|M|B)?"
CURRENCY = {"$": "USD", "USD": "USD", "€": "EUR", "EUR": "EUR", "¥": "JPY", "JPY": "JPY"}

# Case number formats in the order they are tried.
CASE_NUMBER_PATTERNS = [
    r"(?i)IPR\d{4}-\d{5}",
    r"(?i)PGR\d{4}-\d{5}",
    r"(?i)ITC[-\s]?No\.?\s*\d{3}-\d+",
    r"(?i)(?:Case\s+)?D\d{4}-\d{4,5}",
    r"(?i)T\s+\d{4}/\d{2}",
    r"(?i)App\.\s+No\.\s+[\d/]+",
    r"\d+\s+U\.S\.C\b",
    r"(?:令和|平成)\d+年(?:\([ワアネ]\)|（[ワアネ]）)第?\d+号",
    r"平成\d+年\(行ケ\)\d+号",
    r"\d{4}[A-Z]{1,3}\d{4,6}",
    r"(?i)No\.\s*\d+[-\s]\w+[-\s]\d{4}",
]

# Legal provisions in the order they are listed.
PROVISION_PATTERNS = [
    r"(?i)(?:§|section|art\.?|article)\s*\d+[\w()\.\-]*",
    r"(?i)\d+\s+U\.S\.C\.?\s+§?\s*\d+\w*",
    r"(?i)DMCA\s+§?\s*\d+\w*",
    r"(?i)17\s+U\.S\.C\.?\s+§?\s*5\d{2}",
    r"(?i)TRIPS\s+Art(?:icle)?\.?\s*\d+",
    r"(?i)DSU\s+Art(?:icle)?\.?\s*\d+",
    r"(?i)著作権法\s*第?\s*\d+\s*条",
    r"(?i)特許法\s*第?\s*\d+\s*条",
]
PROVISION_LIMIT = 10

# Outcome phrases in the order they are tried.
LIABILITY_PHRASES = [
    ("plaintiff prevail", "plaintiff_win"),
    ("granted in favor of plaintiff", "plaintiff_win"),
    ("defendant prevail", "defendant_win"),
    ("dismissed", "dismissed"),
    ("settled", "settlement"),
    ("partial", "partial"),
    ("原告勝訴", "plaintiff_win"),
    ("被告勝訴", "defendant_win"),
]
INJUNCTION_GRANTED = ["preliminary injunction granted", "injunction granted", "仮処分命令"]
INJUNCTION_DENIED = ["injunction denied", "injunction not granted"]

# Procedure type and field by source.
PROCEDURE_BY_SOURCE = {
    "ptab": ("administrative", "patent"),
    "itc337": ("administrative", "patent"),
    "epo_opposition": ("opposition", "patent"),
    "upc": ("litigation", "patent"),
    "wipo_adr": ("UDRP", "domain"),
    "udrp": ("UDRP", "domain"),
    "jp-court": ("litigation", "patent"),
    "cn-court": ("litigation", "patent"),
    "icc": ("criminal", "other"),
    "icsid": ("arbitration", "other"),
    "wto": ("arbitration", "other"),
    "courtlistener": ("litigation", "patent"),
}

METADATA_DDL = (
    "case_id STRUCT<source: STRING, court_name: STRING, country_or_region: STRING, "
    "case_number: STRING, decision_date: STRING>, "
    "procedure STRUCT<type: STRING, ip_field: STRING, technical_sector: STRING>, "
    "parties STRUCT<plaintiffs: ARRAY<STRUCT<raw_name: STRING, normalized_entity_id: STRING>>, "
    "defendants: ARRAY<STRUCT<raw_name: STRING, normalized_entity_id: STRING>>, "
    "third_parties: ARRAY<STRUCT<raw_name: STRING, normalized_entity_id: STRING>>>, "
    "outcome STRUCT<liability: STRING, injunction: STRING, "
    "damages: STRUCT<amount: DOUBLE, currency: STRING>>, "
    "procedure_timeline STRUCT<filing_date: STRING, major_decisions: ARRAY<STRUCT<date: STRING>>>, "
    "citations STRUCT<legal_provisions: ARRAY<STRING>, case_law: ARRAY<STRING>>, "
    "notes STRING"
)

# Judge names per jurisdiction (group 1 is the name).
JUDGE_PATTERNS = {
    "US": [
        r"(?:Chief )?Justice\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
        r"(?:Circuit |District )?Judge\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)",
        r"(?:Before|Per)\s+(?:Chief )?(?:Justice|Judge)\s+([A-Z][a-z]+)",
        r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*),\s+(?:Circuit |District )?(?:Judge|J\.)",
    ],
    "JP": [r"裁判長裁判官\s*(\S+)", r"裁判官\s*(\S+)"],
    "EU": [r"(?:Judge|President)\s+([A-Z][a-zà-ÿ]+(?:\s+[A-Z][a-zà-ÿ]+)*)"],
    "UK": [
        r"(?:Lord|Lady)\s+Justice\s+([A-Z][a-z]+)",
        r"(?:Mr|Mrs)\s+Justice\s+([A-Z][a-z]+)",
        r"(?:Lord|Baroness)\s+([A-Z][a-z]+)",
    ],
    "DE": [r"(?:Richter(?:in)?|Vorsitzende[r]?)\s+(?:am\s+\w+\s+)?(\S+)"],
    "IN": [
        r"Hon'?ble\s+(?:Mr\.?\s+)?Justice\s+([A-Z][a-z]+(?:\s+[A-Z]\.?\s*[a-z]+)*)",
        r"([A-Z][a-z]+(?:\.\s*[A-Z]\.?\s*)?[A-Za-z]+),?\s*J\.",
    ],
    "generic": [r"(?:Judge|Justice)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"],
}

# Damages and outcomes in the order they are tried.
US_DAMAGES = [
    r"(?i)\$\s*([\d,]+(?:\.\d{2})?)\s*(?:in damages|damages)",
    r"(?i)(?:awarded|judgment of|verdict of)\s*\$\s*([\d,]+(?:\.\d{2})?)",
    r"(?i)damages\s+(?:of|in the amount of)\s+\$\s*([\d,]+(?:\.\d{2})?)",
]
US_OUTCOMES = [
    ("granted", r"(?i)(?:motion|summary judgment|petition).*?\bis\s+granted\b"),
    ("granted", r"(?i)\bgranted\b.*?(?:motion|summary judgment|petition)"),
    ("denied", r"(?i)(?:motion|summary judgment|petition).*?\bis\s+denied\b"),
    ("denied", r"(?i)\bdenied\b.*?(?:motion|summary judgment|petition)"),
    ("affirmed", r"(?i)\b(?:affirmed|we affirm|is affirmed)\b"),
    ("reversed", r"(?i)\b(?:reversed|we reverse|is reversed)\b"),
    ("remanded", r"(?i)\b(?:remanded|we remand|is remanded)\b"),
    ("dismissed", r"(?i)\b(?:case|action|complaint|appeal)\s+(?:is\s+)?(?:dismissed|hereby dismissed)\b"),
]
JP_OUTCOMES = [
    ("棄却", r"(?s)主文.*?棄却"),
    ("認容", r"(?s)主文.*?認容"),
    ("却下", r"(?s)主文.*?却下"),
    ("破棄差戻", r"(?s)破棄.*?差戻"),
    ("上告棄却", r"(?s)上告.*?棄却"),
]
JP_DAMAGES = r"金(\d[\d,]*)円"
EU_OUTCOMES = [("violation", r"[Vv]iolation of Article"), ("no_violation", r"[Nn]o violation")]
EU_APPLICATION = r"Application\s+no\.\s*(\d+/\d{2,4})"
DE_FILE_NUMBER = r"(\d+\s+\w+\s+\d+/\d{2,4})"

# Court names and outcome words of Japanese judgments.
JP_COURT = (
    r"(最高裁判所(?:第一|第二|第三)?[小大]?法廷?|知的財産高等裁判所|\S*高等裁判所|"
    r"\S*地方裁判所|\S*家庭裁判所|\S*簡易裁判所)"
)
JP_RESULT_WORDS = [
    "棄却", "破棄", "破棄差戻し", "破棄差戻", "却下", "認容", "一部認容", "有罪", "無罪", "和解", "判決", "決定",
]
JP_TEXT_HEADINGS = ["主文", "理由", "判示事項", "裁判要旨"]
