"""Link profiles: which anchors of a legal site's page are results."""

ANCHOR = r'(?is)<a[^>]+href="({href})"[^>]*>(.*?)</a>'
YEAR_IN_PATH = r"/(\d{4})/"
YEAR_ANYWHERE = r"(\d{4})"
YEAR_WORD = r"\b((?:19|20)\d{2})\b"
COURT_AFTER_CASES = r"/cases/([^/]+)/"
COURT_AFTER_JUDGMENT = r"/judgment/([^/]+)/"
COURT_LOWER_AFTER_JUDGMENT = r"/judgment/([a-z]+)/"

# Fixed values, one row per profile and tier: profile, host, tier, kind, jurisdiction,
# source, shortest title, href pattern. A tier is read only where the tier before it
# found nothing on the page.
LINK_PROFILES = [
    ("africanlii", "africanlii.org", 1, "case", "AF", "africanlii", 5, r'/en/akn/[^"]+/judgment/[^"]+'),
    ("africanlii", "africanlii.org", 2, "case", "AF", "africanlii", 5, r'/en/akn/[^"]+/act/[^"]+'),
    ("arleg", "www.infoleg.gob.ar", 1, "statute", "AR", "infoleg_ar", 5, r'[^"]*(?:infolegInternet|norma|ley|decreto|resolucion|page_id)[^"]*'),
    ("atleg", "www.ris.bka.gv.at", 1, "statute", "AT", "ris_bka", 5, r'/eli/[^"]+'),
    ("auleg", "www.legislation.gov.au", 1, "statute", "AU", "auleg_search", 5, r'/[A-Z]\d[^"]*'),
    ("bdlaw", "www.commonlii.org", 1, "case", "BD", "commonlii", 3, r'/bd/(?:legis|cases|other)/[^"]+'),
    ("brleg", "www.lexml.gov.br", 1, "statute", "BR", "lexml", 5, r'/(?:busca|desc_acervo|urn)[^"]*'),
    ("brleg", "www.lexml.gov.br", 2, "statute", "BR", "lexml", 5, r'(?:https?://[^"]*lexml[^"]*|/[^"]+)'),
    ("caleg", "laws-lois.justice.gc.ca", 1, "statute", "CA", "caleg_index", 3, r'/eng/(?:acts|regulations|Const|AnnualStatutes)/[^"]+'),
    ("coleg", "www.suin-juriscol.gov.co", 1, "statute", "CO", "suin_juriscol", 5, r'[^"]*(?:legislacion|norma|agraria|jurisdiccion)[^"]*'),
    ("court_stats", "www.courts.go.jp", 1, "dispute", "JP", "court_stats", 1, r'[^"]+'),
    ("czleg", "www.zakonyprolidi.cz", 1, "statute", "CZ", "zakonyprolidi", 5, r'/cs/[^"]+'),
    ("delaw", "dejure.org", 1, "case", "DE", "dejure_org", 5, r'/dienste/vernetzung/rechtsprechung\?[^"]+'),
    ("eeleg", "www.riigiteataja.ee", 1, "statute", "EE", "riigiteataja", 5, r'https?://www\.riigiteataja\.ee/en/eli/[^"]+'),
    ("eeleg", "www.riigiteataja.ee", 2, "statute", "EE", "riigiteataja", 5, r'/en/eli/[^"]+'),
    ("eeleg", "www.riigiteataja.ee", 3, "statute", "EE", "riigiteataja", 5, r'/en/[^"]+'),
    ("enforcement", "taxation-customs.ec.europa.eu", 1, "dispute", "EU", "enforcement", 5, r'[^"]+'),
    ("esleg", "www.boe.es", 1, "statute", "ES", "boe", 5, r'[^"]*(?:codigo|abrir_pdf|act\.php|buscar/doc)[^"]*'),
    ("esleg", "www.boe.es", 2, "statute", "ES", "boe", 5, r'/(?:diario_boe|buscar|eli|biblioteca_juridica)/[^"]+'),
    ("etlaw", "ethiopianlaw.com", 1, "statute", "ET", "ethiopianlaw", 10, r'https://ethiopianlaw\.com[^"]*'),
    ("ghlaw", "ghalii.org", 1, "case", "GH", "ghalii", 5, r'/akn/gh/judgment/[^"]+'),
    ("gipc_index", "www.uschamber.com", 1, "dispute", "US", "gipc_index", 1, r'https?://www\.uschamber\.com/intellectual-property/\d{4}-ip-index'),
    ("hrleg", "www.zakon.hr", 1, "statute", "HR", "zakon_hr", 5, r'(?:https?://www\.zakon\.hr)?/z/\d+/[^"]+'),
    ("icj", "www.icj-cij.org", 1, "case", "ICJ", "icj_html", 10, r'case/\d+'),
    ("itc337", "edis.usitc.gov", 1, "dispute", "US", "itc337", 1, r'[^"]+'),
    ("itleg", "www.normattiva.it", 1, "statute", "IT", "normattiva", 3, r'/(?:atto|uri-res|ricerca|staticPage|legislazioneRegionale)[^"]*'),
    ("jpcourts", "www.courts.go.jp", 1, "case", "JP", "courts_go_jp", 1, r'[^"]*(?:detail2|detail3|detail\?id=|/hanrei/)[^"]*'),
    ("kelaw", "new.kenyalaw.org", 1, "case", "KE", "kenyalaw", 5, r'/judgments/[^"]+'),
    ("krleg", "www.law.go.kr", 1, "statute", "KR", "krleg", 1, r'[^"]*(?:lsInfoP\.do|법령)[^"]*'),
    ("lklaw", "www.commonlii.org", 1, "case", "LK", "commonlii", 3, r'/lk/(?:legis|cases|other)/[^"]+'),
    ("lslaw", "lesotholii.org", 1, "case", "LS", "lesotholii", 5, r'/akn/ls/judgment/[^"]+'),
    ("ltleg", "www.e-tar.lt", 1, "statute", "LT", "etar", 5, r'[^"]*legalAct[^"]*'),
    ("ltleg", "www.e-tar.lt", 2, "statute", "LT", "etar", 5, r'/portal/[^"]+'),
    ("lvleg", "likumi.lv", 1, "statute", "LV", "likumi_lv", 3, r'/ta/(?:id|veids|tema|saraksts|jaunakie)/[^"]+'),
    ("mwlaw", "malawilii.org", 1, "case", "MW", "malawilii", 5, r'/akn/mw/judgment/[^"]+'),
    ("mylaw", "www.commonlii.org", 1, "case", "MY", "commonlii", 3, r'/my/(?:legis|cases|journals|other)/[^"]+'),
    ("nalaw", "namiblii.org", 1, "case", "NA", "namiblii", 5, r'/akn/na/judgment/[^"]+'),
    ("nglaw", "nigerialii.org", 1, "case", "NG", "nigerialii", 5, r'/akn/ng/judgment/[^"]+'),
    ("noleg", "lovdata.no", 1, "statute", "NO", "lovdata", 3, r'/(?:register|dokument|lov|forskrift|eli)/[^"]+'),
    ("nzleg", "www.legislation.govt.nz", 1, "statute", "NZ", "nzleg", 5, r'/act/(?:public|imperial|local)/[^"]+'),
    ("paclii", "www.paclii.org", 1, "case", "PC", "paclii", 3, r'countries/[a-z]{2}\.html'),
    ("paclii", "www.paclii.org", 2, "case", "PC", "paclii", 3, r'/[a-z]{2}/cases/[^"]+'),
    ("phleg", "lawphil.net", 1, "case", "PH", "lawphil", 3, r'https?://lawphil\.net/(?:statutes|judjuris|executive|judicial)[^"]*'),
    ("pklaw", "www.commonlii.org", 1, "case", "PK", "commonlii", 3, r'/pk/(?:legis|cases|other)/[^"]+'),
    ("plleg", "isap.sejm.gov.pl", 1, "statute", "PL", "isap_pl", 5, r'/isap.nsf/[^"]+'),
    ("ptlaw", "www.dgsi.pt", 1, "case", "PT", "dgsi_pt", 3, r'/[^"]+\?OpenDocument'),
    ("ptleg", "www.dgsi.pt", 1, "case", "PT", "dgsi_pt", 3, r'/jstj\.nsf/[^"]+\?Open[^"]*'),
    ("roleg", "legislatie.just.ro", 1, "statute", "RO", "legislatie_ro", 5, r'/Public/[^"]+'),
    ("rwlaw", "rwandalii.org", 1, "case", "RW", "rwandalii", 5, r'/akn/rw/(?:act|judgment)/[^"]+'),
    ("sclaw", "seylii.org", 1, "case", "SC", "seylii", 5, r'/(?:en/)?akn/sc/(?:judgment|act)/[^"]+'),
    ("sllaw", "www.sierralii.org", 1, "case", "SL", "sierralii", 5, r'/akn/sl/judgment/[^"]+'),
    ("trleg", "www.mevzuat.gov.tr", 1, "statute", "TR", "mevzuat", 3, r'[^"]*(?:MevzuatMetin|mevzuat\?|Publications)[^"]*'),
    ("tzlaw", "tanzlii.org", 1, "case", "TZ", "tanzlii", 5, r'/en/akn/tz/judgment/[^"]+'),
    ("tzlaw", "tanzlii.org", 2, "case", "TZ", "tanzlii", 5, r'/en/akn/tz/act/[^"]+'),
    ("uglaw", "ulii.org", 1, "case", "UG", "ulii", 5, r'/en/akn/ug/judgment/[^"]+'),
    ("uglaw", "ulii.org", 2, "case", "UG", "ulii", 5, r'/en/akn/ug/act/[^"]+'),
    ("ukleg", "www.legislation.gov.uk", 1, "statute", "GB", "legislation_gov_uk", 5, r'/ukpga/\d+/\d+/contents'),
    ("uscode", "uscode.house.gov", 1, "statute", "US", "uscode", 1, r'[^"]*(?:/view\.xhtml|/uscode/text/)[^"]*'),
    ("wipo_adr", "www.wipo.int", 1, "dispute", "GLOBAL", "wipo_adr", 1, r'[^"]+'),
    ("wipo_lex", "www.wipo.int", 1, "statute", "GLOBAL", "wipo_lex", 1, r'[^"]*(?:/wipolex/en/text/|/wipolex/en/legislation/details/)[^"]*'),
    ("wipolex", "www.wipo.int", 1, "case", "WIPO", "wipolex", 1, r'[^"]+'),
    ("wipolex", "www.wipo.int", 2, "case", "WIPO", "wipolex", 1, r'[^"]+'),
    ("zalaw", "www.saflii.org", 1, "case", "ZA", "saflii", 5, r'/za/cases/[^"]+\.html'),
    ("zmlaw", "zambialii.org", 1, "case", "ZM", "zambialii", 5, r'/akn/zm/judgment/[^"]+'),
    ("zwlaw", "zimlii.org", 1, "case", "ZW", "zimlii", 5, r'/(?:en/)?akn/zw/(?:judgment|act)/[^"]+'),
]

# Profiles whose result is not a plain anchor: (regex, href group, title group).
SPECIAL_ANCHORS = {
    ("atleg", 1): (r'(?is)<a[^>]+href="(/eli/[^"]+)"[^>]*title="([^"]*)"', 1, 2),
    ("etlaw", 1): (r'(?is)<h\d[^>]*>\s*<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>', 1, 2),
    ("gipc_index", 1): (r'(?i)href="(https?://www\.uschamber\.com/intellectual-property/(\d{4})-ip-index)"', 1, 2),
    ("phleg", 1): (
        r'(?i)<area[^>]+title="([^"]*)"[^>]+href="(https?://lawphil\.net/(?:statutes|judjuris|executive|judicial)[^"]*)"',
        2, 1,
    ),
    ("wipolex", 1): (
        r'(?is)<a(?=[^>]+class="[^"]*(?:result|resultTitle|title)[^"]*")[^>]+href="([^"]+)"[^>]*>(.*?)</a>', 1, 2,
    ),
    ("wipolex", 2): (r'(?is)<h[23][^>]*>.*?<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>.*?</h[23]>', 1, 2),
}

# Where the year of a result stands: (text it is read from, pattern).
YEAR_RULES = {
    "africanlii": ("href", r"/akn/[a-z]{2}(?:-[a-z]{2})?/judgment/[^/]+/(\d{4})/"),
    "court_stats": ("context", YEAR_WORD),
    "delaw": ("title", r"^[A-Za-z]+,?\s+\d{2}\.\d{2}\.(\d{4})\s*-"),
    "enforcement": ("context", YEAR_WORD),
    "etlaw": ("title", r"(?i)(?:Proclamation\s+No\.?\s*\d+/(?=\d{4})|\b(?=(?:19|20)\d{2}\b))(\d{4})"),
    "ghlaw": ("href", YEAR_ANYWHERE),
    "gipc_index": ("href", r"/(\d{4})-ip-index"),
    "icj": ("after", YEAR_WORD),
    "itc337": ("context", YEAR_WORD),
    "kelaw": ("context", YEAR_WORD),
    "lslaw": ("href", YEAR_ANYWHERE),
    "mwlaw": ("href", YEAR_ANYWHERE),
    "nalaw": ("href", YEAR_ANYWHERE),
    "nglaw": ("href", YEAR_ANYWHERE),
    "rwlaw": ("href", YEAR_IN_PATH),
    "sclaw": ("href", YEAR_IN_PATH),
    "sllaw": ("href", YEAR_ANYWHERE),
    "tzlaw": ("href", YEAR_IN_PATH),
    "uglaw": ("href", YEAR_IN_PATH),
    "wipo_adr": ("context", YEAR_WORD),
    "wipolex": ("after", YEAR_WORD),
    "zalaw": ("href", YEAR_IN_PATH),
    "zmlaw": ("href", YEAR_ANYWHERE),
    "zwlaw": ("href", YEAR_IN_PATH),
}
CONTEXT_WIDTH = {"court_stats": 200, "enforcement": 300, "icj": 300, "itc337": 300, "kelaw": 200, "wipo_adr": 300, "wipolex": 500}

# Court in the path (pattern, upper-cased or not), or the same for all results.
COURT_RULES = {
    "africanlii": (r"/akn/[a-z]{2}(?:-[a-z]{2})?/judgment/([^/]+)/\d{4}/", False),
    "ghlaw": (COURT_LOWER_AFTER_JUDGMENT, True),
    "mwlaw": (COURT_LOWER_AFTER_JUDGMENT, True),
    "nglaw": (COURT_LOWER_AFTER_JUDGMENT, True),
    "zmlaw": (COURT_LOWER_AFTER_JUDGMENT, True),
    "tzlaw": (COURT_AFTER_JUDGMENT, False),
    "uglaw": (COURT_AFTER_JUDGMENT, False),
    "zalaw": (COURT_AFTER_CASES, False),
    "zwlaw": (COURT_AFTER_JUDGMENT, False),
}
COURT_NAMES = {
    "icj": "International Court of Justice", "itc337": "ITC", "ptleg": "Supremo Tribunal de Justiça",
    "wipo_adr": "WIPO AMC", "wipolex": "WIPO Lex",
}
# Jurisdiction in the path ('-' becomes '_').
JURISDICTION_RULES = {
    "africanlii": r"/akn/([a-z]{2}(?:-[a-z]{2})?)/judgment/[^/]+/\d{4}/",
    "paclii": r"^(?:countries/|/)([a-z]{2})(?:\.html|/cases/)",
}

# Links dropped by a part of the href or by the title.
SKIP_HREF = {
    ("eeleg", 3): ["faq", "feedback", "register", "password", "statistics", "search", "embed"],
    ("etlaw", 1): ["/practice-areas/", "/our-firm/", "/contact-us/", "/insight/", "/news/", "/page/"],
}
SKIP_TITLE = {
    ("brleg", 1): r"Página|Pesquisa|Cesta",
    ("caleg", 1): r"^PDF",
    ("ptleg", 1): r"(?i)^(?:anterior|seguinte|expand|collapse)$",
    ("ukleg", 1): r"^\d{4}\s+c\.\s+\d+$",
}
# A link needs one of these tests to hold.
KEEP_LINK = {
    "court_stats": ("title", r"統計|知的財産|工業所有権|商標|特許", "href", r"\.(?:pdf|xls|xlsx|html)$"),
    "itc337": ("title", r"337|(?i:investigation)", "href", r"337"),
    "wipo_adr": ("title", r"(?i)case no\.", "href", r"/amc/en/domains/decisions/text/"),
}
UNIQUE_HREF = ["enforcement", "gipc_index", "itc337", "krleg", "uscode", "wipo_adr", "wipo_lex"]

# Enforcement links are kept by words of their title.
LANGUAGE_SELECTOR = r"(?i)counterfeit-piracy-other-ipr-violations_[a-z]{2}$"
STRONG_WORDS = [
    "counterfeit", "piracy", "intellectual property", "ipr", "enforcement", "seizure", "trips",
    "defend your rights", "facts and figures", "implementing regulation",
]
WEAK_WORDS = ["regulation", "report", "annual", "statistics"]
WEAK_MIN_CHARS = 20
