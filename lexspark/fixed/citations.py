"""Citation patterns by jurisdiction."""

# Fixed values. Jurisdictions and the patterns inside each one are in scan
# order: a string matched by two patterns belongs to the earlier one.
CITATION_PATTERNS = {
    "US": [
        r"\b(\d{1,4})\s+(F\.\d?d|F\.\s*Supp\.\s*\d?d|U\.S\.|S\.\s*Ct\.|L\.\s*Ed\.\s*\d?d)\s+(\d{1,4})\b",
        r"\b(\d{1,4})\s+U\.S\.\s+(\d{1,4})\s*\(\d{4}\)",
        r"([A-Z][a-z]+\s+v\.\s+[A-Z][a-z]+),?\s+(\d{1,4}\s+\w+\.?\s*\d*\w*\.?\s+\d{1,4})",
    ],
    "EU": [
        r"Application\s+no\.\s*(\d+/\d{2,4})",
        r"CELEX:\w+",
        r"Case\s+[CT]-\d{1,4}/\d{2,4}",
    ],
    "UK": [
        r"\[\d{4}\]\s+[A-Z]{2,6}\s+\d{1,4}",
        r"\[\d{4}\]\s+\d?\s*[A-Z]{1,4}\s+\d{1,4}",
    ],
    "JP": [
        r"(最[大小]?判|[東大名広福仙札高].*?[地高]判|知財高判)(平成|令和|昭和)\d{1,2}年\d{1,2}月\d{1,2}日",
        r"(民集|刑集|判時|判タ|金判|労判)\d{1,3}巻\d{1,3}号\d{1,5}頁",
    ],
    "DE": [
        r"(BVerfG|BGH|BVerwG|BAG|BSG|BFH),?\s*\d+\s+\w+\s+\d+/\d{2,4}",
        r"\b\d{1,2}\s+Ni\s+\d{1,4}/\d{2,4}\b",
        r"\b[IVX]{1,4}\s+[A-Z][A-Za-z]{1,3}\s+\d{1,4}/\d{2,4}\b",
    ],
    "IN": [
        r"AIR\s+\d{4}\s+[A-Z]{2,4}\s+\d{1,4}",
        r"\(\d{4}\)\s+\d{1,2}\s+SCC\s+\d{1,4}",
    ],
    "AU": [
        r"\[\d{4}\]\s+[A-Z]{2,6}\s+\d{1,4}",
        r"\(\d{4}\)\s+\d{1,4}\s+CLR\s+\d{1,4}",
    ],
    "FR": [
        r"Cass\.\s*(?:civ\.\s*\d(?:re|e)?|com\.|crim\.|soc\.|ass\.\s*plén\.)\s*,\s*\d{1,2}\s+[A-Za-zÀ-ÿ]+\.?\s+\d{4},\s*n(?:°|o)\s*\d{2}[-‑]\d{2}[.\s]\s*\d{3}",
        r"pourvois?\s+n(?:°|o)\s*[A-Z]?\s*\d{2}[-‑]\d{2}[.\s]\s*\d{3}",
        r"Bull\.\s*(?:civ\.\s*[IV]{1,3}|crim\.)\s*,?\s*n(?:°|o)\s*\d{1,4}",
        r"CE,\s*(?:(?:ass|sect|réf)\.,\s*)?\d{1,2}\s+[A-Za-zÀ-ÿ]+\.?\s+\d{4},\s*n(?:°|o)\s*\d{4,6}",
        r"CC,\s*décision\s*n(?:°|o)\s*\d{4}[-‑]\d{1,4}\s+QPC",
        r"Cons\.\s*const\.,\s*\d{1,2}\s+[A-Za-zÀ-ÿ]+\.?\s+\d{4},\s*n(?:°|o)\s*\d{4}[-‑]\d{1,4}\s+QPC",
        r"articles?\s+(?:L\.?\s*)?[\d]+(?:[-‑]\d+)*\s+du\s+[Cc]ode\s+(?:civil|pénal|de\s+procédure\s+(?:civile|pénale)|de\s+commerce|de\s+la\s+propriété\s+intellectuelle|du\s+travail|de\s+la\s+consommation)",
        r"JO\s+du\s+\d{1,2}\s+[A-Za-zÀ-ÿ]+\s+\d{4}|JORF\s+n(?:°|o)\s*\d{3,5}",
        r"Lebon\s+p\.\s*\d{1,4}",
        r"(?:D\.\s*\d{4}|JCP\s+\d{4}|RTD\s+(?:civ|com)\.\s*\d{4})\s*[.,]\s*(?:p\.\s*)?\d{1,5}",
    ],
    "CA": [
        r"\[\d{4}\]\s+\d+\s+SCR\s+\d{1,4}",
        r"\b\d{4}\s+SCC\s+\d{1,4}\b",
        r"\b\d{4}\s+FCA?\s+\d{1,4}\b",
        r"\b\d{4}\s+(?:ONCA|ONSC|BCSC|BCCA|QCCA|QCCS|ABCA|ABKB|ABQB|MBCA|MBQB|SKCA|SKQB|NSCA|NSSC|NBCA|NBQB|NLCA|PECA|TCC|CMAC|CanLII)\s+\d{1,4}\b",
        r"\(\d{4}\)\s+\d+\s+DLR\s+\(\d+(?:st|nd|rd|th)\)\s+\d{1,4}",
    ],
    "NZ": [
        r"\[\d{4}\]\s+NZSC\s+\d{1,4}",
        r"\[\d{4}\]\s+NZHC\s+\d{1,4}",
        r"\[\d{4}\]\s+NZCA\s+\d{1,4}",
        r"\[\d{4}\]\s+\d+\s+NZLR\s+\d{1,4}",
    ],
    "KR": [
        r"대법원\s+\d{4}\.\s*\d{1,2}\.\s*\d{1,2}\.\s*선고\s+\d{4}[가-힣]+\d+\s+판결",
        r"헌법재판소\s+\d{4}\.\s*\d{1,2}\.\s*\d{1,2}\.\s*\d{4}헌[가-힣]+\d+\s+결정",
        r"\b\d{4}다\d+\b",
        r"\b\d{4}헌[가-힣]+\d+\b",
    ],
    "BR": [
        r"STF,\s*RE\s+\d{3,7}",
        r"\bRE\s+\d{1,3}(?:\.\d{3})+(?:/[A-Z]{2})?\b",
        r"STJ,\s*REsp\s+\d{1,7}(?:/[A-Z]{2})?",
        r"\bREsp\s+\d{1,3}(?:\.\d{3})+(?:/[A-Z]{2})?\b",
        r"\bTJ[A-Z]{2},\s*Ap\.\s*\d{7}-\d{2}\.\d{4}\.\d\.\d{2}\.\d{4}\b",
    ],
    "CH": [
        r"\bBGer\s+\d[A-Z]_\d{1,4}/\d{4}\b",
        r"\bBGE\s+\d{2,3}\s+[IVX]+\s+\d{1,4}\b",
        r"\bATF\s+\d{2,3}\s+[IVX]+\s+\d{1,4}\b",
        r"\bDTF\s+\d{2,3}\s+[IVX]+\s+\d{1,4}\b",
        r"\b(?:Urteil|Arrêt)\s+\d[A-Z]_\d{1,4}/\d{4}\b",
    ],
    "PL": [
        r"\b[IV]{1,4}\s+(?:CZP|CSK|CKN|CNP|KZP|KK|SK)\s+\d{1,4}/\d{2,4}\b",
        r"\b[IV]{1,4}\s+(?:K|Ka|AKa|Ca|C|W|Ws|S|U|P|Kp)\s+\d{1,4}/\d{2,4}\b",
        r"\b[KPS]\s+\d{1,4}/\d{2,4}\b",
        r"\b[IV]{1,4}\s+(?:OSK|GSK|FSK|SA)\s+\d{1,4}/\d{2,4}\b",
        r"Dz\.U\.\s+(?:z\s+)?\d{4}\s+(?:r\.\s+)?poz\.\s+\d{1,5}",
        r"\b(?:OSNC|OSP|OSNKW|OSNP)\s+\d{4}/\d{1,2}/\d{1,4}\b",
        r"(?i)sygn\.\s*akt\s+[IV]{1,4}\s+\w{1,4}\s+\d{1,4}/\d{2,4}",
    ],
    "AT": [
        r"\bVwGH\s+\d{4}/\d{2}/\d{4}\b",
        r"\bVfGH\s+[A-Z]\s+\d{1,4}/\d{4}\b",
        r"\bBVwG\s+[A-Z]\d{3}\s+\d{5,7}[-/]\d\b",
        r"\bOGH\s+\d{1,2}\s+Ob\s+\d{1,4}/\d{2}[a-z]?\b",
        r"BGBl\.\s*(?:I{1,3}|Nr\.)\s*(?:Nr\.\s*)?\d{1,4}/\d{4}",
        r"\bGz\.?\s+\d{4}/\d{2}/\d{4}\b",
    ],
    "HK": [
        r"\[\d{4}\]\s+(?:HKCA|HKCFA|HKCFI|HKDC|HKFC|HKLC|HKCT)\s+\d{1,4}",
        r"\(\d{4}\)\s+\d{1,2}\s+HKLRD\s+\d{1,4}",
    ],
    "SG": [
        r"\[\d{4}\]\s+(?:SGCA|SGHC|SGDC|SGMC|SGHCF|SGAB)\s+\d{1,4}",
        r"\[\d{4}\]\s+\d\s+SLR(?:\(R\))?\s+\d{1,4}",
    ],
}
