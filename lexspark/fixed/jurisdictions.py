"""Known jurisdictions."""

# Fixed values.
KNOWN_JURISDICTIONS = [
    "AF", "AR", "AS", "AT", "AU", "BD", "BR", "BW", "CA", "CH",
    "CK", "CN", "CO", "CZ", "DE", "DK", "EC", "EE", "ES", "ET",
    "EU", "FJ", "FM", "FR", "GB", "GH", "GR", "GU", "HK", "HR",
    "ICJ", "ID", "IE", "IL", "IN", "IT", "JP", "KE", "KI", "KR",
    "LK", "LS", "LT", "LV", "MG", "MH", "MP", "MU", "MW", "MX",
    "MY", "MZ", "NA", "NC", "NG", "NL", "NO", "NR", "NU", "NZ",
    "PG", "PH", "PK", "PL", "PN", "PT", "PW", "RO", "RW", "SB",
    "SC", "SE", "SG", "SL", "SZ", "TK", "TO", "TR", "TV", "TW",
    "TZ", "UG", "US", "WI", "WIPO", "WS", "ZA", "ZM", "ZW",
    "ALL", "global",
]

# Searched when no list is given.
DEFAULT_SEARCH_JURISDICTIONS = ["US", "GB", "EU", "JP", "AU"]
SIMILAR_SEARCH_JURISDICTIONS = ["US", "GB", "EU", "JP", "AU", "CA"]

# Jurisdiction of the records a landing source delivers.
SOURCE_JURISDICTION = {
    "courtlistener": "US", "hudoc": "EU", "jpcourts": "JP",
    "eurlex": "EU", "indiankanoon": "IN", "delaw": "DE",
    "africanlii": "AF", "paclii": "PC", "icj": "ICJ",
    "enforcement": "EU", "gipc_index": "US", "court_stats": "JP",
    "egov": "JP", "destatis": "DE", "epo_stats": "EU",
    "canlii": "CA", "legifrance": "FR", "ukleg": "GB",
    "nlleg": "NL", "ptleg": "PT", "ptlaw": "PT", "etlaw": "ET",
}
