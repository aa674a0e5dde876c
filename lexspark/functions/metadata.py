"""Judgment metadata: the fields a text states by itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.fixed import metadata as M
from lexspark.functions.text import U, contains_any
from lexspark.session import blank_to_null


def metadata_schema() -> T.StructType:
    """The nested judgment metadata type."""
    return T.StructType.fromDDL(M.METADATA_DDL)


def empty_metadata() -> Column:
    """A metadata struct with every field missing and every list empty."""
    return _fill(F.from_json(F.lit("{}"), metadata_schema()))


def _ascii_digits(col: Column) -> Column:
    return F.translate(col, "０１２３４５６７８９", "0123456789")


def _ymd(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))


def _part(col: Column, pattern: str, group: int) -> Column:
    return _ascii_digits(F.regexp_extract(col, U + pattern, group))


def _month(name: Column) -> Column:
    keys = F.array(*[F.lit(m) for m in M.MONTH_KEYS])
    return F.array_position(keys, F.substring(F.lower(name), 1, 3)).cast("string")


def normalize_date(col: Column) -> Column:
    """Any known date form to 'YYYY-MM-DD' text; no calendar check, NULL if none."""
    def era(pattern: str, base: int) -> Column:
        return _ymd(
            (_part(col, pattern, 1).try_cast("int") + base).cast("string"), _part(col, pattern, 2), _part(col, pattern, 3)
        )

    def found(pattern: str, value: Column) -> Column:
        return F.when(col.rlike(U + pattern), value)

    def numeric(pattern: str) -> Column:
        return found(pattern, _ymd(*[_part(col, pattern, g) for g in (1, 2, 3)]))

    first, second = M.DATE_MONTH_FIRST, M.DATE_DAY_FIRST
    return F.coalesce(
        numeric(M.DATE_ISO),
        found(first, _ymd(_part(col, first, 3), _month(_part(col, first, 1)), _part(col, first, 2))),
        found(second, _ymd(_part(col, second, 3), _month(_part(col, second, 2)), _part(col, second, 1))),
        found(M.DATE_REIWA, era(M.DATE_REIWA, M.ERA_BASE["令和"])),
        found(M.DATE_HEISEI, era(M.DATE_HEISEI, M.ERA_BASE["平成"])),
        numeric(M.DATE_KANJI),
    )


def dates_in_text(text: Column, limit: int | None = None) -> Column:
    """Distinct dates, in the order of the date formats; the first ``limit`` of them if one is given."""
    forms = [M.DATE_ISO, M.DATE_MONTH_FIRST, M.DATE_DAY_FIRST, M.DATE_REIWA, M.DATE_HEISEI, M.DATE_KANJI]
    raw = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(U + f), F.lit(0)) for f in forms]))
    dates = F.filter(F.transform(raw, normalize_date), lambda d: d.isNotNull())
    dates = F.array_distinct(dates)
    return dates if limit is None else F.slice(dates, 1, limit)


def _bound(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` worked out once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def amount(text: Column, loose: bool = False) -> Column:
    """STRUCT<amount, currency> of the first sum of money, fields NULL if none.

    ``loose`` takes any following M or B for million or billion, also where it
    begins a word ("$5 more").
    """
    symbol_pattern = U + (M.AMOUNT_SYMBOL_LOOSE if loose else M.AMOUNT_SYMBOL)
    currency = F.create_map(*[F.lit(x) for kv in M.CURRENCY.items() for x in kv])

    def number(found: Column, pattern: str, group: int) -> Column:
        return F.replace(_ascii_digits(F.regexp_extract(found, pattern, group)), F.lit(",")).try_cast("double")

    def pair(value: Column, code: Column) -> Column:
        return F.struct(value.alias("amount"), F.when(value.isNotNull(), code).alias("currency"))

    def yen(pattern: str, unit: float) -> Column:
        return _bound(
            F.regexp_extract(text, U + pattern, 0), lambda m: F.when(m != "", pair(number(m, U + pattern, 1) * unit, F.lit("JPY")))
        )

    def by_symbol(m: Column) -> Column:
        scale = F.lower(F.regexp_extract(m, symbol_pattern, 3))
        factor = F.when(scale.isin("million", "m"), 1e6).when(scale.isin("billion", "b"), 1e9).otherwise(1.0)
        code = F.try_element_at(currency, F.upper(F.regexp_extract(m, symbol_pattern, 1)))
        return pair(number(m, symbol_pattern, 2) * factor, code)

    # each pattern runs only over texts that hold its sign
    return F.coalesce(
        F.when(F.contains(text, F.lit("億")), yen(M.AMOUNT_OKU, 1e8)),
        F.when(F.contains(text, F.lit("万")), yen(M.AMOUNT_MAN, 1e4)),
        _bound(F.when(text.rlike(r"(?i)[€$¥]|USD|EUR|JPY"), F.regexp_extract(text, symbol_pattern, 0)), by_symbol),
    )


def case_number(text: Column) -> Column:
    """First case number, formats tried in order."""
    return F.coalesce(
        *[F.trim(blank_to_null(F.regexp_extract(text, U + p, 0))) for p in M.CASE_NUMBER_PATTERNS]
    )


def legal_provisions(text: Column, limit: int | None = None) -> Column:
    """Provisions, unique without regard to case; the first ``limit`` of them if one is given."""
    raw = F.flatten(
        F.array(*[F.regexp_extract_all(text, F.lit(U + p), F.lit(0)) for p in M.PROVISION_PATTERNS])
    )
    # one walk: a lambda that looked back into the matches would run the patterns again for each
    unique = F.aggregate(
        F.transform(raw, lambda x: F.trim(x)), F.array().cast("array<string>"),
        lambda acc, s: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(s)), acc).otherwise(F.concat(acc, F.array(s))),
    )
    return unique if limit is None else F.slice(unique, 1, limit)


def liability(text: Column) -> Column:
    lowered = F.lower(text)
    chain = None
    for phrase, value in M.LIABILITY_PHRASES:
        chain = (F if chain is None else chain).when(F.contains(lowered, F.lit(phrase)), value)
    return chain


def injunction(text: Column) -> Column:
    lowered = F.lower(text)
    return F.when(contains_any(lowered, M.INJUNCTION_GRANTED), "granted").when(
        contains_any(lowered, M.INJUNCTION_DENIED), "denied"
    )


def procedure_for_source(source: Column) -> Column:
    """STRUCT<type, ip_field> of a source hint.

    The hint is tried as it is, then with '-' as '_', then without 'wipo_'.
    """
    table = F.create_map(*[
        x for k, (kind, field) in M.PROCEDURE_BY_SOURCE.items()
        for x in (F.lit(k), F.struct(F.lit(kind).alias("type"), F.lit(field).alias("ip_field")))
    ])
    key = F.lower(source)
    under = F.replace(key, F.lit("-"), F.lit("_"))
    return F.coalesce(*[
        F.try_element_at(table, k) for k in (key, under, F.regexp_replace(under, "^wipo_", ""))
    ])


def partial_metadata(text: Column, source: Column, damages_in: Column | None = None) -> Column:
    """The metadata struct with every field a regex can fill.

    The sum of money is the first in ``damages_in``, by default the whole text.
    """
    dates = dates_in_text(text)
    procedure = procedure_for_source(source)
    null = F.lit(None).cast("string")
    people = F.expr("CAST(array() AS ARRAY<STRUCT<raw_name: STRING, normalized_entity_id: STRING>>)")
    return F.struct(
        F.struct(
            blank_to_null(source).alias("source"), null.alias("court_name"), null.alias("country_or_region"),
            case_number(text).alias("case_number"), F.array_max(dates).alias("decision_date"),
        ).alias("case_id"),
        F.struct(
            procedure["type"].alias("type"), procedure["ip_field"].alias("ip_field"), null.alias("technical_sector"),
        ).alias("procedure"),
        F.struct(
            people.alias("plaintiffs"), people.alias("defendants"), people.alias("third_parties"),
        ).alias("parties"),
        F.struct(
            liability(text).alias("liability"), injunction(text).alias("injunction"), amount(text if damages_in is None else damages_in).alias("damages"),
        ).alias("outcome"),
        F.struct(
            F.array_min(dates).alias("filing_date"),
            F.expr("CAST(array() AS ARRAY<STRUCT<date: STRING>>)").alias("major_decisions"),
        ).alias("procedure_timeline"),
        F.struct(
            legal_provisions(text).alias("legal_provisions"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("case_law"),
        ).alias("citations"),
        null.alias("notes"),
    )


def _fill(m: Column) -> Column:
    """Missing structs become structs of NULLs, missing lists empty lists."""
    def filled(col: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*[filled(col[f.name], f.dataType).alias(f.name) for f in kind.fields])
        if isinstance(kind, T.ArrayType):
            return F.coalesce(col, F.array().cast(kind))
        return col

    return filled(m, metadata_schema())


def normalized_metadata(raw_json: Column) -> Column:
    """Metadata from JSON text: missing keys added, dates normalised or NULL."""
    m = _fill(F.from_json(raw_json, metadata_schema()))
    timeline = m["procedure_timeline"]
    decisions = F.transform(
        timeline["major_decisions"], lambda d: F.struct(normalize_date(d["date"]).alias("date"))
    )
    return (
        m.withField("case_id.decision_date", normalize_date(m["case_id"]["decision_date"]))
        .withField("procedure_timeline.filing_date", normalize_date(timeline["filing_date"]))
        .withField("procedure_timeline.major_decisions", decisions)
    )


def with_party_entities(m: Column, resolve) -> Column:
    """Fill ``normalized_entity_id`` by ``resolve(raw_name)`` where it is missing."""
    for group in ("plaintiffs", "defendants", "third_parties"):
        people = F.transform(
            m["parties"][group],
            lambda p: p.withField(
                "normalized_entity_id", F.coalesce(p["normalized_entity_id"], resolve(p["raw_name"]))
            ),
        )
        m = m.withField(f"parties.{group}", people)
    return m


def _messages(*tests: tuple[Column, Column | str]) -> Column:
    found = F.array(*[F.when(test, F.lit(m) if isinstance(m, str) else m) for test, m in tests])
    return F.filter(found, lambda x: x.isNotNull())


def _date_issues(decided: Column, filed: Column) -> list[tuple[Column, Column]]:
    return [
        (
            d.isNotNull() & ~d.rlike(r"^\d{4}-\d{2}-\d{2}$"),
            F.concat(F.lit(f"Invalid date format for {label}: "), d),
        )
        for d, label in ((decided, "case_id.decision_date"), (filed, "procedure_timeline.filing_date"))
    ]


def metadata_issues(m: Column) -> Column:
    """Validation messages of a complete struct; empty when valid."""
    return _messages(*_date_issues(m["case_id"]["decision_date"], m["procedure_timeline"]["filing_date"]))


def json_issues(raw_json: Column) -> Column:
    """Validation messages of metadata still in JSON text, missing keys included."""
    def absent(keys: Column, names: tuple[str, ...], label: str) -> list[tuple[Column, str]]:
        known = F.coalesce(keys, F.array().cast("array<string>"))
        return [(~F.array_contains(known, n), label.format(n)) for n in names]

    top = F.json_object_keys(raw_json)
    inner = F.json_object_keys(F.get_json_object(raw_json, "$.case_id"))
    return _messages(
        *absent(
            top,
            ("case_id", "procedure", "parties", "outcome", "procedure_timeline", "citations", "notes"),
            "Missing top-level field: {}",
        ),
        *absent(
            inner, ("source", "court_name", "country_or_region", "case_number", "decision_date"), "Missing case_id.{}"
        ),
        *_date_issues(
            F.get_json_object(raw_json, "$.case_id.decision_date"),
            F.get_json_object(raw_json, "$.procedure_timeline.filing_date"),
        ),
    )


def missing_fields(m: Column) -> Column:
    """Names of the fields a reader still has to fill in."""
    def blank(c: Column) -> Column:
        return blank_to_null(c).isNull()

    return _messages(
        (blank(m["case_id"]["court_name"]), "case_id.court_name"),
        (blank(m["case_id"]["country_or_region"]), "case_id.country_or_region"),
        (blank(m["case_id"]["source"]), "case_id.source"),
        (blank(m["procedure"]["technical_sector"]), "procedure.technical_sector"),
        (F.size(m["parties"]["plaintiffs"]) < 1, "parties.plaintiffs[]"),
        (F.size(m["parties"]["defendants"]) < 1, "parties.defendants[]"),
        (blank(m["outcome"]["liability"]), "outcome.liability"),
        (blank(m["outcome"]["injunction"]), "outcome.injunction"),
        (F.size(m["citations"]["case_law"]) < 1, "citations.case_law[]"),
        (blank(m["notes"]), "notes"),
    )


def _first_match(text: Column, table: list[tuple[str, str]]) -> Column:
    chain = None
    for value, pattern in table:
        chain = (F if chain is None else chain).when(text.rlike(U + pattern), value)
    return chain


def _names(text: Column, patterns: list[str], unique: bool = True) -> Column:
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(U + p), F.lit(1)) for p in patterns]))
    found = F.transform(found, lambda x: F.trim(x)) if unique else found
    found = F.array_sort(F.array_distinct(found)) if unique else found
    return F.nullif(found, F.array().cast("array<string>"))


def judgment_facts(text: Column, jurisdiction: Column) -> Column:
    """STRUCT of judges, outcome, damages and numbers by the rules of the jurisdiction.

    Judges are sorted and unique, but for JP and DE, where they keep text order.
    """
    us = jurisdiction == "US"
    jp = jurisdiction == "JP"
    eu = jurisdiction.isin("EU", "ECHR")
    de = jurisdiction == "DE"
    judges = (
        F.when(us, _names(text, M.JUDGE_PATTERNS["US"]))
        .when(jp, _names(text, M.JUDGE_PATTERNS["JP"], unique=False))
        .when(eu, _names(text, M.JUDGE_PATTERNS["EU"]))
        .when(jurisdiction.isin("UK", "GB"), _names(text, M.JUDGE_PATTERNS["UK"]))
        .when(de, _names(text, M.JUDGE_PATTERNS["DE"], unique=False))
        .when(jurisdiction == "IN", _names(text, M.JUDGE_PATTERNS["IN"]))
        .otherwise(_names(text, M.JUDGE_PATTERNS["generic"]))
    )
    dollars = F.coalesce(*[blank_to_null(F.regexp_extract(text, U + p, 1)) for p in M.US_DAMAGES])
    yen = blank_to_null(F.regexp_extract(text, U + M.JP_DAMAGES, 1))
    sum_text = _ascii_digits(F.when(us, dollars).when(jp, yen))
    damages = F.replace(sum_text, F.lit(",")).try_cast("double")
    return F.struct(
        judges.alias("judge_names"),
        F.when(us, _first_match(text, M.US_OUTCOMES))
        .when(jp, _first_match(text, M.JP_OUTCOMES))
        .when(eu, _first_match(text, M.EU_OUTCOMES))
        .alias("outcome"),
        damages.alias("damages_amount"),
        F.when(damages.isNotNull(), F.when(us, "USD").otherwise("JPY")).alias("damages_currency"),
        F.when(eu, blank_to_null(F.regexp_extract(text, U + M.EU_APPLICATION, 1))).alias("application_number"),
        F.when(de, blank_to_null(F.regexp_extract(text, U + M.DE_FILE_NUMBER, 1))).alias("case_number"),
    )
