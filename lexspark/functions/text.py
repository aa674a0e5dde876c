"""Text, HTML and date helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.fixed import metadata as M
from lexspark.session import blank_to_null

# Unicode classes, and "." stopping at \n only
U = "(?Ud)"


def contains_any(col: Column, words: list[str]) -> Column:
    """True where ``col`` contains one of ``words``.

    Each word is looked for alone, also in a long list: a regex of alternatives tries all of them at every character.
    """
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def first_contained(col: Column, words: list[str]) -> Column:
    """The first of ``words`` (in list order) contained in ``col``, else NULL."""
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(col, w)), F.lit(0))


def collapse_spaces(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, U + r"\s+", " "))


def normalize_citation(col: Column) -> Column:
    """Trim, collapse spaces, close up periods, lower-case."""
    return F.lower(F.regexp_replace(collapse_spaces(col), r"\.\s+", "."))


def has_versus(col: Column) -> Column:
    return F.contains(col, F.lit(" v. ")) | F.contains(col, F.lit(" v "))


def citation_name_part(col: Column) -> Column:
    """The party names of a citation: everything before the first ', <digit>'."""
    return collapse_spaces(F.get(F.split(col, U + r",\s*\d", 2), F.lit(0)))


def keyword_tokens(col: Column) -> Column:
    """Split at whitespace, ideographic spaces and commas."""
    return F.filter(F.split(F.trim(col), U + r"[\s　,、]+"), lambda t: t != "")


def selected_keywords(col: Column, limit: int = 8) -> Column:
    """Query text from a description: its first words longer than two letters."""
    words = F.slice(
        F.filter(F.split(F.trim(col), U + r"\s+"), lambda w: F.length(w) > 2), 1, limit
    )
    return F.when(F.size(words) > 0, F.array_join(words, " ")).otherwise(F.substring(col, 1, 100))


def search_terms(col: Column, bigrams: bool = False) -> Column:
    """Lower-cased letter and digit runs, in order.

    With ``bigrams`` a run of CJK letters is cut into overlapping pairs.
    """
    runs = F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    if not bigrams:
        return runs
    cjk = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,}$"
    return F.flatten(
        F.transform(
            runs,
            lambda t: F.when(
                t.rlike(cjk),
                F.transform(
                    F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))),
                    lambda i: F.substr(t, i, F.lit(2)),
                ),
            ).otherwise(F.array(t)),
        )
    )


# ---- HTML -----------------------------------------------------------------

_BASIC_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
]


def basic_entities(col: Column) -> Column:
    """The common entities, JVM-side; '&amp;' last so that nothing is unescaped twice."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _BASIC_ENTITIES, col)


def strip_tags(col: Column) -> Column:
    return F.regexp_replace(col, "<[^>]+>", " ")


def html_to_text(col: Column) -> Column:
    """Text of a page: style blocks, CSS rules left in the text, and tags out."""
    c = F.regexp_replace(col, r"(?is)<style[^>]*>.*?</style>", " ")
    c = F.regexp_replace(c, r"\.[a-zA-Z0-9_]+\s*\{[^}]*\}", " ")
    return collapse_spaces(basic_entities(strip_tags(c)))


def longest_block(html: Column, min_chars: int = 120, max_chars: int = 20000) -> Column:
    """The longest content block of a judgment page.

    Without a block of at least ``min_chars`` the text after the first legal
    heading is taken, else ''.
    """
    def blocks(tags: str) -> Column:
        raw = F.regexp_extract_all(html, F.lit(rf"(?is)<({tags})\b[^>]*>.*?</\1>"), F.lit(0))
        text = F.transform(raw, lambda b: collapse_spaces(basic_entities(strip_tags(b))))
        return F.filter(text, lambda t: F.length(t) >= min_chars)

    def longest(texts: Column) -> Column:
        return F.array_max(
            F.transform(texts, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))
        )["t"]

    plain = collapse_spaces(basic_entities(strip_tags(html)))
    headed = [
        blank_to_null(F.regexp_extract(plain, rf"(?s)({h}.{{80,12000}})", 1)) for h in M.JP_TEXT_HEADINGS
    ]
    found = F.coalesce(
        longest(blocks("main|article|td")), longest(blocks("p|div")), *headed, F.lit("")
    )
    return F.substring(found, 1, max_chars)


def resolve_link(href: Column, base: Column) -> Column:
    """Absolute URL of ``href`` as seen from the site ``base`` (scheme and host)."""
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    scheme = F.regexp_extract(base, r"^(https?:)", 1)
    return (
        F.when(href.rlike(r"^https?://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(root, F.lit("/"), href))
    )


def id_from_url(url: Column) -> Column:
    """The ``id`` query value, else the first of five path patterns, else ''."""
    # the Unicode flag is left out: ids are ASCII and \b must see them so
    patterns = [r"[?&]id=(\d+)", r"/hanrei/(\d+)/", r"/detail\d?/(\d+)", r"detail\d?[^\d]*(\d{3,})", r"\b(\d{4,})\b"]
    return F.coalesce(
        blank_to_null(F.regexp_extract(url, r"[?&]id=([^&#]+)", 1)),
        *[blank_to_null(F.regexp_extract(url, p, 1)) for p in patterns],
        F.lit(""),
    )


def doc_id_from_path(href: Column) -> Column:
    """Number in /doc/N/ or /docfragment/N/, else ''."""
    return F.regexp_extract(href, r"/(?:doc|docfragment)/(\d+)/", 1)


# ---- years ----------------------------------------------------------------

def year_in_text(col: Column) -> Column:
    """First stand-alone 19xx or 20xx."""
    return F.regexp_extract(col, U + r"\b(19|20)\d{2}\b", 0).try_cast("int")


def leading_year(col: Column) -> Column:
    """First four characters as a number, NULL if they are none."""
    head = F.substring(col, 1, 4)
    return F.when(head.rlike(r"^\d{4}$"), head.try_cast("int"))


def era_year(col: Column) -> Column:
    """A Western year, else a Japanese era year (元 is the first year)."""
    pattern = r"(令和|平成|昭和)\s*(元|\d{1,2})年"
    era = F.regexp_extract(col, pattern, 1)
    number = F.regexp_extract(col, pattern, 2)
    n = F.when(number == "元", F.lit(1)).otherwise(number.try_cast("int"))
    chain = None
    for name, base in M.ERA_BASE.items():
        chain = (F if chain is None else chain).when(era == name, n + base)
    return F.coalesce(year_in_text(col), chain)


def celex_year(col: Column) -> Column:
    return F.regexp_extract(col, r"(\d)(\d{4})([A-Z])(\d+)", 2).try_cast("int")


def two_digit_year(col: Column, pattern: str = r"/(\d{2})\.") -> Column:
    """Two-digit year with the pivot at 50."""
    y = F.regexp_extract(col, pattern, 1).try_cast("int")
    return F.when(y < 50, y + 2000).otherwise(y + 1900)


# ---- small extractors ------------------------------------------------------

def us_article(col: Column) -> Column:
    """'§ 107' as found, else 'Section 107'."""
    mark = blank_to_null(F.regexp_extract(col, U + r"(§+\s*\d+[A-Za-z0-9\-]*)", 1))
    word = blank_to_null(F.regexp_extract(col, U + r"(?i)\bsection\s+(\d+[A-Za-z0-9\-]*)", 1))
    return F.coalesce(mark, F.concat(F.lit("Section "), word))


def kr_article(col: Column) -> Column:
    return blank_to_null(F.regexp_replace(F.regexp_extract(col, r"(제\s*\d+\s*조)", 1), r"\s+", ""))


def jp_court(col: Column) -> Column:
    return F.coalesce(blank_to_null(F.regexp_extract(col, U + M.JP_COURT, 1)), F.lit("裁判所"))


def jp_result(col: Column) -> Column:
    """First outcome word in list order, so 破棄 hides 破棄差戻し."""
    return F.coalesce(first_contained(col, M.JP_RESULT_WORDS), F.lit("Unknown"))


# Court codes of German result lines.
DE_COURTS = {
    "BGH": "Bundesgerichtshof",
    "BVerfG": "Bundesverfassungsgericht",
    "BVerwG": "Bundesverwaltungsgericht",
    "BAG": "Bundesarbeitsgericht",
    "BFH": "Bundesfinanzhof",
    "BSG": "Bundessozialgericht",
    "BPatG": "Bundespatentgericht",
    "OLG": "Oberlandesgericht",
    "LG": "Landgericht",
    "AG": "Amtsgericht",
    "EuGH": "Europäischer Gerichtshof",
}


def de_result_line(title: Column) -> Column:
    """STRUCT<court, decided, case_number, year> of 'COURT, dd.mm.yyyy - number'."""
    pattern = U + r"^([A-Za-z]+),?\s+(\d{2}\.\d{2}\.\d{4})\s*-\s*(.*)"
    code = F.regexp_extract(title, pattern, 1)
    decided = F.regexp_extract(title, pattern, 2)
    names = F.create_map(*[F.lit(x) for kv in DE_COURTS.items() for x in kv])
    return F.struct(
        F.coalesce(F.try_element_at(names, code), code).alias("court"),
        decided.alias("decided"),
        F.trim(F.regexp_extract(title, pattern, 3)).alias("case_number"),
        F.regexp_extract(decided, r"(\d{4})", 1).try_cast("int").alias("year"),
    )


def compact_article(col: Column) -> Column:
    """Article label without whitespace, lower-cased."""
    return F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), U + r"\s+", "")
