import random
import re

import pytest
from pyspark.sql import functions as F

from lexspark.fixed.citations import CITATION_PATTERNS
from lexspark.functions import citations as C
from lexspark.functions import metadata as M
from lexspark.functions import text as T
from lexspark.functions import treatment as TR
from lexspark.functions.text import contains_any
from lexspark.functions.spans import SpanFinder, first_literals, led_literals

TEXTS = [
    ("US", "See Miranda v. Arizona, 384 U.S. 436 (1966); 410 F.2d 12; 384 U.S. 436 again."),
    ("AU", "In [2020] UKSC 5 and [2019] HCA 18, (1992) 175 CLR 1, the court held."),
    ("EU", "Application no. 39954/08, CELEX:32001L0029, Case C-131/12 and Case T-99/04."),
    ("JP", "最大判昭和48年4月4日 民集27巻3号265頁 知財高判令和3年6月1日"),
    ("DE", "BVerfG, 1 BvR 357/05; 1 Ni 33/08; I ZB 12/67; II ZR 195/05"),
    ("FR", "Cass. civ. 1re, 15 janv. 2024, n° 22-12.345; pourvoi n° E 09-15.956; article 1351 du code civil; Lebon p. 12"),
    ("CA", "[2024] 1 SCR 123; 2024 SCC 15; 2024 FCA 45; 2024 ONCA 123; (2024) 456 DLR (4th) 123"),
    ("KR", "대법원 2024. 1. 15. 선고 2023다12345 판결 헌법재판소 2024. 3. 28. 2023헌바123 결정"),
    ("PL", "III CZP 1/23, Sygn. akt II K 69/11, Dz.U. z 2023 r. poz. 1234, OSNC 2023/1/12"),
    ("AT", "VwGH 2023/15/0123 BGBl. I Nr. 123/2023 OGH 1 Ob 123/23x"),
    ("BR", "STF, RE 123456 RE 123.456/SP STJ, REsp 1234567/SP TJSP, Ap. 1234567-12.2024.8.26.0100"),
    ("SG", "[2024] SGCA 12 [2024] 1 SLR(R) 456 [2024] HKCFI 456 (2024) 27 HKLRD 123 [2024] NZSC 12"),
    ("us", "no citation here, é 12"),
]


def _expected(text, own, width=50):
    order = [own] + [j for j in CITATION_PATTERNS if j != own]
    seen = {}
    for code in order:
        for pattern in CITATION_PATTERNS.get(code, []):
            for m in re.finditer(pattern, text):
                around = text[max(0, m.start() - width): m.end() + width]
                seen.setdefault(m.group(0), (code, m.start(), m.end(), around))
    return seen


def test_citations_agree_with_python_regexes(spark):
    docs = spark.createDataFrame([(i, j, t) for i, (j, t) in enumerate(TEXTS)], "doc_id INT, jurisdiction STRING, text STRING")
    plain = {(r.doc_id, r.citation_string): r.jurisdiction for r in C.extract_citations(docs).collect()}
    full = {
        (r.doc_id, r.citation_string): (r.jurisdiction, r.start, r.stop, r.context)
        for r in C.extract_citations_with_context(docs).collect()
    }
    want = {(i, s): v for i, (j, t) in enumerate(TEXTS) for s, v in _expected(t, j.upper()).items()}
    assert full == want
    assert plain == {k: v[0] for k, v in want.items()}
    assert len(want) > 40


def test_spans_equal_plain_scans():
    """Random strings of pattern fragments, matches that touch, repeat and overlap."""
    numbered = [(p, needs) for _, _, p, needs in C._numbered()]
    finder, rng = SpanFinder(numbered), random.Random(5)
    parts = [t for _, t in TEXTS] + "[2020] UKSC 5|[2019] 1 AC 12|(2019) 3 SCC 4|BGE 130 III 5|BGE|(|[|/| |\n|U.S.|410 U.S. 113|Roe v. Wade, |2020 SCC 5|K 1/20|x|é|\U0001F600|12 Ni 3/20|RE 1.234|JORF no 12345".split("|")
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "; "]) for _ in range(rng.randint(0, 12)))
        want = [(i, n, m.start(), m.end()) for i, (p, _) in enumerate(numbered) for n, m in enumerate(re.finditer(p, text))]
        assert list(finder.find(text)) == want
    assert first_literals(r"a?b") == () and first_literals(r"ab|c") == () and first_literals(r"\b(?:ab|c)d") == ("ab", "c")
    assert first_literals(r"x\.y+\d") == ("x.y",) and first_literals(r"[ab]c") == () and first_literals(r"(ab|c)?d") == ()


def test_long_word_lists_are_no_regex(spark):
    words = ["w%d." % i for i in range(60)]
    texts = ["see w7. here", "see w7 here", "w59.", "", None, "W3."]
    rows = spark.createDataFrame(list(enumerate(texts)), "n INT, x STRING").select("n", contains_any(F.col("x"), words).alias("y"))
    assert [r.y for r in rows.orderBy("n").collect()] == [True, False, True, False, None, False]
    assert "RLIKE" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_led_and_shared_patterns_are_tried_where_they_can_match():
    """Numbers before a reporter, and texts with a slash but no file number, cost no scan of the text."""
    assert led_literals(r"\b(\d{1,4})\s+(F\.\d?d|U\.S\.)") == ("F.", "U.S.") and led_literals(r"\b\d{4}\s+FCA?\s+\d") == ("FC",)
    assert led_literals(r"\b\d{4}다\d+\b") == () and led_literals(r"\b\d{4}\s+(?:AB|x?y)") == () and led_literals(r"\d{4}\s+AB") == ()
    numbered = [(p, needs) for _, _, p, needs in C._numbered()]
    finder, rng = SpanFinder(numbered, C._PARTS), random.Random(6)
    scanned = {i for i, (p, _) in enumerate(numbered) if not finder._windowed[i] and finder._parts[i] is None}
    assert not scanned & {0, 1, 11, 12, 28, 29, 30, 50, 51, 52, 53, 56}
    parts = "410 U.S. 113|410 U.S.\u00a0113 (1973)|12345 U.S. 6|x12 U.S. 3|\u0663 U.S. 4|7\n\t U.S. 8|12 F.3d 9|2 S. Ct. 5|U.S. 1| U.S. |2020 SCC 5|2001 FCA 3|1999 ONCA 12|IV Ka 12/05|K 1/20|Case C-12/05|ZR 5/05|VI Xy 3/99|sygn. akt II K 5/09|1|9 | |(|/".split("|")
    for _ in range(400):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "; "]) for _ in range(rng.randint(0, 12)))
        want = [(i, n, m.start(), m.end()) for i, (p, _) in enumerate(numbered) for n, m in enumerate(re.finditer(p, text))]
        assert list(finder.find(text)) == want


def test_contexts_of_null_empty_long_and_repeated_texts(spark):
    long = "[2020] UKSC 5 and " * 30000
    docs = spark.createDataFrame([(1, "GB", None), (2, "GB", ""), (3, "UK", long), (4, None, "BGE 130 III 5"), (4, "CH", "see BGE 130 III 5")], "doc_id INT, jurisdiction STRING, text STRING")
    got = sorted((r.doc_id, r.citation_string, r.jurisdiction, r.start, r.stop) for r in C.extract_citations_with_context(docs).collect())
    # the row of the own jurisdiction goes first where rows share an id
    assert got == [(3, "[2020] UKSC 5", "UK", 0, 13), (4, "BGE 130 III 5", "CH", 4, 17)]
    assert C.extract_citations_with_context(docs.limit(0)).collect() == []


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "x STRING").select(column.alias("y")).first().y


@pytest.mark.parametrize("context,kind,word", [
    ("that holding was Overruled on appeal", "overruling", "overruled"),
    ("unlimited liability", "distinguishing", "limited"),
    ("eine Abweichung", "overruling", "abweichung"),
    ("判例変更がされた", "overruling", "変更"),
    ("射程外である", "distinguishing", "射程外"),
    ("see also", "neutral", None), ("", "neutral", None), (None, "neutral", None),
])
def test_treatment(spark, context, kind, word):
    x = F.col("x")
    assert _one(spark, TR.treatment_type(x), context) == kind
    assert _one(spark, TR.treatment_keyword(x), context) == word


@pytest.mark.parametrize("court,jurisdiction,rank", [
    ("U.S. Supreme Court", "US", 0), ("9th Circuit Court", "US", 1), ("UK High Court", "GB", 2), ("High Court", "AU", 0),
    ("最高裁判所", "JP", 0), ("Tax Tribunal", "US", 999), ("Supreme Court", "XX", 999), (None, "US", 999),
])
def test_court_rank(spark, court, jurisdiction, rank):
    assert _one(spark, TR.court_rank(F.col("x"), F.lit(jurisdiction)), court) == rank


@pytest.mark.parametrize("raw,day", [
    ("2024/1/5", "2024-01-05"), ("Jan. 15, 2024", "2024-01-15"), ("15 march 2024", "2024-03-15"), ("令和5年1月15日", "2023-01-15"),
    ("平成30年2月3日", "2018-02-03"), ("2024年1月15日", "2024-01-15"), ("2024-13-45", "2024-13-45"), ("２０２４年１月５日", "2024-01-05"), ("none", None),
])
def test_dates(spark, raw, day):
    assert _one(spark, M.normalize_date(F.col("x")), raw) == day


@pytest.mark.parametrize("text,loose,amount,currency", [
    ("賠償金は5億円", False, 5e8, "JPY"), ("300万円", False, 3e6, "JPY"), ("€14.2 million", False, 14.2e6, "EUR"), ("$5M paid", False, 5e6, "USD"),
    ("$5 more", False, 5.0, "USD"), ("$5 more", True, 5e6, "USD"), ("usd 1,234.50", False, 1234.5, "USD"), ("nothing", False, None, None),
])
def test_amounts(spark, text, loose, amount, currency):
    got = _one(spark, M.amount(F.col("x"), loose), text)
    assert (got.amount, got.currency) == (amount, currency)


def test_partial_metadata(spark):
    text = (
        "IPR2020-00123. Filed January 5, 2019; decided 2021-03-04. Damages of $2.5 million under 35 U.S.C. § 101, "
        "Section 5 and section 5 and Art. 7. The claim was dismissed. Preliminary injunction granted."
    )
    m = _one(spark, M.partial_metadata(F.col("x"), F.lit("WIPO-UDRP")), text)
    assert m.case_id.case_number == "IPR2020-00123"
    assert (m.procedure_timeline.filing_date, m.case_id.decision_date) == ("2019-01-05", "2021-03-04")
    assert (m.outcome.damages.amount, m.outcome.liability, m.outcome.injunction) == (2.5e6, "dismissed", "granted")
    assert m.citations.legal_provisions == ["§ 101", "Section 5", "Art. 7.", "35 U.S.C. § 101"]
    assert (m.procedure.type, m.procedure.ip_field) == ("UDRP", "domain")
    frame = spark.createDataFrame([(text,)], "x STRING").select(M.partial_metadata(F.col("x"), F.lit(None).cast("string")).alias("m"))
    row = frame.select(M.missing_fields(F.col("m")).alias("f"), M.metadata_issues(F.col("m")).alias("i")).first()
    assert row.i == [] and "case_id.source" in row.f and "outcome.liability" not in row.f


def test_damages_read_where_they_are_stated(spark):
    text = "An invoice over $ 170.116 and USD 42. Damages of $ 3333.00 were sought."
    stated = F.regexp_extract("x", r"\$ \d+\.00", 0)
    m = _one(spark, M.partial_metadata(F.col("x"), F.lit("upc"), stated), text)
    assert (m.outcome.damages.amount, m.outcome.damages.currency) == (3333.0, "USD")
    assert _one(spark, M.partial_metadata(F.col("x"), F.lit("upc")), text).outcome.damages.amount == 170.116


def test_empty_metadata_and_json_issues(spark):
    m = spark.range(1).select(M.empty_metadata().alias("m")).first().m
    assert m.case_id.source is None and m.parties.plaintiffs == [] and m.citations.case_law == []
    issues = _one(spark, M.json_issues(F.col("x")), '{"case_id": {"source": "a", "decision_date": "5 May"}}')
    assert "Missing top-level field: notes" in issues and "Missing case_id.court_name" in issues
    assert "Invalid date format for case_id.decision_date: 5 May" in issues


@pytest.mark.parametrize("jurisdiction,text,judges,outcome", [
    ("US", "Before Judge Smith. Jane Doe, Circuit Judge. The motion is granted.", ["Jane Doe", "Smith"], "granted"),
    ("JP", "主文 本件控訴を棄却する。裁判長裁判官 山田太郎", ["山田太郎", "山田太郎"], "棄却"),
    ("EU", "President Müller. Violation of Article 8. Application no. 1/20", ["Müller"], "violation"),
    ("GB", "Lord Justice Moses and Mrs Justice Lang", ["Justice", "Lang", "Moses"], None),
    ("IN", "Hon'ble Mr. Justice Ramana", ["Ramana"], None),
    ("ZZ", "Justice Gray and Judge Ames", ["Ames", "Gray"], None),
    ("ZZ", "nobody", None, None),
])
def test_judgment_facts(spark, jurisdiction, text, judges, outcome):
    f = _one(spark, M.judgment_facts(F.col("x"), F.lit(jurisdiction)), text)
    assert (f.judge_names, f.outcome) == (judges, outcome)


def test_damages_by_jurisdiction(spark):
    us = _one(spark, M.judgment_facts(F.col("x"), F.lit("US")), "a verdict of $1,200.50 and more")
    assert (us.damages_amount, us.damages_currency) == (1200.5, "USD")
    jp = _one(spark, M.judgment_facts(F.col("x"), F.lit("JP")), "被告は金1,000円を支払え")
    assert (jp.damages_amount, jp.damages_currency) == (1000.0, "JPY")


@pytest.mark.parametrize("fn,value,want", [
    (T.normalize_citation, "  384  F. 3d   12 ", "384 f.3d 12"),
    (T.citation_name_part, "Miranda  v. Arizona, 384 U.S. 436", "Miranda v. Arizona"),
    (T.era_year, "昭和元年", 1926), (T.era_year, "令和3年", 2021), (T.era_year, "in 1999", 1999),
    (T.two_digit_year, "259/25.0YREVR.S1", 2025), (T.two_digit_year, "259/75.0", 1975),
    (T.us_article, "Section 107(a)", "Section 107"), (T.kr_article, "제 12 조", "제12조"),
    (T.id_from_url, "https://c/app/detail2?id=1234", "1234"), (T.id_from_url, "/hanrei/77/x", "77"),
    (T.doc_id_from_path, "/docfragment/55/?x", "55"), (T.jp_court, "東京地方裁判所 民事部", "東京地方裁判所"), (T.jp_court, "x", "裁判所"),
    (T.jp_result, "原判決を破棄差戻し", "破棄"), (T.keyword_tokens, "著作権、侵害 a,b", ["著作権", "侵害", "a", "b"]),
    (T.html_to_text, "<style>p{}</style><p>a &amp;amp; b</p> .s1 {x:y} c", "a &amp; b c"), (T.compact_article, "§ 1 A", "§1a"),
])
def test_small_functions(spark, fn, value, want):
    assert _one(spark, fn(F.col("x")), value) == want


def test_cjk_bigrams(spark):
    assert _one(spark, T.search_terms(F.col("x"), True), "著作権法 law") == ["著作", "作権", "権法", "law"]
    assert _one(spark, T.search_terms(F.col("x")), "著作権法 law-2") == ["著作権法", "law", "2"]
