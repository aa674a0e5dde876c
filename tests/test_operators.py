import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lexspark.functions.metadata import dates_in_text
from lexspark.operators import entities as E
from lexspark.operators import events as EV
from lexspark.operators import graph as G
from lexspark.operators import party as P
from lexspark.operators import search as S
from lexspark.operators import validity as V
from lexspark.operators import blocks as BL
from lexspark.operators import substring as SB
from lexspark.operators import matching as M
from lexspark.functions import windows as W
from lexspark.operators.matching import similar_candidates, similar_join
from lexspark.operators.ranking import best_priority, fill_by_priority, top_per_group
from lexspark.operators.resolve import build_citation_index, resolve_citations


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, prev = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y))
    return row[-1]


def test_substring_index_is_exact(spark, tmp_path, monkeypatch):
    # small limits, so that longer grams and pairs of grams are needed
    monkeypatch.setattr(SB, "FREQUENT", 6)
    monkeypatch.setattr(SB, "RARE", 2)
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 30))), rnd.choice(["US", "GB", None])) for i in range(120)]
    keys = {("".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 20))), rnd.choice(["US", "GB", None])) for _ in range(90)}
    keys |= {(t[2:9], None) for _, t, _ in texts} | {(t[1:], "US") for _, t, _ in texts} | {(None, "US")}
    rows = spark.createDataFrame([*texts, (900, None, "US")], "id INT, txt STRING, j STRING")
    live = SB.substring_index(rows, "txt", "j", "id")
    SB.write_substring_index(live, str(tmp_path))
    want = {(k, s or SB.ANY, t, j or "") for k, s in keys if k for _, t, j in texts if k in t and s in (None, j)}
    frame = spark.createDataFrame(sorted(keys, key=str), "key STRING, scope STRING")
    for index in (live, SB.read_substring_index(spark, str(tmp_path))):
        assert {(r.key, r.scope, r.text, r.text_scope) for r in SB.containing(frame, index).collect()} == want


def test_substring_candidates_grow_with_the_keys(spark):
    def count(n):
        rows = spark.range(n).selectExpr("id", "concat('common holding of the company ', id) AS txt", "'US' AS j")
        keys = rows.selectExpr("concat('holding of the company ', id) AS key", "'US' AS scope")
        return SB.candidates(keys, SB.substring_index(rows, "txt", "j", "id")).count()

    assert count(2000) <= 2.5 * count(1000)


@pytest.mark.parametrize("few", [200_000, 3])
def test_lookups_without_an_index_are_exact(spark, monkeypatch, few):
    # with the small limit heads are one character long and keys meet their substrings in a shuffle
    monkeypatch.setattr(SB, "FEW_HEADS", few)
    monkeypatch.setattr(SB, "FEW_KEYS", few)
    rnd = random.Random(4)
    texts = [(i, "".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 30))), rnd.choice(["US", "GB", None])) for i in range(120)]
    keys = {("".join(rnd.choice("ab é") for _ in range(rnd.randint(0, 20))), rnd.choice(["US", "GB", None])) for _ in range(90)}
    keys |= {(t[2:9], None) for _, t, _ in texts} | {(t[1:], "US") for _, t, _ in texts} | {(None, "US")}
    rows = spark.createDataFrame([*texts, (900, None, "US")], "id INT, txt STRING, j STRING")
    frame = spark.createDataFrame(sorted(keys, key=str), "key STRING, scope STRING")
    want = {(k, s or SB.ANY, i) for k, s in keys if k for i, t, j in texts if k in t and s in (None, j)}
    assert {tuple(r) for r in SB.occurrences(frame, rows, "txt", "j", ["id"]).collect()} == want
    least = {}
    for k, s, i in want:
        least[k, s] = min(i, least.get((k, s), i))
    assert {(r.key, r.scope): r.least for r in SB.least_containing(frame, rows, "txt", "j", "id").collect()} == least


def test_only_substrings_shaped_like_a_key_leave_the_scan(spark):
    rows = spark.range(500).selectExpr("concat('customer#', id, ' v. supplier#', id % 10) AS txt")
    asked = spark.range(1000).selectExpr("concat('o-', id) AS key", "'*' AS scope").unionByName(
        spark.range(300).selectExpr("concat('customer#', id, ' v. supplier#', id % 10) AS key", "'*' AS scope")
    )
    # a row has one such substring; its grams would be about ninety
    assert SB._occurrences(asked, rows, "txt", ["txt"]).count() <= 500


@pytest.mark.parametrize("hot_pairs", [20_000, 3])
def test_similar_join_is_exact(spark, monkeypatch, hot_pairs):
    # with the small limit most texts are cut by rarity
    monkeypatch.setattr(M, "HOT_PAIRS", hot_pairs)
    rnd = random.Random(2)
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 30))) for _ in range(60)]

    def mutate(s):
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(s) + 1)
            s = rnd.choice([s[:i] + rnd.choice("abcde") + s[i:], s[:i] + s[i + 1:], s[:i] + rnd.choice("abcde") + s[i + 1:]])
        return s

    left = sorted({m for b in base for m in (mutate(b), mutate(b)) if m})
    right = sorted(set(base))
    lf = spark.createDataFrame([(x,) for x in left], "l STRING")
    rf = spark.createDataFrame([(x,) for x in right], "r STRING")
    got = {(x.l, x.r) for x in similar_join(lf, "l", rf, "r", 0.85).collect()}
    want = {
        (a, b) for a in left for b in right
        if _edits(a, b) <= math.floor(max(len(a), len(b)) * (1 - 0.85) + 1e-9)
    }
    assert got == want and len(want) > 20


def test_a_common_word_does_not_pair_all_names(spark, monkeypatch):
    monkeypatch.setattr(M, "HOT_PAIRS", 100)
    rnd = random.Random(3)

    def names(n):
        return ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=8)) + " international" for _ in range(n)]

    left, right = names(300), names(300)
    # edited copies, also inside the common word, are found all the same
    edited = [(x, x[1:]) for x in right[:20]] + [(x, x.replace("national", "nationals")) for x in right[20:40]] + [(x, x.replace("tern", "trn")) for x in right[40:60]]
    texts = [spark.createDataFrame([(x,) for x in sorted(set(t))], "text STRING") for t in (left + [y for _, y in edited], right)]
    got = {(r.left, r.right) for r in similar_candidates(*texts, 0.85).collect()}
    assert {(y, x) for x, y in edited} <= got
    assert len(got) < 0.05 * 360 * 300


def test_top_per_group_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id").repartition(4)
    top = top_per_group(df, ["g"], [F.col("id").desc()], 2)
    assert {tuple(r) for r in top.collect()} == {(g, 999 - ((999 - g) % 3) - 3 * k) for g in range(3) for k in range(2)}
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_priorities(spark):
    df = spark.createDataFrame(
        [("q", 2, 1), ("q", 1, 2), ("q", 1, 3), ("r", 3, 4)], "request STRING, priority INT, seq INT"
    )
    assert {r.seq for r in best_priority(df, "request", "priority").collect()} == {2, 3, 4}
    filled = fill_by_priority(df, "request", "priority", F.col("seq"), 1, 2)
    assert sorted((r.request, r.position, r.seq) for r in filled.collect()) == [("q", 1, 2), ("q", 2, 1), ("r", 1, 4)]


# ---- validity and resolution ---------------------------------------------------------

CASES = [
    ("a", "Alpha v. Beta", "1 AB 2", "US", "District Court", "2001-01-01"),
    ("b", "Gamma v. Delta", "No-77", "US", "Supreme Court", "2002-01-01"),
    ("c", "Old v. New", "No-78", "GB", "High Court", "2003-01-01"),
    ("d", "Alpha v. Beta", "No-79", "GB", "High Court", None),
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(
        CASES, "case_id STRING, case_name STRING, case_number STRING, jurisdiction STRING, court STRING, decision_date STRING"
    )


def test_validity(spark, cases):
    edges = spark.createDataFrame(
        [("b", "a", "r1", "Overruled"), ("c", "b", "r2", "overruled"), ("x", "c", "r3", "overruled"), ("a", "d", "r4", "distinguished")],
        "citing_case_id STRING, cited_case_id STRING, cited_reference STRING, citation_context STRING",
    )
    got = {r.case_id: (r.signal, r.citing_count) for r in V.case_validity(edges, cases).collect()}
    # the only case citing c is not in the corpus
    assert got == {"a": ("red", 1), "b": ("yellow", 1), "c": ("unknown", 0), "d": ("yellow", 1)}
    over = V.overruling_cases(edges, cases).collect()
    assert {(r.cited_case_id, r.keyword, r.higher_court) for r in over} == {("a", "overruled", True), ("b", "overruled", False)}
    keys = spark.createDataFrame([("a",), ("zz",)], "case_id STRING")
    assert {(r.case_id, r.reason) for r in V.validity_of(keys, edges, cases).collect()} >= {("zz", "Case 'zz' not found in database.")}


def test_resolution_ranks(spark, cases):
    refs = [
        ("No-77", None), ("Alpha v. Beta", None), ("Alpha v. Beta", "GB"), ("ALPHA  v. BETA", None),
        ("Alpha  v. Beta, 12 F.3d 4", "US"), ("mma v. Del, 9 U.S. 1", None), ("mma v. Del, 9 U.S. 1", "GB"), ("o-7", "US"), ("nothing", None),
    ]
    frame = spark.createDataFrame(refs, "citation_string STRING, jurisdiction STRING")
    got = {(r.citation_string, r.jurisdiction): (r.case_id, r.match_rank) for r in resolve_citations(frame, build_citation_index(cases), cases).collect()}
    assert got == {
        ("No-77", None): ("b", 1), ("Alpha v. Beta", None): ("a", 1), ("Alpha v. Beta", "GB"): ("d", 1), ("ALPHA  v. BETA", None): ("a", 2),
        ("Alpha  v. Beta, 12 F.3d 4", "US"): ("a", 3), ("mma v. Del, 9 U.S. 1", None): ("b", 4), ("mma v. Del, 9 U.S. 1", "GB"): (None, None),
        ("o-7", "US"): ("b", 5), ("nothing", None): (None, None),
    }


def test_resolution_without_an_index_builds_none(spark, cases, monkeypatch):
    def built(*_):
        raise AssertionError("an index of all names was built")

    monkeypatch.setattr("lexspark.operators.resolve.substring_index", built)
    frame = spark.createDataFrame([("mma v. Del, 9 U.S. 1", None), ("o-7", "US")], "citation_string STRING, jurisdiction STRING")
    assert {r.match_rank for r in resolve_citations(frame, build_citation_index(cases), cases).collect()} == {4, 5}


# ---- graph ----------------------------------------------------------------------------

def test_network_keeps_missing_cases_as_edges_and_stops_at_the_cap(spark):
    ids = ["s", "a", "b", "c", "d"]
    cases = spark.createDataFrame([(i, i, "US", "x", "2000") for i in ids], "case_id STRING, case_name STRING, jurisdiction STRING, court STRING, decision_date STRING")
    edges = spark.createDataFrame(
        [("s", "a", "ra", ""), ("a", "b", "rb", ""), ("b", "c", "rc", ""), ("ghost", "s", "rs", ""), ("d", "ghost", "rd", ""), ("s", None, "lost", "ctx"), ("c", "d", "re", "")],
        "citing_case_id STRING, cited_case_id STRING, cited_reference STRING, citation_context STRING",
    )
    seeds = spark.createDataFrame([("s",)], "case_id STRING")
    net = G.citation_network(seeds, edges, cases, depth=3, max_nodes=50)
    assert {(r.case_id, r.depth) for r in net.nodes.collect()} == {("s", 0), ("a", 1), ("b", 2), ("d", 2), ("c", 3)}
    assert {(r.source, r.target) for r in net.edges.collect()} == {("s", "a"), ("ghost", "s"), ("a", "b"), ("d", "ghost"), ("b", "c"), ("c", "d")}
    assert [(r.cited_reference, r.context) for r in net.unresolved.collect()] == [("lost", "ctx")]
    small = G.citation_network(seeds, edges, cases, depth=3, max_nodes=2)
    assert {(r.case_id, r.depth) for r in small.nodes.collect()} == {("s", 0), ("a", 1)}
    assert {(r.source, r.target) for r in small.edges.collect()} == {("s", "a"), ("ghost", "s")}


# ---- search ----------------------------------------------------------------------------

DOCS = [
    (1, "Alpha Beta", "the quick alpha fox", "US"), (2, "Gamma", "alpha beta beta", "GB"), (3, "Beta-Alpha", "nothing", "US"), (4, "Other", "beta then alpha", "US"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id INT, name STRING, body STRING, jurisdiction STRING")


def _bm25(terms, all_terms=True):
    import re

    toks = {d: (re.findall(r"\w+", n.lower()), re.findall(r"\w+", b.lower())) for d, n, b, _ in DOCS}
    avg = sum(len(n) + len(b) for n, b in toks.values()) / len(toks)
    out = {}
    for d, (n, b) in toks.items():
        present = [t for t in terms if t in n or t in b]
        if (all_terms and len(present) < len(terms)) or not present:
            continue
        score = 0.0
        for t in present:
            df = sum(t in x or t in y for x, y in toks.values())
            f = 10 * n.count(t) + b.count(t)
            idf = max(math.log((len(toks) - df + 0.5) / (df + 0.5)), 1e-6)
            score += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * (len(n) + len(b)) / avg))
        out[d] = round(score, 9)
    return out


@pytest.mark.parametrize("match_all", [True, False])
def test_bm25_by_hand(spark, docs, match_all):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "Quick"), (3, "  "), (4, "absent alpha")], "qid INT, query STRING")
    got = {(r.qid, r.doc_id): r.score for r in S.bm25_matches(q, docs, "doc_id", "name", "body", match_all=match_all).collect()}
    want = {(qid, d): s for qid, terms in ((1, ["alpha", "beta"]), (2, ["quick"]), (4, ["absent", "alpha"])) for d, s in _bm25(terms, match_all).items()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_phrases_and_stored_index(spark, docs, tmp_path):
    q = spark.createDataFrame([(1, "beta-alpha"), (2, "beta alpha")], "qid INT, query STRING")
    live = {tuple(r) for r in S.bm25_matches(q, docs, "doc_id", "name", "body").collect()}
    assert {(a, b) for a, b, _ in live} == {(1, 3)} | {(2, d) for d in (1, 2, 3, 4)}
    S.write_index(docs, "doc_id", "name", "body", str(tmp_path / "ix"), buckets=8)
    index = S.read_index(spark, str(tmp_path / "ix"))
    stored = {tuple(r) for r in S.bm25_matches(q, docs, "doc_id", "name", "body", index=index, buckets=8).collect()}
    assert stored == live


def test_phrases_by_positions_match_plain_text(spark):
    rows = [
        (1, "red red", "blue"), (2, "red", "red blue"), (3, "blue red", "red"), (4, None, "red blue red red blue"),
        (5, "red", None), (6, "", "blue blue red"),
    ]
    docs = spark.createDataFrame(rows, "doc_id INT, name STRING, body STRING").withColumn("jurisdiction", F.lit("US"))
    asked = ["red-red", "red-blue", "blue-red-red", "red-blue blue-red", "blue-blue"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid INT, query STRING")
    index = S.text_index(docs, "doc_id", "name", "body", keep=("jurisdiction",))
    for given in (None, index):
        got = {(r.qid, r.doc_id) for r in S.bm25_matches(q, docs, "doc_id", "name", "body", index=given).collect()}
        assert got == {
            (i, d) for i, query in enumerate(asked) for d, name, body in rows
            if all(any(f" {p.replace('-', ' ')} " in f" {t or ''} " for t in (name, body)) for p in query.split())
        }


def test_no_text_in_the_shuffles_of_a_search(spark, docs):
    q = spark.createDataFrame([(1, "alpha beta"), (2, "beta-alpha")], "qid INT, query STRING")
    plan = S.bm25_matches(q, docs, "doc_id", "name", "body")._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan


def test_postings_of_all_words_are_made_inside_the_row(spark):
    rng = random.Random(4)
    words = ["red", "Blue", "green,", "é", "red.", "..."]
    rows = [(str(i), " ".join(rng.choices(words, k=i % 4)), " ".join(rng.choices(words, k=i % 9)) if i % 5 else None) for i in range(40)]

    def plan(given):
        found = S.postings(spark.createDataFrame(given, "doc_id STRING, name STRING, body STRING"), "doc_id", "name", "body", positions=True)
        return found, found._jdf.queryExecution().executedPlan().toString()

    assert not any(step in plan(rows)[1] for step in ("Aggregate", "Exchange", "Sort "))
    # rows of one id are one document, a null id is one id
    rows += [("7", "red", "blue blue"), ("7", "red", None), (None, "red", "é"), (None, "", "red")]
    want = {}
    for doc_id, name, body in rows:
        n, b = ([t for t in re.split(r"[^\w]+", (x or "").lower()) if t] for x in (name, body))
        for i, t in enumerate(n + b):
            w = want.setdefault((doc_id, t), [0, 0, 0, []])
            w[i >= len(n)] += 1
            w[2] = max(w[2], len(n) + len(b))
            w[3].append(i + (i >= len(n)))
    got = plan(rows)[0].collect()
    assert len(got) == len(want)
    assert {(r.doc_id, r.term): [r.tf_name, r.tf_text, r.length, sorted(r.positions)] for r in got} == {
        k: [*v[:3], sorted(v[3])] for k, v in want.items()
    }


# ---- parties ---------------------------------------------------------------------------

def test_interval_matches_binomial_sums(spark):
    rows = [(5, 10), (0, 0), (0, 7), (7, 7), (40, 73), (300, 1000)]
    got = {(r.w, r.n): (r.ci_lower, r.ci_upper) for r in P.with_interval(spark.createDataFrame(rows, "w BIGINT, n BIGINT"), "w", "n").collect()}
    assert got[(5, 10)] == (0.234, 0.766) and got[(0, 0)] == (0.0, 0.0)

    def cdf(x, w, n):
        # P(Beta(w+1, n-w+1) <= x) = P(Binomial(n+1, x) >= w+1)
        return sum(math.comb(n + 1, k) * x**k * (1 - x) ** (n + 1 - k) for k in range(w + 1, n + 2))

    for w, n in rows[2:]:
        lo, hi = got[(w, n)]
        assert cdf(lo - 0.0006, w, n) < 0.025 < cdf(lo + 0.0006, w, n)
        assert cdf(hi - 0.0006, w, n) < 0.975 < cdf(hi + 0.0006, w, n)
        assert w in (0, n) or lo < w / n < hi


@pytest.mark.parametrize("wave_keys", [300_000_000, 2_000])
def test_names_that_share_a_word_are_paired_on_what_is_rare(spark, monkeypatch, wave_keys):
    monkeypatch.setattr(M, "WAVE_KEYS", wave_keys)
    rnd = random.Random(5)
    rare = ["".join(rnd.choices("abcd", k=9)) for _ in range(60)]
    right = sorted({f"{w} {x}" for w in ("atlas", "northern", "blue river") for x in rare[:30]} | {f"{x} group" for x in rare[30:]})
    left = sorted({"x" + t for t in right} | {t[:4] + t[5:] for t in right} | {f"unlisted {x}" for x in rare} | {"atlas", "a", "e12"})
    want = {(a, b) for a in left for b in right if _edits(a, b) <= math.floor(max(len(a), len(b)) * (1 - 0.85) + 1e-9)}
    frames = [spark.createDataFrame([(x,) for x in t], "text STRING") for t in (left, right)]
    # no pair that is not similar is left to compare
    assert [*map(tuple, similar_candidates(*frames, 0.85).orderBy("left", "right").collect())] == sorted(want)


def test_similar_short_texts_share_a_window_key():
    rnd = random.Random(6)
    for _ in range(600):
        r = "".join(rnd.choices("ab01", k=rnd.randint(1, W.longest_short(0.85))))
        x = r
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(x) + 1)
            x = rnd.choice([x[:i] + rnd.choice("ab01") + x[i:], x[:i] + x[i + 1:], x[:i] + rnd.choice("ab01") + x[i + 1:]])
        if not x or _edits(x, r) > W.allowed_edits(max(len(x), len(r)), 0.85):
            continue
        for place in (W.HEAD, W.TAIL):
            kinds = {(*k, place) for k in W.kinds_of_right(len(r), [len(x)], 0.85)}
            a = W.window_keys(W.code_points([r], len(r)), kinds)
            b = W.window_keys(W.code_points([x], len(x)), W.kinds_of_left(len(x), [(len(r), place)], 0.85))
            assert set(a[:, 0]) & set(b[:, 0]), (r, x, place)


def test_candidate_entities_need_no_index(spark, monkeypatch):
    def never(*_):
        raise AssertionError("an index of all grams for one call")

    monkeypatch.setattr(E, "substring_index", never, raising=False)
    ents = spark.createDataFrame(
        [("e1", "Acme Robotics", None, None, None, None, ["ACME Robotics Inc."]), ("e2", "Acme", None, None, None, "e1", None), ("e3", "Zed", None, None, None, None, [])],
        "canonical_id STRING, canonical_name STRING, country_code STRING, entity_type STRING, industry STRING, parent_id STRING, aliases ARRAY<STRING>",
    )
    names = spark.createDataFrame([("acme",), ("Robotics",), ("ze",), (None,), (" ",)], "raw_name STRING")
    got = {(r.raw_name, r.position): (r.canonical_id, r.confidence) for r in E.candidate_entities(names, ents).collect()}
    assert got == {("acme", 1): ("e2", 0.95), ("acme", 2): ("e1", None), ("Robotics", 1): ("e1", None), ("ze", 1): ("e3", None)}


def test_party_report(spark):
    rows = [(f"u{i}", "P v. Acme", ["P", "Acme"], [], "US", 2020 + i % 3, "defendant_win" if i % 3 == 0 else "plaintiff_win") for i in range(9)]
    rows += [("f1", "Q v Acme", ["Q", "Acme"], None, "FR", 2020, "plaintiff_win"), ("z", "Acme v. P", ["Acme", "P"], ["Other"], "US", 2020, "settled")]
    cases = spark.createDataFrame(rows, "case_id STRING, case_name STRING, parties ARRAY<STRING>, defendants ARRAY<STRING>, jurisdiction STRING, year INT, result STRING")
    perf = P.red_flags(P.defendant_performance(cases))
    r = {x.entity: x for x in perf.collect()}["Acme"]
    assert (r.n_cases, r.wins, r.sample_quality, r.weakest_segment, r.weakest_rate) == (10, 3, "limited", "FR", 0.0)
    assert r.trend == "declining" and r.timeline[0].year == 2020
    assert any(f.startswith("Critical weakness in FR: 0.0% vs overall 30.0%") for f in r.red_flags)
    recs = [x.priority for x in P.recommendations(perf).where("entity = 'Acme'").orderBy("rank").collect()]
    assert recs == ["URGENT", "SHORT_TERM", "MID_TERM"]
    with pytest.raises(ValueError):
        P.benchmark("nope", "win_rate_defendant")


# ---- entities and events ------------------------------------------------------------------

def test_name_resolution(spark):
    ents = spark.createDataFrame(
        [("acme", "Acme Robotics", "US", "corporation", "tech", None, ["ACME Robotics Inc."]), ("beta", "Beta Holdings Ltd", "GB", "npe", "tech", "acme", [])],
        "canonical_id STRING, canonical_name STRING, country_code STRING, entity_type STRING, industry STRING, parent_id STRING, aliases ARRAY<STRING>",
    )
    names = spark.createDataFrame([("Acme Robotics",), ("The ACME robotics, Corp.",), ("Acme Robotcs",), ("Zeta",)], "raw_name STRING")
    got = {r.raw_name: (r.canonical_id, r.match_level) for r in E.resolve_names(names, ents).collect()}
    assert got == {
        "Acme Robotics": ("acme", "exact"), "The ACME robotics, Corp.": ("acme", "normalized"), "Acme Robotcs": ("acme", "fuzzy"), "Zeta": (None, None),
    }
    terms = {(r.canonical_id, r.term) for r in E.search_terms_of(ents, group=True).collect()}
    assert ("acme", "Beta Holdings Ltd") in terms and ("beta", "Acme Robotics") in terms


def test_changes(spark, tmp_path):
    rows = [("s", "i", "US", 100.0, 1), ("s", "i", "US", 130.0, 2), ("s", "i", "US", 60.0, 3), ("s", "j", "US", 5.0, 1)]
    snaps = spark.createDataFrame(rows, "source_id STRING, indicator STRING, country_code STRING, value DOUBLE, at INT")
    got = [(r.severity, r.old_value, r.new_value) for r in EV.detect_changes(snaps, "at").orderBy("detected_at").collect()]
    assert got == [("warning", 100.0, 130.0), ("critical", 130.0, 60.0)]
    assert [(r.severity, r.new_value) for r in EV.latest_changes(snaps, "at").collect()] == [("critical", 60.0)]
    stats = spark.createDataFrame([("s", "i", "US", 1.0, 1), ("s", "i", "US", 2.0, 2)], "source STRING, indicator STRING, jurisdiction STRING, value DOUBLE, seq INT")
    EV.take_snapshot(stats, str(tmp_path / "snap"))
    assert [r.value for r in spark.read.parquet(str(tmp_path / "snap")).collect()] == [2.0]


def test_search_filters_years_before_it_cuts(spark):
    rows = [(f"c{i:04}", "Smith", "US", "smith " * (1 + i % 7), "2001-01-01" if i % 11 else "1990-01-01", 1, i) for i in range(300)]
    cases = spark.createDataFrame(rows, "case_id string, case_name string, jurisdiction string, full_text string, decision_date string, has_content int, importance_score int")
    missing = {c: F.lit(None).cast("string") for c in S.CASE_RESULT if c not in cases.columns}
    asked = spark.createDataFrame([(1, "smith", "ALL", 1990, 1990)], "qid int, query string, jurisdiction string, year_from int, year_to int")
    old = sum(i % 11 == 0 for i in range(300))
    assert S.search_cases(asked, cases.withColumns(missing), 1000).count() == old
    assert S.search_cases(asked, cases.withColumns(missing), 1000, prefilter=5).count() == 5
    everything = asked.withColumn("year_from", F.lit(None).cast("int")).withColumn("year_to", F.lit(None).cast("int"))
    assert S.search_cases(everything, cases.withColumns(missing), 100).count() == 100


def test_network_follows_any_depth_and_keeps_long_references(spark):
    chain = [(f"n{i}", f"n{i + 1}", f"ref {i}", "") for i in range(6)] + [("n0", None, "x" * 600 + e, "") for e in "ab"]
    edges = spark.createDataFrame(chain, "citing_case_id string, cited_case_id string, cited_reference string, citation_context string")
    cases = spark.createDataFrame([(f"n{i}", "", "", "", "") for i in range(7)], "case_id string, case_name string, jurisdiction string, court string, decision_date string")
    net = G.citation_network(cases.where("case_id = 'n0'").select("case_id"), edges, cases, depth=6)
    assert sorted((r.case_id, r.depth) for r in net.nodes.collect()) == [(f"n{i}", i) for i in range(7)]
    assert net.unresolved.count() == 2 and G.unresolved_references(edges).count() == 2


def test_all_dates_of_a_text_count(spark):
    text = " ".join(f"20{i:02}-01-0{1 + i % 9}" for i in range(1, 13))
    (n,) = spark.createDataFrame([(text,)], "t string").select(F.size(dates_in_text(F.col("t")))).first()
    assert n == 12


@pytest.mark.parametrize("k", [1, 5])
def test_blocks_give_the_rows_of_exhaustive_scoring_and_leave_common_words_unread(spark, tmp_path, k):
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(60)]
    rows = [
        (f"d{i:04}", " ".join(rnd.choices(words, k=2)), "the the " * rnd.randint(1, 9) + " ".join(rnd.choices(words, k=rnd.randint(1, 40))), rnd.choice(["US", "GB", None]))
        for i in range(1500)
    ]
    rows += [("e1", "rarest", "the rarest word of all", "GB"), ("e2", None, "the rarest", "US"), ("e3", "the", None, None)]
    docs = spark.createDataFrame(rows, "doc_id STRING, name STRING, body STRING, jurisdiction STRING")
    S.write_index(docs, "doc_id", "name", "body", str(tmp_path / "ix"), 4, ("jurisdiction",))
    index = S.read_index(spark, str(tmp_path / "ix"))
    BL.write_blocks(index, "doc_id", "jurisdiction", str(tmp_path / "blocks"), 4)
    asked = [(1, "the rarest", None), (2, "the w1 w2", "GB"), (3, "w3", "US"), (4, "the", None), (5, "unknown", None), (6, "rarest unknown the w9", "GB")]
    queries = spark.createDataFrame(asked, "qid INT, query STRING, scope STRING")
    found, reads = BL.top_any_word(queries, BL.read_blocks(spark, str(tmp_path / "blocks")), k, 4)
    scores = S.bm25_matches(
        queries.withColumnRenamed("scope", "jurisdiction"), docs, "doc_id", "name", "body", index=index, match_all=False, restrict=["jurisdiction"]
    ).collect()
    want = set()
    for q in {r.qid for r in scores}:
        best = sorted((-r.score, r.doc_id) for r in scores if r.qid == q)[:k]
        want |= {(q, i, d, round(-x, 6)) for i, (x, d) in enumerate(best, 1)}
    assert {(r.qid, r.position, r.doc_id, round(r.score, 6)) for r in found.collect()} == want
    if k == 1:
        alone = queries.where("qid = 1")
        _, reads = BL.top_any_word(alone, BL.read_blocks(spark, str(tmp_path / "blocks")), k, 4)
        common = {r.term: r for r in reads.collect()}["the"]
        assert common.blocks > 40 and common.blocks_read < common.blocks / 2


def test_a_query_that_lacks_a_term_pairs_nothing(spark):
    weighted = spark.createDataFrame(
        [(1, "common", 2, 0.1), (2, "common", 2, 0.1), (2, "rare", 2, 5.0)], "qid INT, term STRING, n_terms INT, idf DOUBLE"
    )
    assert [tuple(r) for r in S.rarest_terms(weighted).collect()] == [(2, "rare")]


def test_blocks_of_a_named_search_hold_the_asked_words_alone(spark, sf):
    from lexspark.plans.queries_text import _queries, case_blocks

    asked = _queries(spark, sf).select("qid", "query")
    words = {r.term for r in S.query_terms(asked).select("term").distinct().collect()}
    held = {r.term for r in case_blocks(spark, sf, "test_blocks", asked).terms.select("term").distinct().collect()}
    assert held and held <= words


def test_supplements_that_share_a_text_are_searched_once(spark):
    cases = spark.createDataFrame(
        [("c1", "Ash v. Oak", "US", "Court", "1990-01-01", None, None, None, 1.0, 1, "s", "birch"), ],
        "case_id STRING, case_name STRING, jurisdiction STRING, court STRING, decision_date STRING, case_type STRING, subject_area STRING, "
        "outcome STRING, importance_score DOUBLE, has_content INT, summary STRING, full_text STRING",
    )
    queries = spark.createDataFrame([(1, "elm fir", "US"), (2, "elm", None)], "qid INT, query STRING, jurisdiction STRING")
    texts = spark.createDataFrame([(7, "Elm", "a fir"), (8, "Elm Two", "pine"), (9, "", "elm fir")], "text_id BIGINT, case_name STRING, text STRING")
    places = spark.createDataFrame([(7, "US", 70), (7, "GB", 71), (8, "GB", 81), (9, "US", 90)], "text_id BIGINT, jurisdiction STRING, seq BIGINT")
    local = spark.createDataFrame([], "qid INT, case_name STRING, jurisdiction STRING, seq BIGINT")
    shared = S.search_case_law(queries, cases, places, local, texts=texts)
    plain = S.search_case_law(queries, cases, places.join(texts, "text_id").drop("text_id"), local)
    rows = sorted(tuple(r) for r in shared.collect())
    assert rows == sorted(tuple(r) for r in plain.collect())
    assert [(r[0], r[1], r[4]) for r in rows] == [(1, "Elm", 70), (2, "Elm", 70), (2, "Elm Two", 81)]


def test_network_edges_are_told_apart_where_their_seed_lies(spark):
    rnd = random.Random(5)
    ids = [f"n{i}" for i in range(30)]
    edges = spark.createDataFrame(
        [(a, b, f"to {b}", "") for a in ids for b in rnd.sample([*ids, "ghost"], 3)], "citing_case_id string, cited_case_id string, cited_reference string, citation_context string"
    )
    cases = spark.createDataFrame([(i, "", "", "", "") for i in ids], "case_id string, case_name string, jurisdiction string, court string, decision_date string")
    net = G.citation_network(cases.select("case_id"), edges, cases, max_nodes=6)

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert shuffles(net.walked) == shuffles(net.degrees) == shuffles(net.reached)
    nodes, hubs, seeds = net.nodes.collect(), net.hubs.collect(), [r.seed for r in net.edges.collect()]
    depths = {d: [r for r in nodes if r.depth == d] for d in {r.depth for r in nodes}}
    assert {tuple(r) for r in net.by_depth().select("depth", "nodes", "seeds", "first_node", "last_node").collect()} == {
        (d, len(rs), len({r.seed for r in rs}), min(r.case_id for r in rs), max(r.case_id for r in rs)) for d, rs in depths.items()
    }
    totals = {i: [r.cited_by_count for r in hubs if r.case_id == i] for i in {r.case_id for r in hubs}}
    assert {(r.case_id, r.networks, r.cited_by_total) for r in net.hub_totals().collect()} == {(i, len(n), sum(n)) for i, n in totals.items()}
    assert {(r.seed, r.edge_count) for r in net.summary(cases).collect()} == {(i, sum(s == i for s in seeds)) for i in ids}


def test_contexts_are_shuffled_only_for_ids_that_rows_share(spark):
    from lexspark.functions import citations as C

    schema = "doc_id INT, text STRING, jurisdiction STRING"
    one = [(i, f"See {i} U.S. {i + 1}. It overruled 12 U.S. 7 and 12 U.S. 7.", "US") for i in range(1, 30)]
    frame = C.extract_citations_with_context(spark.createDataFrame(one, schema))
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    alone = {(r.doc_id, r.citation_string): r for r in frame.collect()}
    assert len(alone) == frame.count() == 2 * len(one)
    # rows of one id, or of none, still give each string once: the least place, then the least context
    more = [(1, "12 U.S. 7 first", "US"), (None, "a 3 U.S. 4", "US"), (None, "3 U.S. 4 b", "GB"), (2, None, "US"), (3, one[2][1], "US")]
    rows = C.extract_citations_with_context(spark.createDataFrame(one + more, schema)).collect()
    got = {(r.doc_id, r.citation_string): r for r in rows}
    assert len(got) == len(rows) == len(alone) + 1
    assert {k: r for k, r in got.items() if k[0] not in (None, 1)} == {k: r for k, r in alone.items() if k[0] != 1}
    assert got[1, "1 U.S. 2"] == alone[1, "1 U.S. 2"] and got[1, "12 U.S. 7"].start == 0
    assert got[None, "3 U.S. 4"].context == "a 3 U.S. 4"


def test_a_treatment_that_is_known_is_graded_without_its_context(spark):
    cases = spark.createDataFrame([("a", "Supreme Court", "US"), ("b", "District Court", "US")], "case_id string, court string, jurisdiction string")
    edges = spark.createDataFrame([("a", "b", "r", "It was overruled.")], "citing_case_id string, cited_case_id string, cited_reference string, citation_context string")
    graded = V.case_validity(V.with_treatment(edges), cases)
    assert sorted(map(tuple, graded.collect())) == sorted(map(tuple, V.case_validity(edges, cases).collect()))
    known = edges.withColumn("citation_context", F.lit(None).cast("string")).withColumn("treatment", F.lit("overruling"))
    assert {r.case_id: r.overruling_count for r in V.case_validity(known, cases).collect()} == {"a": 0, "b": 1}


def test_network_totals_in_waves_keep_nothing_but_totals(spark, monkeypatch):
    from pathlib import Path

    from lexspark.session import shared_folder

    rnd = random.Random(8)
    ids = [f"n{i:02}" for i in range(40)]
    rows = [(a, b, f"to {b}", "") for a in ids for b in rnd.sample([*ids, "ghost"], 3)] + [(a, None, f"lost {a[-1]}", "c") for a in ids[::3]]
    edges = spark.createDataFrame(rows, "citing_case_id string, cited_case_id string, cited_reference string, citation_context string")
    cases = spark.createDataFrame([(i, "", "", "", "") for i in ids], "case_id string, case_name string, jurisdiction string, court string, decision_date string")
    net = G.citation_network(cases.select("case_id"), edges, cases, max_nodes=8)
    totals = {"summary": lambda: net.summary(cases), "by_depth": net.by_depth, "hub_totals": net.hub_totals}
    whole = {k: sorted(map(tuple, t().collect())) for k, t in totals.items()}
    nodes, gone = net.nodes.collect(), net.unresolved.collect()
    assert {r[0]: (r[1], r[3]) for r in whole["summary"]} == {i: (sum(r.seed == i for r in nodes), sum(r.seed == i for r in gone)) for i in ids}
    monkeypatch.setattr(G, "WAVE_SEEDS", 9)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    for name, total in totals.items():
        before = set(folder.iterdir())
        assert sorted(map(tuple, total().collect())) == whole[name]
        # of the five waves the totals are left, the rounds are not
        assert len(set(folder.iterdir()) - before) == 5


def test_names_that_share_a_word_are_cut_where_each_part_stays_rare(spark):
    rnd = random.Random(6)
    names = ["northern " + "".join(rnd.choices("0123456789abcdef", k=9)) for _ in range(200)]
    cut = M.balanced_segments(spark.createDataFrame([(x,) for x in set(names)], "text STRING"), 0.85).collect()
    assert all([s.segment for s in r.segments] == [r.text[:13], r.text[13:]] and r.edits == 3 for r in cut) and len(cut) == len(set(names))
