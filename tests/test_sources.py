import json

import pytest
from pyspark.sql import functions as F

from lexspark.sources import blocks as B
from lexspark.sources import corpus as C
from lexspark.sources import landing as L
from lexspark.sources import links as K
from lexspark.streaming.landing import RAW_DDL, compact_store, read_landing, read_store, upsert_stream


def _links(spark, url, html, **kw):
    pages = spark.createDataFrame([(1, url, html)], "page_id INT, url STRING, html STRING")
    return [r.asDict() for r in K.extract_links(pages, **kw).orderBy("position").collect()]


def test_anchor_profile(spark):
    html = '<a class="x" href="/za/cases/ZASCA/2019/1.html"> A &amp; <b>B</b>\n v C&eacute; </a><a href="/za/cases/X/2020/2.html">abc</a><a href="/other.html">Long title</a>'
    (row,) = _links(spark, "https://www.saflii.org/x", html)
    assert (row["title"], row["court"], row["year"], row["jurisdiction"]) == ("A & B v Cé", "ZASCA", 2019, "ZA")
    assert row["source_url"] == "https://www.saflii.org/za/cases/ZASCA/2019/1.html"


def test_tiers_and_skips(spark):
    one = _links(spark, "https://www.riigiteataja.ee/en/", '<a href="/en/faq">Questions</a><a href="/en/acts">All acts</a>')
    assert [(r["tier"], r["title"]) for r in one] == [(3, "All acts")]
    two = _links(spark, "https://www.riigiteataja.ee/en/", '<a href="/en/eli/1">Act one</a><a href="/en/acts">All acts</a>')
    assert [(r["tier"], r["title"]) for r in two] == [(2, "Act one")]


def test_special_anchors_and_context_year(spark):
    ph = _links(spark, "https://lawphil.net/", '<area shape="x" title="Republic Acts" id="1" href="https://lawphil.net/statutes/ra.html">')
    assert [(r["title"], r["href"]) for r in ph] == [("Republic Acts", "https://lawphil.net/statutes/ra.html")]
    at = _links(spark, "https://www.ris.bka.gv.at/e", '<a href="/eli/bgbl/1" class="y" title="Gesetz  eins">x</a>')
    assert at[0]["title"] == "Gesetz eins"
    ke = _links(spark, "https://new.kenyalaw.org/j", "<p>2001</p>" + "x" * 300 + '<a href="/judgments/1">Republic v A</a> decided 2015 ' + "y" * 300 + " 1990")
    assert ke[0]["year"] == 2015
    icj = _links(spark, "https://www.icj-cij.org/l", '1999 <a href="case/7">Some long case title</a> <td>2003</td>')
    assert (icj[0]["year"], icj[0]["court"]) == (2003, "International Court of Justice")
    cs = _links(spark, "https://www.courts.go.jp/s", '<a href="/a">統計 2020</a><a href="/b">別</a><a href="/c.pdf">資料</a>')
    assert [r["href"] for r in cs if r["profile"] == "court_stats"] == ["/a", "/c.pdf"]
    us = _links(spark, "https://uscode.house.gov/", '<a href="/view.xhtml?x">§ 1</a><a href="/view.xhtml?x">§ 1 again</a>')
    assert [r["title"] for r in us] == ["§ 1"]
    assert len(_links(spark, "https://lovdata.no/", '<a href="/lov/1">abc</a>' * 5, row_limit=2)) == 2


def test_label_table_last_value_wins(spark):
    html = "<tr><td>A:</td><td>1</td></tr><tr><td><b>A</b></td><td> 2 </td></tr><tr><td>B</td><td></td></tr>"
    row = spark.createDataFrame([(html,)], "h STRING").select(B.label_table(F.col("h")).alias("m")).first()
    assert row.m == {"A": "2"}


def test_json_lists(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"law_name": "A", "article": "1"}, {"law_name": "B"}]), encoding="utf-8")
    bad.write_text('{"law_name": "A"}', encoding="utf-8")
    assert [r.law_name for r in C.read_list(spark, str(good), C.STATUTES_DDL).collect()] == ["A", "B"]
    assert C.read_list(spark, str(bad), C.STATUTES_DDL, strict=False).collect() == []
    with pytest.raises(Exception, match="list"):
        C.read_list(spark, str(bad), C.STATUTES_DDL).collect()


def test_corpus_round_trip_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("US", 1), ("GB", 2)], "jurisdiction STRING, n INT")
    C.write_corpus(df, str(tmp_path / "c"))
    one = C.read_table(spark, str(tmp_path / "c"), "US")
    assert [r.n for r in one.collect()] == [1]
    assert "PartitionFilters: [isnotnull(jurisdiction" in one._jdf.queryExecution().executedPlan().toString()


def _raw(seq, text, name, **extra):
    base = dict(id="7", case_id=None, source_url=None, case_name=name, case_number=None, court="c", decision_date="2020", text=text,
                full_text=None, plain_text=None, summary=None, language=None, extra=extra, jurisdiction="US", adapter="a", seq=seq)
    return base


def test_upsert_rule_and_idempotence(spark):
    def landed(*rows):
        return L.landed_cases(spark.createDataFrame([tuple(r.values()) for r in rows], RAW_DDL))

    old, new = landed(_raw(1, "long text", "First", k="v")), landed(_raw(2, "short", "Second", z="", y="1"), _raw(3, "same size", "Third"))
    once = L.upsert_cases(old, new)
    (row,) = once.collect()
    assert (row.case_id, row.case_name, row.full_text, row.raw_metadata) == ("US:7", "First", "long text", "{}")
    again = L.upsert_cases(once.select(*new.columns), new).collect()
    assert [(r.case_name, r.full_text) for r in again] == [("First", "long text")]


def test_store_rewrites_only_touched_buckets_and_replays_change_nothing(spark, tmp_path):
    from pathlib import Path

    from lexspark.sources import store as ST

    def landed(ids, text, at, seq):
        rows = [tuple(dict(_raw(seq + i, text * (1 + i % 3), f"name {text}"), id=str(i)).values()) for i in ids]
        return L.landed_cases(spark.createDataFrame(rows, RAW_DDL), F.lit(at))

    def files():
        return {str(f): f.stat().st_mtime_ns for f in Path(store).rglob("*.parquet")}

    store = str(tmp_path / "store")
    ST.create_store(landed(range(400), "first", "2024-01-01", 0), store, 32)
    before = files()
    batch = landed([3, 7, 200, 900], "second batch", "2024-02-01", 10_000)
    touched = ST.merge_cases(spark, store, batch, 32)
    assert 1 <= len(touched) <= 4
    kept = {f: t for f, t in before.items() if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    after = files()
    assert len(kept) >= 20 and all(after[f] == t for f, t in kept.items())
    rows = {r.case_id: r for r in ST.read_cases(spark, store).collect()}
    assert len(rows) == 401
    assert (rows["US:3"].case_name, rows["US:3"].full_text, rows["US:3"].crawled_at, rows["US:3"].updated_at) == ("name first", "second batch", "2024-01-01", "2024-02-01")
    assert (rows["US:900"].crawled_at, rows["US:4"].updated_at) == ("2024-02-01", "2024-01-01")
    ST.merge_cases(spark, store, batch, 32)
    assert {r.case_id: r for r in ST.read_cases(spark, store).collect()} == rows
    assert ST.merge_cases(spark, store, batch.limit(0), 32) == []


def test_case_id_sources(spark):
    rows = [dict(_raw(1, "t", "n"), id="", case_id="c9"), dict(_raw(2, "t", "n"), id=None, source_url="http://x"), dict(_raw(3, "t", "n"), id=None)]
    ids = [r.case_id for r in L.landed_cases(spark.createDataFrame([tuple(r.values()) for r in rows], RAW_DDL)).collect()]
    assert ids[:2] == ["US:c9", "US:http://x"] and len(ids[2]) == len("US:") + 64


def test_landing_stream(spark, tmp_path):
    landing, store, target = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "compact")
    landing.mkdir()
    (landing / "1.json").write_text(json.dumps(_raw(1, "first text, long", "First")), encoding="utf-8")

    def run():
        q = upsert_stream(read_landing(spark, str(landing)), store, str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    (landing / "2.json").write_text(json.dumps(_raw(1, "later", "Later", k="v")), encoding="utf-8")
    run()
    (row,) = read_store(spark, store).collect()
    assert (row.case_name, row.full_text, row.raw_metadata) == ("First", "first text, long", '{"k":"v"}')
    compact_store(spark, store, target)
    assert read_store(spark, target).count() == 1
    # a stream with a new checkpoint starts at batch 0 and must leave the base alone
    (landing / "3.json").write_text(json.dumps(_raw(2, "another text", "Second") | {"id": "8"}), encoding="utf-8")
    again = upsert_stream(read_landing(spark, str(landing)), target, str(tmp_path / "ck2")).trigger(availableNow=True).start()
    again.awaitTermination(120)
    assert sorted(r.case_name for r in read_store(spark, target).collect()) == ["First", "Second"]
