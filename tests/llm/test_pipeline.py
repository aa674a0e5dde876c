import corpus_pipeline
import __spark_entry__ as entry

NAMES = ["op1_", "op2_", "op3_", "op4_", "op5_", "op6_", "op7_", "op8_", "op9_", "op10_", "pipeline"]


def test_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(x) for n in names) == 1 for x in NAMES)


def test_pipeline(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = corpus_pipeline.run(spark, sf)
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept)) and set(documents.columns) <= set(out.columns)
    junk = [i for i, q in labels.items() if q == 0]
    assert sum(i in set(kept) for i in junk) <= 0.2 * len(junk)
    assert 0.5 * documents.count() < len(kept) < documents.count()


def test_stages_on_odd_rows(spark, odd, none, sf):
    for docs in (odd, none):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars", "score", "a")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert set(docs.columns) <= set(out.columns) if name == corpus_pipeline.STAGES[-1][0] else out.columns == docs.columns
            assert out.count() <= docs.count()
