import duckdb
import pytest

import __spark_entry__ as entry
from lexspark.plans.views import TABLES
from scripts.check_oracle import table

CHECKED = [
    "case_validity", "citing_cases", "case_importance", "resolve_citations", "classification_stats", "citation_network", "bm25_search", "search_cases",
    "extract_citations", "defendant_performance", "dispute_search", "legal_risk", "resolve_names", "detect_changes", "extract_links", "upsert_cases",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    rel = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in rel.description]
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, rel.fetchall())


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 120


def test_entry(spark):
    assert entry.entry(spark).count() == 1500
