"""A sample of the registered queries against their SQL on the smallest given tables."""

import os

import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SAMPLE = (
    "a4_competitor_urls", "a13_stage_latest", "b2_page_title", "c5_ngram_counts", "c6_tfidf_top_terms",
    "d1_scraping_artifact", "e1_intent", "f12_opportunity", "g7_entity_cooccurrence", "h1_suggest_validate",
    "i3_competitor_overlap", "j1_extract_entities", "k7_bilingual_query", "l1_information_gain", "o12_content_brief",
)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("given tables not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(contract.oracle_sql()[name])
    names = [c[0] for c in result.description]
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in columns) for r in result.fetchall())))
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert got == want


def test_every_statement_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
