import importlib

import pytest

SF = "/root/testdata/sf0.001"
entry = importlib.import_module("__spark_entry__")


def test_names_agree():
    assert entry.oracle_sql().keys() <= entry.queries().keys() and len(entry.queries()) > 40


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["topk_cosine", "multi_vector_search", "late_interaction_search", "maxsim_padded", "delete_documents", "insert_batches", "search_and_rerank", "index_documents_pooled", "indexing_report", "chunk_insert", "text_search", "pool_documents", "recorded_hits_merged", "latency_quantiles"])
def test_query_equals_its_sql(spark, name):
    import os

    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    flat = lambda x: sorted(tuple("" if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in x[key].itertuples(index=False))
    assert flat(got) == flat(want)
