import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecmill.operators import knn, multivector
from vecmill.sources.schema import VectorColumn

NAN = float("nan")


def brute(table, query, k):
    """(similarity, id) best first; table: {id: vector}."""
    q = np.array(query)
    scored = []
    for i, v in table.items():
        if v is None or len(v) != len(q) or any(x is None for x in v):
            continue
        v = np.array(v, float)
        a, b = np.linalg.norm(v), np.linalg.norm(q)
        scored.append((-(round(float(v @ q / (a * b)), 9) if a > 0 and np.isfinite(a) and b > 0 else 0.0), i))
    return [(i, -s + 0.0) for s, i in sorted(scored)[:k]]


def test_knn_join_on_dirty_rows(spark):
    table = {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [NAN, 1.0], 4: None, 5: [1.0], 6: [1.0, None], 7: [2.0, 0.0], 8: [0.0, 1.0], 9: [-1.0, 0.0]}
    df = spark.createDataFrame(list(table.items()), "row_id long, v array<float>").withColumn("hit_x", F.lit("extra"))
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (None, [1.0, 0.0])], "query_id long, vector array<double>")
    got = knn.knn_join(queries, df, 4, "v", 2, ["row_id"], ["hit_x"], block_rows=2).orderBy("query_id", "hit_rank").collect()
    assert {r.query_id for r in got} == {1, 2}
    for q, v in ((1, [1.0, 0.1]), (2, [0.0, 0.0])):
        assert [(r.row_id, r.similarity) for r in got if r.query_id == q] == brute(table, v, 4)
    assert knn.knn_join(queries, df.limit(0), 4, "v", 2, ["row_id"]).count() == 0
    assert knn.knn_join(queries.limit(0), df, 4, "v", 2, ["row_id"]).count() == 0
    with pytest.raises(ValueError):
        knn.knn_join(queries, df, 0, "v", 2, ["row_id"])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(-2, 2), min_size=3, max_size=3), min_size=1, max_size=40), st.integers(1, 8))
def test_top_k_equals_brute_force(spark, rows, k):
    table = {i: [float(x) for x in v] for i, v in enumerate(rows)}
    df = spark.createDataFrame(list(table.items()), "row_id long, v array<float>").repartition(3)
    got = knn.top_k(df, [1.0, 2.0, -1.0], k, "v", ["row_id"]).collect()
    assert [(r.row_id, r.similarity) for r in got] == brute(table, [1.0, 2.0, -1.0], k)


def test_filter_comes_first_and_projection(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 3, None if i == 4 else "x") for i in range(12)], "row_id long, v array<float>, g int, t string")
    for where in ({"g": 1}, "g = 1", F.col("g") == 1):
        got = knn.top_k(df, [1.0, 0.0], 3, "v", ["row_id"], where, ["t"])
        assert got.columns == ["t", "row_id", "similarity", "hit_rank"] and [r.row_id for r in got.collect()] == [10, 7, 4]
    assert [r.row_id for r in knn.top_k(df, [1.0, 0.0], 3, "v", ["row_id"], {"t": None}).collect()] == [4]
    assert [r.row_id for r in knn.top_k(df, [1.0, 0.0], 9, "v", ["row_id"], {"row_id": [2, 3]}).collect()] == [3, 2]


def test_merge_with_provenance(spark):
    hits = [("embeddings1", 0, ["id1", "id2", "id3"], [0.9, 0.8, 0.7]), ("embeddings2", 1, ["id2", "id3", "id4"], [0.85, 0.75, 0.65])]
    rows = [(1, i, c, r + 1, s, r, name) for c, i, ids, ss in hits for r, (name, s) in enumerate(zip(ids, ss, strict=True))]
    df = spark.createDataFrame(rows, "query_id long, column_index int, column_name string, hit_rank int, similarity double, row long, id string")
    got = multivector.merge_hits(df).orderBy("position").collect()
    assert [(r.id, r.similarity) for r in got] == [("id1", 0.9), ("id2", 0.8), ("id3", 0.7), ("id4", 0.65)]
    assert [tuple(s) for s in got[1].source_columns] == [("embeddings1", 2, 0.8), ("embeddings2", 1, 0.85)]
    assert len(got[0].source_columns) == 1


def test_null_ids_leave_gaps_and_columns_are_checked(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, None, [0.9, 0.1]), (3, "c", [0.8, 0.3])], "row_id long, chunk_id string, v array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, v array<double>")
    columns = [VectorColumn.precomputed("v", 2)]
    assert [(r.id, r.hit_rank) for r in multivector.column_hits(asked, df, columns).orderBy("hit_rank").collect()] == [("a", 1), ("c", 3)]
    for bad in ("w", []):
        with pytest.raises(ValueError):
            multivector.search(asked, df, columns, bad)


def test_rerank(spark):
    hits = spark.createDataFrame([(1, "a", "red fox"), (1, "b", "red red"), (1, "c", None), (2, "d", "x"), (3, "e", "x")], "query_id long, id string, content string")
    asked = spark.createDataFrame([(1, "Red fox!"), (2, None), (1, "Red fox!")], "query_id long, query string")
    got = multivector.rerank(hits, asked, limit=2).orderBy("query_id", "rerank_rank").collect()
    assert [(r.query_id, r.id, r.rerank_score) for r in got] == [(1, "a", 1.0), (1, "b", 0.5), (2, "d", 0.0)]
    assert multivector.rerank(hits.limit(0), asked).count() == 0
    with pytest.raises(ValueError):
        multivector.search_and_rerank(asked, hits, [], score=None)


def test_rerank_keeps_hits_without_query_text(spark):
    hits = spark.createDataFrame([(1, "a", "red red"), (1, "b", "red fox"), (2, "c", "x"), (3, "e", "x"), (3, "d", "red fox"), (None, "f", "x")], "query_id long, id string, content string")
    asked = spark.createDataFrame([(1, "Red fox!"), (2, None), (None, "x")], "query_id long, query string")
    want = [(None, "f", 0.0, 1), (1, "b", 1.0, 1), (1, "a", 0.5, 2), (2, "c", 0.0, 1), (3, "d", 0.0, 1), (3, "e", 0.0, 2)]
    for score in (multivector.lexical_overlap, lambda q, c: F.length(q) * 0 + multivector.lexical_overlap(q, c)):  # the second has no score for null
        got = multivector.rerank(hits, asked, score, keep=True).orderBy("query_id", "rerank_rank").collect()
        assert [(r.query_id, r.id, r.rerank_score, r.rerank_rank) for r in got] == want
    assert len(multivector.rerank(hits, asked, keep=True, limit=1).collect()) == 4
