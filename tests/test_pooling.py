import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecmill.operators import pooling

# The vectors and counts of FIXTURES.md 6.
FIXTURE = np.array([[1, 0, 0, 0], [0.98, 0.1, 0.1, 0.1], [0.96, 0.2, 0.1, 0.1], [0, 1, 0, 0], [0.1, 0.98, 0.1, 0.1], [0, 0, 1, 0], [0, 0, 0, 1], [0.2, 0.2, 0.2, 0.9], [0.5, 0.5, 0.5, 0.5], [0.4, 0.6, 0.4, 0.4]])
FIXTURE = FIXTURE / np.linalg.norm(FIXTURE, axis=1, keepdims=True)


def rows(n, seed=0):
    v = np.random.default_rng(seed).normal(size=(n, 4))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize(("distance", "count"), [(0, 10), (-1, 10), (0.01, 9), (0.03, 6), (0.05, 6), (0.1, 5), (0.5, 4)])
def test_query_pooling(distance, count):
    out = pooling.pool_query(FIXTURE, distance)
    assert len(out.vectors) == count and np.allclose(np.linalg.norm(out.vectors, axis=1), 1)


def test_query_pooling_guards():
    assert len(pooling.pool_query(FIXTURE, 0.5, 10).vectors) == 10
    assert pooling.pool_query(FIXTURE, 5.0, 3).stats["reason"]


@pytest.mark.parametrize(("n", "factor", "protected", "least", "lo", "hi"), [(50, 1, 0, 4, 50, 50), (50, 2, 0, 4, 20, 30), (30, 2, 0, 4, 12, 18), (50, 10, 0, 4, 2, 8), (50, 25, 0, 20, 50, 50), (3, 2, 0, 4, 3, 3), (8, 5, 4, 4, 8, 8)])
def test_document_pooling(n, factor, protected, least, lo, hi):
    out = pooling.pool_document(rows(n), factor, least, protected)
    assert lo <= len(out.vectors) <= hi and out.stats["pooled"] == len(out.vectors)


def test_protected_tokens_come_last_and_cost_ratio():
    v = rows(40)
    a, b = pooling.pool_document(v, 4, 4, 15), pooling.pool_document(v, 4, 4, 0)
    assert len(a.vectors) > len(b.vectors) and np.allclose(a.vectors[-15:], v[:15])
    with pytest.raises(ValueError):
        pooling.pool_document(v, 2.5)


@settings(max_examples=25, deadline=None)
@given(st.integers(5, 20), st.integers(0, 10**6))
def test_ward_equals_least_variance_growth(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    groups = [[i] for i in range(n)]
    cost = lambda g: ((x[g] - x[g].mean(axis=0)) ** 2).sum()
    while len(groups) > n // 2:
        _, i, j = min((cost(a + b) - cost(a) - cost(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    for label in (pooling.agglomerate(np.linalg.norm(x[:, None] - x[None], axis=2), "ward", n // 2), pooling.ward(x, n // 2)):
        assert {frozenset(np.flatnonzero(label == c)) for c in set(label)} == {frozenset(g) for g in groups}


def test_profiles_need_no_matrix():
    """Clusters of the profiles, as rows of one distance for each token, are those found in as many numbers as a token has."""
    v = rows(60, 3)
    profile = 1 - v @ v.T
    label = pooling.agglomerate(np.linalg.norm(profile[:, None] - profile[None], axis=2), "ward", 30)
    want = {tuple(np.round(v[label == c].mean(axis=0), 9)) for c in set(label)}
    assert {tuple(np.round(x, 9)) for x in pooling.pool_document(v, 2).vectors} == want


def test_a_long_document_pools_in_little_memory():
    import tracemalloc

    v = rows(5000, 4)
    tracemalloc.start()
    out = pooling.pool_document(v, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out.vectors) == 2500 and sum(out.stats["cluster_sizes"]) == 5000 and peak < 20e6  # a matrix of distances has 200 MB


def test_frames(spark):
    data = [("a", f"t{i:02d}", v.tolist()) for i, v in enumerate(rows(20))] + [("b", "t", [1.0, 0.0, 0.0, 0.0]), ("b", "u", None), ("b", "v", [float("nan")] * 4), (None, "w", [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "doc_id string, token_id string, token_embedding array<float>")
    got = {r.doc_id: (r.original, r.pooled) for r in pooling.pool_documents(df, 4).groupBy("doc_id").agg({"n_original": "max", "position": "count"}).toDF("doc_id", "original", "pooled").collect()}
    assert got == {"a": (20, 10), "b": (1, 1)}
    assert pooling.pooling_summary(pooling.pool_documents(df, 4)).first().total_reduction == pytest.approx(21 / 11)
    assert pooling.pool_documents(df.limit(0), 4).count() == 0
    each = {r.doc_id: r for r in pooling.pooling_statistics(pooling.pool_documents(df, 4)).collect()}
    assert each["a"].ratio == 2 and each["a"].largest_cluster >= 2 and each["b"].largest_cluster == 1
    q = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(FIXTURE)], "query_id long, position int, token_embedding array<float>")
    assert pooling.pool_queries(q, 4, 0.05).count() == 6
