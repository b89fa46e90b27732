import numpy as np
import pytest

from vecmill.operators import late

E1, E2, E3 = [1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]
ZERO, NAN = [0.0] * 4, [float("nan")] * 4


def run(spark, query, docs):
    q = spark.createDataFrame([(1, i, [float(x) for x in v]) for i, v in enumerate(query)], "query_id long, position int, token_embedding array<float>")
    t = spark.createDataFrame([(d, f"{d}{i}", [float(x) for x in v]) for d, vs in docs.items() for i, v in enumerate(vs)], "doc_id string, token_id string, token_embedding array<float>")
    return {r.doc_id: r.score for r in late.maxsim(q, t, 4).collect()}


@pytest.mark.parametrize(
    ("query", "docs", "scores"),
    [
        ([E1, E2, E3], {"a": [E1, ZERO, [0, 0, 0.5, 0.5]]}, {"a": 1.707106781}),
        ([E1, E2], {"a": [E1, ZERO], "b": [ZERO, E2], "c": [[0.7, 0.7, 0, 0]]}, {"a": 1, "b": 1, "c": 1.414213562}),
        ([E1, E2], {"a": [E1, E2, E3], "b": [E1]}, {"a": 2, "b": 1}),
        ([E1, E2], {"a": [ZERO, ZERO, ZERO]}, {"a": 0}),
        ([E1, E2], {"a": [NAN, E1], "b": [[float("inf"), 0, 0, 0]]}, {"a": 1, "b": 0}),
        ([E1], {"a": [[-1, 0, 0, 0]], "b": [[-1, 0, 0, 0]] * 2}, {"a": 0, "b": -1}),
        ([E1], {"a": [[-1, 0, 0, 0]]}, {"a": -1}),
    ],
)
def test_maxsim(spark, query, docs, scores):
    got = run(spark, query, docs)
    assert got.keys() == scores.keys() and all(abs(got[d] - s) < 1e-6 for d, s in scores.items())


def test_two_stages_without_limits_equal_exhaustive_maxsim_and_padding(spark):
    rng = np.random.default_rng(5)
    docs = {f"d{i}": rng.normal(size=(int(rng.integers(1, 6)), 4)) for i in range(12)}
    query = rng.normal(size=(3, 4))
    longest = max(map(len, docs.values()))
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for d, v in docs.items():
        padded = np.concatenate([unit(v.astype(np.float32).astype(float)), np.zeros((longest - len(v), 4))])
        want[d] = float((unit(query.astype(np.float32).astype(float)) @ padded.T).max(axis=1).sum())
    q = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(query)], "query_id long, position int, token_embedding array<float>")
    t = spark.createDataFrame([(d, f"{d}{i}", v.tolist()) for d, vs in docs.items() for i, v in enumerate(vs)], "doc_id string, token_id string, token_embedding array<float>")
    pages = spark.createDataFrame([("d1", 1, "one"), ("d1", 2, "two"), ("d2", None, None), (None, 1, "x")], "doc_id string, page_number int, content string")
    got = late.search(q, t, pages, 4, k=12, n_tokens=1000, n_candidates=1000).orderBy("rank").collect()
    assert [r.doc_id for r in got] == sorted(want, key=lambda d: (-round(want[d], 9), d))
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)
    assert {r.doc_id: r.content for r in got}["d1"] == "two" and {r.doc_id: r.content for r in got}["d2"] == ""
    assert late.search(q, t.limit(0), pages, 4).count() == 0 and late.search(q.limit(0), t, pages, 4).count() == 0
    with pytest.raises(ValueError):
        late.search(q, t, pages, 4, k=0)


def test_candidates_add_up_best_hits(spark):
    hits = spark.createDataFrame([(1, 0, "a", 0.5), (1, 0, "a", 0.9), (1, 1, "a", 0.2), (1, 1, "b", 1.1), (1, 0, "c", 1.1)], "query_id long, position int, doc_id string, similarity double")
    assert [(r.doc_id, r.stage1_score) for r in late.candidates(hits, 3).orderBy("candidate_rank").collect()] == [("a", 1.1), ("b", 1.1), ("c", 1.1)]
