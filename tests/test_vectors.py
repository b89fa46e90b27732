import math

import pytest
from pyspark.sql import functions as F

from vecmill.functions import params, vectors


@pytest.mark.parametrize(
    ("k", "coefficients", "value"),
    [(0, (10, 2, 0.5), 0), (-5, (10, 2, 0.5), 0), (1, (10, 2, 0.5), 12), (10, (10, 2, 0.5), 41), (100, (10, 2, 0.5), 440), (10, (-10, 2, 0.5), 21)]
    + [(k, params.TOKENS, v) for k, v in {1: 105, 3: 123, 5: 137, 10: 170, 100: 513, 500: 996, 900: 934}.items()]
    + [(k, params.CANDIDATES, v) for k, v in {1: 9, 3: 12, 5: 14, 10: 20, 100: 119, 500: 559, 900: 996}.items()],
)
def test_expand_parameter(k, coefficients, value):
    assert params.expand_parameter(k, *coefficients) == value


def test_expanded_column_equals_function(spark):
    df = spark.createDataFrame([(k,) for k in [None, -3, 0, 1, 7, 500]], "k int").select("k", params.expanded(F.col("k"), *params.TOKENS).alias("v"))
    assert {r.k: r.v for r in df.collect()} == {None: None} | {k: params.expand_parameter(k, *params.TOKENS) for k in (-3, 0, 1, 7, 500)}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], [0.5, 0.5]), (1, [0.0, 0.0], [1.0, 0.0]), (2, [nan, 1.0], [1.0, 0.0]), (3, [inf, 1.0], [1.0, 0.0]),
        (4, None, [1.0, 0.0]), (5, [1.0], [1.0, 0.0]), (6, [1.0, None], [1.0, 0.0]), (7, [-2.0, 0.0], [3.0, 0.0]),
    ]
    a, b = F.col("a"), F.col("b")
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>").select("i", vectors.cosine(a, b).alias("c"), vectors.dot(a, b).alias("d"), vectors.usable(a, 2).alias("u"), vectors.normalize(a).alias("n"), vectors.cosine_distance(a, b).alias("e"))
    got = {r.i: r for r in df.collect()}
    assert math.isclose(got[0].c, math.sqrt(0.5), rel_tol=1e-12) and math.isclose(got[0].e, 1 - math.sqrt(0.5), rel_tol=1e-12)
    assert [got[i].c for i in (1, 2, 3)] == [0, 0, 0] and [got[i].c for i in (4, 5, 6)] == [None, None, None]
    assert got[7].c == -1 and got[7].d == -6
    assert [got[i].u for i in range(8)] == [True, True, True, True, False, False, False, True]
    assert got[7].n == [-1, 0] and got[2].n == [0, 0]
    with pytest.raises(ValueError):
        vectors.similarity(a, b, "euclidean")
