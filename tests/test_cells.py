import numpy as np

from vecmill.operators import knn
from vecmill.operators.cells import CellIndex
from vecmill.session import new_path


def test_index(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    v = centres[rng.integers(0, 20, 1500)] + 0.2 * rng.normal(size=(1500, 8))
    rows = [(i, x.tolist(), "a") for i, x in enumerate(v)] + [(2000, None, "b"), (2001, [0.0] * 8, "c"), (2002, [1.0], "d"), (2003, [None] + [1.0] * 7, "e")]
    df = spark.createDataFrame(rows, "row_id long, v array<float>, vector string")
    queries = df.where("row_id % 50 = 0").selectExpr("row_id as query_id", "v")
    index = CellIndex.build(df, new_path(spark, "cells"), "v", 8, ["row_id"], ["vector"], cell_rows=100)
    assert len(index.centroids) == 15
    want = {(r.query_id, r.row_id, r.similarity) for r in knn.knn_join(queries, df, 5, "v", 8, ["row_id"], query_vector="v").collect()}
    exact = {(r.query_id, r.row_id, r.similarity) for r in index.search(queries, 5, 99, query_vector="v").collect()}
    assert exact == want
    near = {(r.query_id, r.row_id, r.similarity) for r in CellIndex(spark, index.path).search(queries, 5, 3, query_vector="v", block_rows=7).collect()}
    assert len(near & want) >= 0.9 * len(want)
    plan = index.search(queries.limit(1), 5, 2, query_vector="v")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "__cell" in plan
    empty = CellIndex.build(df.limit(0), new_path(spark, "cells"), "v", 8, ["row_id"])
    assert empty.search(queries, 5, query_vector="v").count() == 0 and index.search(queries.limit(0), 5, query_vector="v").count() == 0


def test_a_dense_cell_is_cut_into_pieces(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=8) + 1e-4 * rng.normal(size=(900, 8)), rng.normal(size=(300, 8))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "row_id long, v array<float>")
    index = CellIndex.build(df, new_path(spark, "cells"), "v", 8, ["row_id"], cell_rows=600, piece_rows=100)
    files = spark.read.parquet(f"{index.path}/rows").selectExpr("__cell", "input_file_name() as f").groupBy("__cell").agg({"f": "approx_count_distinct"}).collect()
    assert index.search(df.limit(3).selectExpr("row_id as query_id", "v"), 5, 99, query_vector="v").count() == 15
    assert len(files) >= 1 and spark.read.parquet(f"{index.path}/rows").count() == 1200
