"""Exact nearest neighbours of a stated set of queries: the queries are broadcast in bounded blocks, every task keeps its k best."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Similarities are rounded to so many decimals before they are ranked: equal vectors are then equally similar whatever the plan.
DECIMALS = 9


def vectors_of(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which values are vectors of `dim` elements without nulls, and these as double rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(size == dim)
    flat = column.take(pa.array(right)).flatten()
    v = pc.cast(flat, pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    if flat.null_count:
        whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
        right, v = right[whole], v[whole]
    return right, v


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows whose norm is zero, NaN or infinite become zeros."""
    with np.errstate(all="ignore"):
        n = np.sqrt(np.einsum("ij,ij->i", v, v))
    good = (n > 0) & np.isfinite(n)
    return np.where(good[:, None], v, 0) / np.where(good, n, 1)[:, None]


def prepared(v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return unit_rows(v)
    if metric == "dot_product":
        return np.where(np.isfinite(v).all(axis=1)[:, None], v, 0)
    raise ValueError(f"unknown metric {metric}")


def blocks_of(queries: DataFrame, rows: int) -> Iterator[pa.Table]:
    """The queries, a bounded block at a time: one Arrow table where they fit in a block, else one partition after the other."""
    first = queries.limit(rows + 1).toArrow()
    if first.num_rows <= rows:
        yield first
        return
    block: list[dict] = []
    for row in queries.toLocalIterator():
        block.append(row.asDict())
        if len(block) == rows:
            yield pa.Table.from_pylist(block, first.schema)
            block = []
    if block:
        yield pa.Table.from_pylist(block, first.schema)


def survivors(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k largest scores of each query (rows x queries -> by query); of equal ones the earlier rows."""
    s = scores.T
    if s.shape[1] > k:
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        q, r = np.nonzero(s >= least[:, None])
    else:
        q, r = np.nonzero(np.ones_like(s, bool))
    order = np.lexsort((r, -s[q, r], q))
    q, r = q[order], r[order]
    start = np.searchsorted(q, np.arange(s.shape[0]))
    keep = np.arange(len(q)) - start[q] < k
    return q[keep], r[keep]


def knn_join(queries: DataFrame | pa.Table, table: DataFrame, k: int, vector_column: str, dim: int, ties: list[str], keep: list[str] | None = None, query_id: str = "query_id", query_vector: str = "vector", metric: str = "cosine", block_rows: int = 2048) -> DataFrame:
    """(query_id, hit_rank, similarity, *ties, *keep): the k most similar rows of the table for every query.

    Equally similar rows are ordered by the columns `ties` (nulls first), which should tell rows apart. Rows and queries whose vector is
    null, has null elements or not `dim` elements take no part; zero, NaN and infinite vectors have similarity 0 to all. A table
    with fewer than k rows gives all of them. Filter the table before the join to pre-filter. No cross join is built: a block of
    at most `block_rows` queries is broadcast, and a task sends on no more than k rows a query. Queries that are at hand may be given as
    an Arrow table with the columns q (long) and v.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    keep = [c for c in (keep or []) if c not in ties]
    carried = [*ties, *keep]
    spark = table.sparkSession
    picked = table.select(*carried, F.col(vector_column).alias("__vector"))
    id_kind = "bigint" if isinstance(queries, pa.Table) else queries.schema[query_id].dataType.simpleString()
    schema = ", ".join(["query_id " + id_kind, "similarity double", *(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in carried)])

    def scan(block: pa.Table) -> DataFrame:
        right, v = vectors_of(block.column("v"), dim)
        shared = spark.sparkContext.broadcast((block.column("q").combine_chunks().take(pa.array(right)), prepared(v, metric)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best: pa.Table | None = None
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                right, v = vectors_of(rows.column("__vector"), dim)
                if not len(right) or not len(q):
                    continue
                rows = rows.drop_columns(["__vector"]).take(pa.array(right))
                order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ties], null_placement="at_start").to_numpy()
                scores = np.round(prepared(v[order], metric) @ q.T, DECIMALS)
                who, row = survivors(scores, k)
                new = rows.take(pa.array(order[row])).append_column("__q", pa.array(who)).append_column("similarity", pa.array(scores[row, who]))
                best = new if best is None else pa.concat_tables([best, new])
                if best.num_rows > 4 * k * len(q):
                    best = least(best)
            if best is not None:
                best = least(best)
                out = pa.table([ids.take(best.column("__q").combine_chunks()), best.column("similarity"), *(best.column(c) for c in carried)], names=["query_id", "similarity", *carried])
                yield from out.combine_chunks().to_batches()

        def least(t: pa.Table) -> pa.Table:
            order = pc.sort_indices(t.append_column("__s", pc.negate(t.column("similarity"))), sort_keys=[("__q", "ascending"), ("__s", "ascending"), *((c, "ascending") for c in ties)], null_placement="at_start")
            t = t.take(order)
            who = t.column("__q").to_numpy()
            return t.filter(pa.array(np.arange(len(who)) - np.searchsorted(who, who) < k))

        return picked.mapInArrow(run, schema)

    if isinstance(queries, pa.Table):
        blocks = iter([queries])
    else:
        blocks = blocks_of(queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("q"), F.col(query_vector).alias("v")), block_rows)
    found = reduce(DataFrame.unionByName, map(scan, blocks))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *(F.asc_nulls_first(c) for c in ties))
    return found.withColumn("hit_rank", F.row_number().over(order)).where(F.col("hit_rank") <= k).select("query_id", "hit_rank", "similarity", *carried)


def as_filter(condition: Column | str | dict | None) -> Column:
    """A pre-filter as a column: a column, a SQL string, or a map of column to value (a list: any of these; null: is null)."""
    if condition is None:
        return F.lit(True)
    if isinstance(condition, str):
        return F.expr(condition)
    if isinstance(condition, dict):
        each = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c).eqNullSafe(F.lit(v)) for c, v in condition.items()]
        return reduce(lambda a, b: a & b, each, F.lit(True))
    return condition


def top_k(table: DataFrame, vector: list[float], k: int, vector_column: str, ties: list[str], where: Column | str | dict | None = None, select: list[str] | None = None, metric: str = "cosine") -> DataFrame:
    """The k rows most similar to one vector, most similar first: columns `select` (all but the vector if not given), the ties and `similarity`.

    The filter comes before the ranking. Required columns win over the selection."""
    queries = pa.table({"q": pa.array([0]), "v": pa.array([[float(x) for x in vector]], pa.list_(pa.float64()))})
    wanted = [c for c in table.columns if c != vector_column] if select is None else select
    hits = knn_join(queries, table.where(as_filter(where)), k, vector_column, len(vector), ties, wanted, metric=metric)
    return hits.select(*dict.fromkeys([*wanted, *ties]), "similarity", "hit_rank").orderBy("hit_rank")
