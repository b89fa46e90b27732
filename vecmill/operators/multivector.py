"""Search over several vector columns, merging with provenance, and reranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import words
from ..sources.schema import VectorColumn, checked_columns
from .encoders import encode_column
from .knn import as_filter, knn_join


def query_rows(spark: SparkSession, texts: list[str], columns: list[VectorColumn], vectors: dict[str, list[list[float]]] | None = None) -> DataFrame:
    """(query_id, query, a vector for each column): stated texts by their place, encoded where a column has an encoder.

    vectors: those of the other columns, one for each text; another number of them, or none for a precomputed column: ValueError."""
    vectors = vectors or {}
    for c in columns:
        if c.encoder is None and c.column_name not in vectors:
            raise ValueError(f"no vectors for {c.column_name}")
        if c.column_name in vectors and len(vectors[c.column_name]) != len(texts):
            raise ValueError(f"{len(texts)} queries but {len(vectors[c.column_name])} vectors for {c.column_name}")
    given = [c for c in columns if c.column_name in vectors]
    rows = [(i, t, *([float(x) for x in vectors[c.column_name][i]] for c in given)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(["query_id long", "query string", *(f"`{c.column_name}` array<float>" for c in given)]))
    encoders = {c.column_name: c.encoder for c in columns if c not in given}
    return encode_column(df, "query", encoders) if encoders else df


def column_hits(queries: DataFrame, table: DataFrame, columns: list[VectorColumn], requested: str | list[str] | None = None, k: int = 10, where: Column | str | dict | None = None, row_column: str = "row_id", id_column: str = "chunk_id") -> DataFrame:
    """(query_id, column_index, column_name, hit_rank, similarity, row, id): the k best rows of each requested column for each query.

    queries: query_id and a vector under the name of each column. The filter comes first. Hits are numbered before those without
    id are dropped, so ranks may have gaps. Equally similar rows: the smaller row id. A query without a vector for a column has
    no hits there.
    """
    by_name = {c.column_name: c for c in columns}
    table = table.where(as_filter(where))
    parts = []
    for i, name in enumerate(checked_columns(requested, by_name)):
        hits = knn_join(queries, table, k, name, by_name[name].dimension, [row_column], [id_column], query_vector=name, metric=by_name[name].metric)
        parts.append(hits.select("query_id", F.lit(i).alias("column_index"), F.lit(name).alias("column_name"), "hit_rank", "similarity", F.col(row_column).alias("row"), F.col(id_column).alias("id")))
    return reduce(DataFrame.unionByName, parts).where("id is not null")


def merge_hits(hits: DataFrame) -> DataFrame:
    """(query_id, position, id, row, similarity, source_columns): hits of several columns merged by id.

    An id comes once, with the row and the similarity of where it was seen first (in order of columns, then ranks), which also
    gives its position, and with every (column, rank, similarity) in that order. There is no fused score.
    """
    seen = F.struct("column_index", "hit_rank")
    entry = F.struct("column_index", "hit_rank", "column_name", "similarity")
    merged = hits.groupBy("query_id", "id").agg(F.min(seen).alias("first"), F.min_by("row", seen).alias("row"), F.min_by("similarity", seen).alias("similarity"), F.array_sort(F.collect_list(entry)).alias("all"))
    sources = F.transform("all", lambda e: F.struct(e.column_name.alias("column_name"), e.hit_rank.alias("hit_rank"), e.similarity.alias("similarity")))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("first"))
    return merged.select("query_id", position.alias("position"), "id", "row", "similarity", sources.alias("source_columns"))


def search(queries: DataFrame, table: DataFrame, columns: list[VectorColumn], requested: str | list[str] | None = None, k: int = 10, where: Column | str | dict | None = None, row_column: str = "row_id", id_column: str = "chunk_id", select: list[str] | None = None) -> DataFrame:
    """merge_hits() of column_hits(), with the columns `select` of the found rows joined at the end."""
    merged = merge_hits(column_hits(queries, table, columns, requested, k, where, row_column, id_column))
    if not select:
        return merged
    stored = table.select(F.col(row_column).alias("row"), *(c for c in dict.fromkeys(select) if c not in merged.columns))
    return merged.join(stored, "row", "left")


def lexical_overlap(query: Column, content: Column) -> Column:
    """Share of the query's distinct words that the content has; 0 without words."""
    q, c = F.array_distinct(words(F.coalesce(query, F.lit("")))), words(F.coalesce(content, F.lit("")))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(F.lit(0.0))


def rerank(hits: DataFrame, queries: DataFrame, score: Callable[[Column, Column], Column] = lexical_overlap, limit: int | None = None, id_column: str = "id", content_column: str = "content", query_column: str = "query", keep: bool = False) -> DataFrame:
    """hits with rerank_score and rerank_rank, best first and no more than `limit` a query. Ties: the smaller id.

    queries: query_id and the query's text. score: an expression of query and content; a pandas UDF serves for models. No hits give
    no rows and the scorer is not called. Hits of a query that `queries` doesn't have are dropped; with keep they stay, and what has
    no query text has score 0 and so is ranked by id."""
    texts = queries.select("query_id", F.col(query_column).alias("__query")).where("query_id is not null").dropDuplicates(["query_id"])
    value = F.round(score(F.col("__query"), F.col(content_column)), 9)
    if keep:
        value = F.when(F.col("__query").isNotNull(), value).otherwise(F.lit(0.0))
    scored = hits.join(texts, "query_id", "left" if keep else "inner").withColumn("rerank_score", value).drop("__query")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.asc_nulls_first(id_column))
    ranked = scored.withColumn("rerank_rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rerank_rank") <= limit)


def search_and_rerank(queries: DataFrame, table: DataFrame, columns: list[VectorColumn], content_column: str = "content", query_column: str = "query", score: Callable[[Column, Column], Column] | None = lexical_overlap, limit: int | None = None, k: int = 10, **search_options) -> DataFrame:
    """search(), then rerank() to `limit` rows a query, by default k. Without scorer: ValueError."""
    if score is None:
        raise ValueError("reranking needs a scorer")
    hits = search(queries, table, columns, k=k, select=[content_column], **search_options)
    return rerank(hits, queries, score, limit or k, content_column=content_column, query_column=query_column)
