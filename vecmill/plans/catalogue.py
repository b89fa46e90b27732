"""The queries of the retrieval operators, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import params, text, vectors
from ..operators import batches, knn, late, multivector, pooling
from ..operators.cells import CellIndex
from ..operators.encoders import HashingEncoder, encode_column, encode_tokens, parallel_map
from ..session import new_path
from ..sources.index import ChunkIndex, LateIndex
from ..sources.schema import VectorColumn, document_schema, missing_vectors, options_from_table, rejections, schema_difference
from ..sources.store import Table

CHUNKS, EMBEDDINGS, HITS = "astra_multi_vector_table", "embeddings", "search_hits"
PAGES, TOKENS, OPTIONS = "late_interaction_docs", "late_interaction_tokens", "column_options"
COLUMNS = [VectorColumn.precomputed("embeddings1", 8), VectorColumn.precomputed("multi_embeddings", 64)]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# SQL pieces -------------------------------------------------------------------------------------------------------------------


def _norm(v: str) -> str:
    return f"sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[]))"


def _good(v: str) -> str:
    return f"({_norm(v)} > 0 AND isfinite({_norm(v)}))"


def _cos(a: str, b: str) -> str:
    return f"CASE WHEN {_good(a)} AND {_good(b)} THEN round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / ({_norm(a)} * {_norm(b)}), 9) ELSE 0.0 END"


def _usable(v: str, dim: int) -> str:
    return f"({v} IS NOT NULL AND len({v}) = {dim} AND len(list_filter({v}, lambda x: x IS NULL)) = 0)"


_HASHED = "list_transform(range(1, 5), lambda i: ((CAST('0x' || substr(md5(w), CAST(2 * i - 1 AS BIGINT), 2) AS INT) - 127.5) / 127.5)::FLOAT)"

# Nearest neighbours ------------------------------------------------------------------------------------------------------------


@_query(f"""
    SELECT t.vec_id, t.label, {_cos('t.embedding', 'q.embedding')} AS similarity FROM embeddings t, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    WHERE {_usable('t.embedding', 64)} ORDER BY similarity DESC, t.vec_id LIMIT 10""")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, EMBEDDINGS)
    return knn.top_k(table, table.where("vec_id = 0").first().embedding, 10, "embedding", ["vec_id"]).drop("hit_rank")


@_query(f"""
    SELECT t.vec_id, round(list_dot_product(t.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS similarity
    FROM embeddings t, (SELECT embedding FROM embeddings WHERE vec_id = 100) q WHERE {_usable('t.embedding', 64)} ORDER BY similarity DESC, t.vec_id LIMIT 10""")
def topk_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, EMBEDDINGS)
    return knn.top_k(table, table.where("vec_id = 100").first().embedding, 10, "embedding", ["vec_id"], select=[], metric="dot_product").drop("hit_rank")


@_query(f"""
    SELECT t.vec_id, t.label, {_cos('t.embedding', 'q.embedding')} AS similarity FROM embeddings t, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
    WHERE t.label = 3 AND {_usable('t.embedding', 64)} ORDER BY similarity DESC, t.vec_id LIMIT 10""")
def topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, EMBEDDINGS)
    return knn.top_k(table, table.where("vec_id = 0").first().embedding, 10, "embedding", ["vec_id"], {"label": 3}).drop("hit_rank")


@_query(f"""
    SELECT q.vec_id AS query_id, t.vec_id, {_cos('t.embedding', 'q.embedding')} AS similarity,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {_cos('t.embedding', 'q.embedding')} DESC, t.vec_id) AS hit_rank
    FROM embeddings t, embeddings q WHERE q.vec_id % 100 = 0 AND {_usable('t.embedding', 64)} AND {_usable('q.embedding', 64)} QUALIFY hit_rank <= 10""")
def knn_join_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, EMBEDDINGS)
    asked = table.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return knn.knn_join(asked, table, 10, "embedding", 64, ["vec_id"])


@_query()
def cell_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk table indexed by cells, asked by every hundredth row; approximate."""
    chunks = _read(spark, sf_dir, CHUNKS)
    index = CellIndex.build(chunks, new_path(spark, "cells"), "multi_embeddings", 64, ["row_id"], cell_rows=500)
    return index.search(chunks.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.col("multi_embeddings").alias("vector")), 10, probes=4)


@_query(f"""
    SELECT q.row_id AS query_id, t.row_id, {_cos('t.multi_embeddings', 'q.multi_embeddings')} AS similarity,
      row_number() OVER (PARTITION BY q.row_id ORDER BY {_cos('t.multi_embeddings', 'q.multi_embeddings')} DESC, t.row_id) AS hit_rank
    FROM astra_multi_vector_table t, astra_multi_vector_table q WHERE q.row_id % 100 = 0 AND {_usable('t.multi_embeddings', 64)} AND {_usable('q.multi_embeddings', 64)} QUALIFY hit_rank <= 10""")
def cell_index_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all cells probed, which is exact."""
    chunks = _read(spark, sf_dir, CHUNKS)
    index = CellIndex.build(chunks, new_path(spark, "cells"), "multi_embeddings", 64, ["row_id"], cell_rows=2000)
    return index.search(chunks.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.col("multi_embeddings").alias("vector")), 10, probes=4096)


# Several vector columns --------------------------------------------------------------------------------------------------------


def _column_hits_sql(where: str = "TRUE", k: int = 10) -> str:
    def part(i: int, column: str, dim: int) -> str:
        s = _cos("t." + column, "q." + column)
        return f"""SELECT q.row_id AS query_id, {i} AS column_index, '{column}' AS column_name, {s} AS similarity, t.row_id AS "row", t.chunk_id AS id,
            row_number() OVER (PARTITION BY q.row_id ORDER BY {s} DESC, t.row_id) AS hit_rank
            FROM astra_multi_vector_table t, astra_multi_vector_table q
            WHERE q.row_id % 100 = 0 AND {where} AND {_usable('t.' + column, dim)} AND {_usable('q.' + column, dim)} QUALIFY hit_rank <= {k}"""

    return f"""hits AS (SELECT * FROM ({part(0, 'embeddings1', 8)} UNION ALL {part(1, 'multi_embeddings', 64)}) WHERE id IS NOT NULL),
        merged AS (SELECT query_id, id, min(column_index * 1000 + hit_rank) AS first, arg_min("row", column_index * 1000 + hit_rank) AS "row",
          arg_min(similarity, column_index * 1000 + hit_rank) AS similarity, count(*) AS n, count(DISTINCT column_name) AS columns,
          string_agg(column_name || ' (rank ' || hit_rank || ')', ', ' ORDER BY column_index, hit_rank) AS provenance FROM hits GROUP BY query_id, id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) AS position FROM merged)"""


def _asked(chunks: DataFrame) -> DataFrame:
    return chunks.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), "embeddings1", "multi_embeddings")


def _flat(merged: DataFrame) -> DataFrame:
    return merged.select("query_id", "position", "id", F.col("row").alias("row_id"), "similarity", text.provenance_text(F.col("source_columns")).alias("provenance"))


@_query(f"""WITH {_column_hits_sql()} SELECT query_id, position, id, "row" AS row_id, similarity, provenance FROM placed""")
def multi_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, CHUNKS)
    return _flat(multivector.search(_asked(chunks), chunks, COLUMNS))


@_query(f"""WITH {_column_hits_sql("t.book_name = 'kelmar_manual' AND t.ingest_batch <= 5")} SELECT query_id, position, id, "row" AS row_id, similarity, provenance FROM placed""")
def multi_vector_search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, CHUNKS)
    where = knn.as_filter({"book_name": "kelmar_manual"}) & (F.col("ingest_batch") <= 5)
    return _flat(multivector.search(_asked(chunks), chunks, COLUMNS, where=where))


@_query(f"""WITH {_column_hits_sql()} SELECT query_id, id, column_name, hit_rank, similarity FROM hits""")
def multi_vector_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, CHUNKS)
    merged = multivector.search(_asked(chunks), chunks, COLUMNS)
    return merged.select("query_id", "id", F.explode("source_columns").alias("s")).select("query_id", "id", "s.column_name", "s.hit_rank", "s.similarity")


@_query(f"""WITH {_column_hits_sql()} SELECT query_id, id FROM placed WHERE columns = 2""")
def multi_vector_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, CHUNKS)
    merged = multivector.search(_asked(chunks), chunks, COLUMNS)
    return merged.where(F.size(F.array_distinct("source_columns.column_name")) == 2).select("query_id", "id")


@_query(f"""WITH {_column_hits_sql()} SELECT query_id, hit_rank, similarity, "row" AS row_id, id FROM hits WHERE column_index = 1""")
def null_id_rank_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, CHUNKS)
    hits = multivector.column_hits(_asked(chunks), chunks, COLUMNS, "multi_embeddings")
    return hits.select("query_id", "hit_rank", "similarity", F.col("row").alias("row_id"), "id")


_OVERLAP = """CASE WHEN len(list_distinct(regexp_extract_all(lower(coalesce({q}, '')), '[\\p{{L}}\\p{{N}}]+'))) > 0 THEN round(len(list_intersect(
    list_distinct(regexp_extract_all(lower(coalesce({q}, '')), '[\\p{{L}}\\p{{N}}]+')), regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+')))
    / len(list_distinct(regexp_extract_all(lower(coalesce({q}, '')), '[\\p{{L}}\\p{{N}}]+'))), 9) ELSE 0.0 END"""


@_query(f"""WITH {_column_hits_sql()}, scored AS (SELECT p.query_id, p.id, {_OVERLAP.format(q='q.content', c='t.content')} AS rerank_score
      FROM placed p JOIN astra_multi_vector_table t ON t.row_id = p."row" JOIN astra_multi_vector_table q ON q.row_id = p.query_id)
    SELECT query_id, id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rerank_rank FROM scored QUALIFY rerank_rank <= 10""")
def search_and_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _read(spark, sf_dir, CHUNKS)
    asked = chunks.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), F.col("content").alias("query"), "embeddings1", "multi_embeddings")
    return multivector.search_and_rerank(asked, chunks, COLUMNS).select("query_id", "id", "rerank_score", "rerank_rank")


@_query(f"""WITH h AS (SELECT h.query_id, h.hit_id, {_OVERLAP.format(q='e.text', c='h.content')} AS rerank_score FROM search_hits h JOIN eval_items e ON e.item_id = h.query_id)
    SELECT query_id, hit_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, hit_id) AS rerank_rank FROM h QUALIFY rerank_rank <= 5""")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded hits reranked by the texts of their queries, as far as there are any: only queries 1 to 200 have one (eval_items, which
    doesn't grow), and as in the SQL the hits of others are dropped, 3,000 of 5,000 at sf0.1. rerank(keep=True) keeps them."""
    asked = _read(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = multivector.rerank(_read(spark, sf_dir, HITS), asked, limit=5, id_column="hit_id")
    return found.select("query_id", "hit_id", "rerank_score", "rerank_rank")


@_query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_id) AS pos FROM search_hits), k AS (SELECT * FROM r WHERE chunk_id IS NOT NULL)
    SELECT query_id, chunk_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) AS "position", arg_min(hit_id, pos) AS hit_id, arg_min(coalesce(similarity, -9), pos) AS similarity, count(*) AS copies
    FROM k GROUP BY query_id, chunk_id""")
def recorded_hits_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded hits numbered within their query, without those that have no id, once for each chunk as first seen."""
    ranked = _read(spark, sf_dir, HITS).withColumn("hit_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("hit_id")))
    hits = ranked.where("chunk_id is not null").select("query_id", F.lit(0).alias("column_index"), F.lit("recorded").alias("column_name"), "hit_rank", F.coalesce("similarity", F.lit(-9.0)).alias("similarity"), F.col("hit_id").alias("row"), F.col("chunk_id").alias("id"))
    return multivector.merge_hits(hits).select("query_id", "id", "position", F.col("row").alias("hit_id"), "similarity", F.size("source_columns").alias("copies"))


@_query("""SELECT hit_id, coalesce(array_to_string(list_transform(source_columns, lambda s: coalesce(s.column_name, '?') || ' (rank ' || coalesce(s.hit_rank::VARCHAR, '?') || ')'), ', '), '') AS provenance
    FROM search_hits""")
def provenance_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, HITS).select("hit_id", text.provenance_text(F.col("source_columns")).alias("provenance"))


# Late interaction --------------------------------------------------------------------------------------------------------------


def _query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(spark, sf_dir, "eval_items").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")
    return encode_tokens(asked, ["query_id"], "text", HashingEncoder(4))


# Tokens of first pages as the index makes them: a token's id is document, page and position.
_INDEXED_SQL = f"""(SELECT doc_id, doc_id || '-1-' || position AS token_id, {_HASHED} AS token_embedding FROM (SELECT doc_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS w,
      generate_subscripts(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'), 1) - 1 AS position FROM late_interaction_docs WHERE page_number = 1 AND doc_id IS NOT NULL AND trim(content, ' ') <> ''))"""


def _late_sql(n: int, m: int, tokens: str = "late_interaction_tokens") -> str:
    s = _cos("t.token_embedding", "q.v")
    return f"""w AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 1) - 1 AS position
          FROM eval_items WHERE item_id % 100 = 0 AND text IS NOT NULL),
        q AS (SELECT query_id, position, {_HASHED} AS v FROM w),
        t AS (SELECT * FROM {tokens} WHERE {_usable('token_embedding', 4)}),
        hits AS (SELECT q.query_id, q.position, t.doc_id, t.token_id, {s} AS similarity,
          row_number() OVER (PARTITION BY q.query_id, q.position ORDER BY {s} DESC, t.doc_id NULLS FIRST, t.token_id NULLS FIRST) AS hit_rank FROM q, t QUALIFY hit_rank <= {n}),
        best AS (SELECT query_id, doc_id, position, max(similarity) AS s FROM hits WHERE doc_id IS NOT NULL GROUP BY ALL),
        stage1 AS (SELECT query_id, doc_id, round(sum(s), 9) AS stage1_score FROM best GROUP BY ALL),
        cand AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage1_score DESC, doc_id) AS candidate_rank FROM stage1 QUALIFY candidate_rank <= {m}),
        sims AS (SELECT q.query_id, q.position, t.doc_id, max({s}) AS s FROM cand c JOIN q USING (query_id) JOIN t ON t.doc_id = c.doc_id GROUP BY ALL),
        counts AS (SELECT doc_id, count(*) AS n_tokens FROM t GROUP BY doc_id),
        open AS (SELECT query_id, doc_id, n_tokens, max(n_tokens) OVER (PARTITION BY query_id) AS longest, position, s FROM sims JOIN counts USING (doc_id)),
        scores AS (SELECT query_id, doc_id, round(sum(CASE WHEN n_tokens < longest THEN greatest(s, 0.0) ELSE s END), 9) AS score FROM open GROUP BY query_id, doc_id),
        pages AS (SELECT doc_id, arg_max(content, {{'p': coalesce(page_number, -2147483648), 'c': coalesce(content, '')}}) AS content FROM late_interaction_docs WHERE doc_id IS NOT NULL GROUP BY doc_id)"""


@_query(f"""WITH {_late_sql(170, 20)} SELECT query_id, position, hit_rank, similarity, doc_id, token_id FROM hits WHERE doc_id IS NOT NULL""")
def token_level_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.token_hits(_query_tokens(spark, sf_dir), _read(spark, sf_dir, TOKENS), 170, 4)


@_query(f"""WITH {_late_sql(170, 20)} SELECT query_id, candidate_rank, doc_id, round(stage1_score, 6) AS stage1_score FROM cand""")
def token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = late.candidates(late.token_hits(_query_tokens(spark, sf_dir), _read(spark, sf_dir, TOKENS), 170, 4), 20)
    return found.withColumn("stage1_score", F.round("stage1_score", 6))


@_query(f"""WITH {_late_sql(170, 20)}, ranked AS (SELECT s.query_id, s.doc_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, c.candidate_rank, s.doc_id) AS rank
      FROM scores s JOIN cand c USING (query_id, doc_id) QUALIFY rank <= 10)
    SELECT query_id, rank, doc_id, round(score, 6) AS score, coalesce(content, '') AS content FROM ranked LEFT JOIN pages USING (doc_id)""")
def late_interaction_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = late.search(_query_tokens(spark, sf_dir), _read(spark, sf_dir, TOKENS), _read(spark, sf_dir, PAGES), 4)
    return found.withColumn("score", F.round("score", 6))


def _maxsim_sql(doc: str) -> str:
    s = _cos("t.embedding", "q.embedding")
    return f"""sims AS (SELECT q.vec_id // 1000 AS query_id, q.vec_id AS position, {doc} AS doc_id, max({s}) AS s
          FROM embeddings t, embeddings q WHERE q.vec_id % 100 = 0 AND {_usable('t.embedding', 64)} AND {_usable('q.embedding', 64)} GROUP BY ALL),
        counts AS (SELECT {doc} AS doc_id, count(*) AS n_tokens FROM embeddings t WHERE {_usable('t.embedding', 64)} GROUP BY ALL),
        open AS (SELECT *, max(n_tokens) OVER (PARTITION BY query_id) AS longest FROM sims JOIN counts USING (doc_id))
        SELECT query_id, doc_id::VARCHAR AS doc_id, round(sum(CASE WHEN n_tokens < longest THEN greatest(s, 0.0) ELSE s END), 6) AS score FROM open GROUP BY query_id, doc_id"""


def _maxsim(spark: SparkSession, sf_dir: str, doc: str) -> DataFrame:
    table = _read(spark, sf_dir, EMBEDDINGS)
    asked = table.where("vec_id % 100 = 0").select(F.expr("vec_id div 1000").alias("query_id"), F.col("vec_id").cast("int").alias("position"), F.col("embedding").alias("token_embedding"))
    stored = table.select(F.expr(doc).cast("string").alias("doc_id"), F.col("vec_id").alias("token_id"), F.col("embedding").alias("token_embedding"))
    return late.maxsim(asked, stored, 64).withColumn("score", F.round("score", 6))


@_query("WITH " + _maxsim_sql("t.vec_id // 10"))
def maxsim_exhaustive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _maxsim(spark, sf_dir, "vec_id div 10")


@_query("WITH " + _maxsim_sql("t.label"))
def maxsim_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of unequal length: shorter ones are as if filled up with zero vectors."""
    return _maxsim(spark, sf_dir, "label")


@_query(f"""SELECT d.doc_id, count(t.token_id) AS tokens, coalesce(round(sum({_norm('t.token_embedding')}) FILTER ({_good('t.token_embedding')}), 6), 0) AS total_norm
    FROM (SELECT DISTINCT doc_id FROM late_interaction_docs WHERE doc_id IS NOT NULL) d
    LEFT JOIN (SELECT * FROM late_interaction_tokens WHERE {_usable('token_embedding', 4)}) t USING (doc_id) GROUP BY d.doc_id""")
def load_document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of stored documents; documents without tokens stay, with none."""
    found = late.document_tokens(_read(spark, sf_dir, PAGES), _read(spark, sf_dir, TOKENS), 4)
    size = vectors.norm(F.col("token_embedding"))
    sized = found.select("doc_id", "token_id", F.when(vectors.proper(size), size).alias("size"))
    return sized.groupBy("doc_id").agg(F.count("token_id").alias("tokens"), F.coalesce(F.round(F.sum("size"), 6), F.lit(0.0)).alias("total_norm"))


@_query("""SELECT doc_id, token_id FROM late_interaction_tokens WHERE doc_id IN (SELECT doc_id FROM late_interaction_docs WHERE page_number = 3)""")
def fetch_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored token rows of stated documents: of those that have a third page."""
    return late.fetch(_read(spark, sf_dir, TOKENS), _read(spark, sf_dir, PAGES).where("page_number = 3")).select("doc_id", "token_id")


@_query("""SELECT doc_id, arg_max(content, {'p': coalesce(page_number, -2147483648), 'c': coalesce(content, '')}) AS content FROM late_interaction_docs WHERE doc_id IS NOT NULL GROUP BY doc_id""")
def document_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late.contents(_read(spark, sf_dir, PAGES))


# Functions ---------------------------------------------------------------------------------------------------------------------


@_query("""SELECT k::INT AS k, CASE WHEN k < 1 THEN 0 ELSE greatest(k, trunc(94.9 + 11.0 * k - 1.48 * k * ln(greatest(k, 1)))::INT) END::INT AS n_tokens,
    CASE WHEN k < 1 THEN 0 ELSE greatest(k, trunc(8.82 + 1.13 * k - 0.00471 * k * ln(greatest(k, 1)))::INT) END::INT AS n_candidates FROM range(-5, 1001) t(k)""")
def expand_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return spark.range(-5, 1001).select(F.col("id").cast("int").alias("k")).select("k", params.expanded(k, *params.TOKENS).alias("n_tokens"), params.expanded(k, *params.CANDIDATES).alias("n_candidates"))


@_query(f"""SELECT row_id, CASE WHEN {_good('embeddings1')} THEN round({_norm('embeddings1')}, 6) END AS norm, {_good('embeddings1')} AS proper
    FROM astra_multi_vector_table WHERE {_usable('embeddings1', 8)}""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = vectors.norm(F.col("embeddings1"))
    return _read(spark, sf_dir, CHUNKS).where(vectors.usable(F.col("embeddings1"), 8)).select("row_id", F.when(vectors.proper(size), F.round(size, 6)).alias("norm"), vectors.proper(size).alias("proper"))


@_query(f"""WITH u AS (SELECT row_id, CASE WHEN {_good('embeddings1')} THEN list_transform(embeddings1, lambda x: x::DOUBLE / {_norm('embeddings1')}) ELSE list_transform(embeddings1, lambda x: 0.0) END AS u
      FROM astra_multi_vector_table WHERE {_usable('embeddings1', 8)})
    SELECT row_id, generate_subscripts(u, 1) - 1 AS dim, round(unnest(u), 6) + 0 AS x FROM u""")
def normalized_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _read(spark, sf_dir, CHUNKS).where(vectors.usable(F.col("embeddings1"), 8))
    return good.select("row_id", F.posexplode(vectors.normalize(F.col("embeddings1"))).alias("dim", "x")).select("row_id", "dim", (F.round("x", 6) + 0).alias("x"))


@_query(f"""SELECT row_id, round(1 - ({_cos('embeddings1', 'multi_embeddings[1:8]')}), 6) AS distance, round(list_dot_product(embeddings1::DOUBLE[], multi_embeddings[1:8]::DOUBLE[]), 6) AS dot
    FROM astra_multi_vector_table WHERE {_usable('embeddings1', 8)} AND {_usable('multi_embeddings', 64)} AND {_good('embeddings1')} AND {_good('multi_embeddings')}""")
def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("embeddings1"), F.slice("multi_embeddings", 1, 8)
    good = _read(spark, sf_dir, CHUNKS).where(vectors.usable(a, 8) & vectors.usable(F.col("multi_embeddings"), 64) & vectors.proper(vectors.norm(a)) & vectors.proper(vectors.norm(F.col("multi_embeddings"))))
    return good.select("row_id", F.round(1 - F.round(vectors.cosine(a, b), 9), 6).alias("distance"), F.round(vectors.dot(a, b), 6).alias("dot"))


@_query("""SELECT label AS "cluster", dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x FROM embeddings) GROUP BY label, dim""")
def cluster_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.cluster_mean(_read(spark, sf_dir, EMBEDDINGS), "label", "embedding").withColumn("mean", F.round("mean", 6))


@_query("""SELECT book_name, column_name, regexp_replace(coalesce(model, 'default_model'), '[^\\p{L}\\p{N}_]', '_', 'g') AS identifier FROM column_options""")
def sanitize_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, OPTIONS).select("book_name", "column_name", text.sanitize_identifier(F.col("model")).alias("identifier"))


@_query("""SELECT book_name, column_name, dimension, column_type AS type, model, json_extract_string(vector_service_options, '$.provider') AS provider,
    json_extract_string(vector_service_options, '$.model_name') AS service_model, coalesce(json_extract_string(table_vector_index_options, '$.metric'), 'cosine') AS metric FROM column_options""")
def column_option_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return options_from_table(_read(spark, sf_dir, OPTIONS))


@_query("""SELECT doc_id, CASE WHEN trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0 ELSE
      len(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[ \\t\\n\\x0B\\f\\r]+')) END::INT AS words FROM documents""")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


@_query("""SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS excerpt FROM documents""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.excerpt(F.col("text"), 150).alias("excerpt"))


@_query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunk_texts(_read(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


_BLANKS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@_query(f"""SELECT doc_id, length(regexp_replace(text, '{_BLANKS}', '', 'g'))::BIGINT AS characters, true AS fit FROM documents WHERE length(regexp_replace(text, '{_BLANKS}', '', 'g')) > 0""")
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of a document have all its characters but blanks, and none is longer than it may be."""
    size = F.length(F.regexp_replace("chunk", _BLANKS, ""))
    return chunk_documents(spark, sf_dir).groupBy("doc_id").agg(F.sum(size).alias("characters"), F.every(F.length("chunk") <= 500).alias("fit"))


@_query("""SELECT event_type, round(avg(value), 6) AS avg_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
    round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batches.latency_summary(_read(spark, sf_dir, "events"), "value", ["event_type"])
    return found.select("event_type", *(F.round(c, 6).alias(c) for c in found.columns[1:]))


@_query("""SELECT row_id, ((row_number() OVER (ORDER BY row_id) - 1) // 100 + 1)::INT AS batch FROM astra_multi_vector_table""")
def insert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.batch_numbers(_read(spark, sf_dir, CHUNKS).select("row_id"), ["row_id"], 100)


@_query("""SELECT row_id, length(content)::INT AS chars FROM astra_multi_vector_table""")
def parallel_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of ours, mapped over all contents in order."""
    measure = lambda values: [None if v is None else len(v) for v in values]
    return parallel_map(_read(spark, sf_dir, CHUNKS), ["row_id"], "content", measure, "chars int").select("row_id", "chars")


# Tables ------------------------------------------------------------------------------------------------------------------------


@_query("""SELECT doc_id, page_number, content, CASE WHEN content IS NULL OR trim(content, ' ') = '' THEN 'no content' END AS rejected FROM late_interaction_docs""")
def validated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejections(_read(spark, sf_dir, PAGES))


@_query("""SELECT row_id, 'embeddings1' AS column_name FROM astra_multi_vector_table WHERE embeddings1 IS NULL OR len(embeddings1) <> 8
    UNION ALL SELECT row_id, 'multi_embeddings' FROM astra_multi_vector_table WHERE multi_embeddings IS NULL OR len(multi_embeddings) <> 64""")
def incomplete_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps rows from being inserted with precomputed vectors."""
    return missing_vectors(_read(spark, sf_dir, CHUNKS), COLUMNS).select("row_id", F.explode("missing_vectors").alias("column_name"))


@_query("""WITH c AS (SELECT column_name FROM (DESCRIBE astra_multi_vector_table)), s AS (SELECT unnest(['doc_id', 'page_number', 'content']) AS column_name)
    SELECT column_name, 'dropped' AS what FROM c WHERE column_name NOT IN (SELECT column_name FROM s) UNION ALL SELECT column_name, 'missing' FROM s WHERE column_name NOT IN (SELECT column_name FROM c)""")
def schema_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows against the document schema."""
    dropped, missing = schema_difference(_read(spark, sf_dir, CHUNKS), document_schema())
    return spark.createDataFrame([*((c, "dropped") for c in dropped), *((c, "missing") for c in missing)], "column_name string, what string")


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a page has no content."""
    return _read(spark, sf_dir, PAGES).where("content is null").select("doc_id")


@_query("""SELECT 'document' AS kind, doc_id, page_number::VARCHAR AS part FROM late_interaction_docs d WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM late_interaction_docs WHERE content IS NULL AND doc_id IS NOT NULL)
    UNION ALL SELECT 'token', doc_id, token_id FROM late_interaction_tokens t WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM late_interaction_docs WHERE content IS NULL AND doc_id IS NOT NULL)""")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens are stored, some documents are deleted; what is left."""
    index = LateIndex(spark, new_path(spark, "late"), HashingEncoder(4))
    for table, rows in ((index.documents, _read(spark, sf_dir, PAGES)), (index.tokens, _read(spark, sf_dir, TOKENS))):
        table.append(rows)
    index.delete(_gone(spark, sf_dir))
    left = index.documents.read().select(F.lit("document").alias("kind"), "doc_id", F.col("page_number").cast("string").alias("part"))
    return left.unionByName(index.tokens.read().select(F.lit("token").alias("kind"), "doc_id", F.col("token_id").alias("part")))


@_query("""WITH again AS (SELECT doc_id, page_number, 'again ' || content AS content FROM late_interaction_docs WHERE page_number = 1 AND doc_id IS NOT NULL)
    SELECT doc_id, page_number, content FROM late_interaction_docs WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM again) UNION ALL SELECT * FROM again""")
def replace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents are indexed again by their first pages, which replace all pages."""
    pages = _read(spark, sf_dir, PAGES)
    store = Table(spark, new_path(spark, "pages"), pages.schema, "doc_id").create()
    store.append(pages)
    store.replace(pages.where("page_number = 1 and doc_id is not null").withColumn("content", F.concat(F.lit("again "), "content")))
    return store.read()


@_query("""SELECT doc_id, count(*) AS tokens FROM (SELECT doc_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS w FROM late_interaction_docs
      WHERE doc_id IS NOT NULL AND trim(content, ' ') <> '') GROUP BY doc_id""")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents validated, encoded by words and stored without pooling: tokens of each."""
    index = LateIndex(spark, new_path(spark, "index"), HashingEncoder(4), pool_factor=1)
    index.index(_read(spark, sf_dir, PAGES))
    return index.tokens.read().groupBy("doc_id").agg(F.count("*").alias("tokens"))


_POOLED = "CASE WHEN n <= 4 OR n // 2 < 4 THEN n ELSE n // 2 END"


@_query(f"""WITH p AS (SELECT doc_id, len(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS n FROM late_interaction_docs WHERE doc_id IS NOT NULL AND trim(content, ' ') <> '')
    SELECT doc_id, sum({_POOLED})::BIGINT AS tokens FROM p WHERE n > 0 GROUP BY doc_id""")
def index_documents_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded by words, their tokens pooled to half as they are indexed, page by page."""
    index = LateIndex(spark, new_path(spark, "index"), HashingEncoder(4), pool_factor=2)
    index.index(_read(spark, sf_dir, PAGES))
    return index.tokens.read().groupBy("doc_id").agg(F.count("*").alias("tokens"))


@_query("""SELECT CASE WHEN content IS NULL OR trim(content, ' ') = '' THEN 'no content' WHEN doc_id IS NULL THEN 'no doc_id' ELSE 'indexed' END AS what, count(*) AS n
    FROM late_interaction_docs GROUP BY 1""")
def indexing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages were indexed, and why others were not."""
    index = LateIndex(spark, new_path(spark, "index"), HashingEncoder(4), pool_factor=1)
    done = index.index(_read(spark, sf_dir, PAGES))
    indexed = late.fetch(index.documents.read(), done.ids).agg(F.lit("indexed").alias("what"), F.count("*").alias("n")).where("n > 0")
    return indexed.unionByName(done.rejected.select(F.col("rejected").alias("what"), F.col("rows").alias("n")))


@_query(f"""SELECT row_id::VARCHAR AS chunk_id, content IS NOT NULL AS encoded, round(multi_embeddings[1]::DOUBLE, 6) AS first FROM astra_multi_vector_table WHERE {_usable('multi_embeddings', 64)}""")
def chunk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks inserted with one column encoded and one precomputed; what the table then has."""
    index = ChunkIndex(spark, new_path(spark, "chunks"), [VectorColumn.encoded(HashingEncoder(4), "encoded"), VectorColumn.precomputed("multi_embeddings", 64)])
    chunks = _read(spark, sf_dir, CHUNKS).where(vectors.usable(F.col("multi_embeddings"), 64))
    index.insert(chunks.select(F.col("row_id").cast("string").alias("chunk_id"), "content", "multi_embeddings"))
    return index.table.read().select("chunk_id", F.col("encoded").isNotNull().alias("encoded"), F.round(F.col("multi_embeddings")[0].cast("double"), 6).alias("first"))


@_query("""SELECT batch, count(*) AS inserted FROM (SELECT ((row_number() OVER (ORDER BY row_id) - 1) // 100 + 1)::INT AS batch FROM astra_multi_vector_table) GROUP BY batch""")
def insert_batch_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each batch of 100 inserted chunks."""
    index = ChunkIndex(spark, new_path(spark, "chunks"), [VectorColumn.encoded(HashingEncoder(4), "encoded")])
    return index.insert_in_batches(_read(spark, sf_dir, CHUNKS).select("row_id", "chunk_id", "content"), ["row_id"], 100)


@_query(f"""WITH {_late_sql(170, 20, tokens=_INDEXED_SQL)}, ranked AS (SELECT s.query_id, s.doc_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, c.candidate_rank, s.doc_id) AS rank
      FROM scores s JOIN cand c USING (query_id, doc_id) QUALIFY rank <= 10)
    SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked""")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to ranked documents: documents indexed, query texts encoded, cached tokens searched."""
    index = LateIndex(spark, new_path(spark, "index"), HashingEncoder(4), pool_factor=1)
    index.index(_read(spark, sf_dir, PAGES).where("page_number = 1"))
    asked = _read(spark, sf_dir, "eval_items").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = index.search(asked, 10, pool_distance=0, cached=True)
    return found.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@_query()
def text_search_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with documents and queries pooled, as is the default."""
    index = LateIndex(spark, new_path(spark, "index"), HashingEncoder(4))
    index.index(_read(spark, sf_dir, PAGES))
    asked = _read(spark, sf_dir, "eval_items").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return index.search(asked, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@_query(f"""WITH t AS (SELECT row_id, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')) AS w FROM astra_multi_vector_table WHERE content IS NOT NULL),
    v AS (SELECT row_id, generate_subscripts(range(1, 5), 1) - 1 AS dim, unnest({_HASHED}) AS x FROM t)
    SELECT row_id, dim, round(avg(x::DOUBLE), 4) + 0 AS x FROM v GROUP BY row_id, dim""")
def encode_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every content that has words."""
    rows = encode_column(_read(spark, sf_dir, CHUNKS).select("row_id", "content"), "content", {"v": HashingEncoder(4)})
    worded = rows.where(F.regexp_like("content", F.lit(r"[\p{L}\p{N}]")))
    return worded.select("row_id", F.posexplode("v").alias("dim", "x")).select("row_id", "dim", (F.round(F.col("x").cast("double"), 4) + 0).alias("x"))


_COUNTED = f"""c AS (SELECT doc_id, count(*) AS n FROM late_interaction_tokens WHERE doc_id IS NOT NULL AND {_usable('token_embedding', 4)} AND len(list_filter(token_embedding, lambda x: NOT isfinite(x))) = 0 GROUP BY doc_id)"""


@_query(f"""WITH {_COUNTED} SELECT doc_id, n::INT AS original, {_POOLED} AS pooled FROM c""")
def pool_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens documents have before and after pooling: which tokens go together is tested against brute force."""
    return pooling.pooling_statistics(pooling.pool_documents(_read(spark, sf_dir, TOKENS), 4)).select("doc_id", "original", "pooled")


@_query(f"""WITH {_COUNTED}, p AS (SELECT n, {_POOLED} AS p FROM c) SELECT count(*) AS documents, sum(n)::BIGINT AS original, sum(p)::BIGINT AS pooled, round(sum(n) / sum(p), 9) AS total_reduction FROM p""")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pooling.pooling_summary(pooling.pool_documents(_read(spark, sf_dir, TOKENS), 4)).withColumn("total_reduction", F.round("total_reduction", 9))


@_query()
def pool_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _read(spark, sf_dir, "eval_items").select(F.col("item_id").alias("query_id"), "text")
    pooled = pooling.pool_queries(encode_tokens(asked, ["query_id"], "text", HashingEncoder(4)), 4, max_distance=0.1)
    return pooled.groupBy("query_id").agg(F.count("*").alias("tokens"))
