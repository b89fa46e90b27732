"""Late interaction: token hits, candidate documents, exact MaxSim, contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.params import CANDIDATES, TOKENS, expand_parameter
from ..functions.vectors import usable
from ..session import materialize
from .encoders import TokenEncoder, encode_tokens
from .knn import blocks_of, knn_join, unit_rows, vectors_of
from .pooling import pool_queries


def query_tokens(queries: DataFrame, encoder: TokenEncoder, text_column: str = "query", pool_distance: float = 0.03, min_clusters: int = 3) -> DataFrame:
    """(query_id, position, token_embedding): query texts encoded and pooled (not if pool_distance is not positive); null texts have none."""
    encoded = encode_tokens(queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), text_column), ["query_id"], text_column, encoder)
    return pool_queries(encoded, encoder.dim, pool_distance, min_clusters) if pool_distance > 0 else encoded


def fetch(table: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of a table whose key is among the ids, each once however often it is asked for."""
    return table.join(ids.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def document_tokens(ids: DataFrame, tokens: DataFrame, dim: int) -> DataFrame:
    """(doc_id, token_id, token_embedding) of the asked documents; one without a usable token stays, with nulls."""
    wanted = ids.select("doc_id").where("doc_id is not null").distinct()
    return wanted.join(tokens.where(usable(F.col("token_embedding"), dim)).select("doc_id", "token_id", "token_embedding"), "doc_id", "left")


def token_hits(query_tokens: DataFrame, tokens: DataFrame, n: int, dim: int, metric: str = "cosine") -> DataFrame:
    """(query_id, position, hit_rank, similarity, doc_id, token_id): the n stored tokens most similar to each query token.

    query_tokens: query_id long, position int, token_embedding. Hits without document are dropped after ranking."""
    flat = query_tokens.where("query_id is not null and position is not null").select(F.concat_ws(":", "query_id", "position").alias("query_id"), F.col("token_embedding").alias("vector"))
    hits = knn_join(flat, tokens, n, "token_embedding", dim, ["doc_id", "token_id"], metric=metric).where("doc_id is not null")
    parts = F.split("query_id", ":")
    return hits.select(parts[0].cast("long").alias("query_id"), parts[1].cast("int").alias("position"), "hit_rank", "similarity", "doc_id", "token_id")


def candidates(hits: DataFrame, m: int) -> DataFrame:
    """(query_id, candidate_rank, doc_id, stage1_score): the m documents with the largest sums, over query tokens, of their best hit.

    Query tokens that did not hit a document add nothing. Ties: the smaller doc_id."""
    best = hits.groupBy("query_id", "doc_id", "position").agg(F.max("similarity").alias("s"))
    score = best.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("stage1_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("stage1_score"), "doc_id")
    return score.withColumn("candidate_rank", F.row_number().over(order)).where(F.col("candidate_rank") <= m).select("query_id", "candidate_rank", "doc_id", "stage1_score")


def best_similarities(query_tokens: DataFrame, tokens: DataFrame, dim: int, pairs: DataFrame | None = None, block_rows: int = 4096) -> DataFrame:
    """(query_id, position, doc_id, best, n_tokens): the largest cosine between a query token and any token of a document, and how many
    tokens the document has.

    pairs: (query_id, doc_id) to look at; without it every query meets every document, in bounded blocks of query tokens. Each task
    sends on one row for each query token and document it has."""
    spark = tokens.sparkSession
    schema = "query_id long, position int, doc_id string, best double, n_tokens long"
    valid = tokens.select(F.col("doc_id").cast("string").alias("doc_id"), "token_embedding").where("doc_id is not null")
    everything = pairs is None
    if pairs is not None:
        valid = pairs.select(F.col("query_id").cast("long").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id")).distinct().join(valid, "doc_id")

    def scan(block: pa.Table) -> DataFrame:
        right, v = vectors_of(block.column("token_embedding"), dim)
        query, position = (block.column(c).to_numpy()[right] for c in ("query_id", "position"))
        order = np.lexsort((position, query))
        shared = spark.sparkContext.broadcast((query[order], position[order], unit_rows(v)[order]))

        def reduced(docs: pa.Array, v: np.ndarray, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
            query, position, q = shared.value
            codes = docs.dictionary_encode()
            inverse, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
            order = np.argsort(inverse, kind="stable")
            start = np.searchsorted(inverse[order], np.arange(len(names)))
            held = np.diff(np.append(start, len(order)))
            step = max(1, 4_000_000 // max(1, len(order)))
            for a in range(lo, hi, step):
                b = min(hi, a + step)
                top = np.maximum.reduceat(v[order] @ q[a:b].T, start, axis=0)
                yield pa.record_batch([pa.array(np.tile(query[a:b], len(names))), pa.array(np.tile(position[a:b], len(names))), names.take(pa.array(np.repeat(np.arange(len(names)), b - a))), pa.array(top.ravel()), pa.array(np.repeat(held, b - a))], names=["query_id", "position", "doc_id", "best", "n_tokens"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query = shared.value[0]
            for batch in batches:
                right, v = vectors_of(batch.column("token_embedding"), dim)
                if not len(right) or not len(query):
                    continue
                v, docs = unit_rows(v), batch.column("doc_id").take(pa.array(right))
                if everything:
                    yield from reduced(docs, v, 0, len(query))
                    continue
                asking = batch.column("query_id").take(pa.array(right)).to_numpy()
                for one in np.unique(asking):
                    lo, hi = np.searchsorted(query, [one, one + 1])
                    mine = np.flatnonzero(asking == one)
                    if hi > lo:
                        yield from reduced(docs.take(pa.array(mine)), v[mine], int(lo), int(hi))

        return valid.mapInArrow(run, schema)

    asked = query_tokens.where("query_id is not null and position is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("position").cast("int").alias("position"), "token_embedding")
    found = reduce(DataFrame.unionByName, map(scan, blocks_of(asked, block_rows)))
    return found.groupBy("query_id", "position", "doc_id").agg(F.max("best").alias("best"), F.sum("n_tokens").alias("n_tokens"))


def maxsim_score(best: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) out of best_similarities(): the sum over query tokens of the largest cosine to a token of the document.

    Documents are compared as if filled up with zero vectors to the longest of the query's set: in shorter ones no query token
    counts less than 0."""
    each = best.groupBy("query_id", "doc_id").agg(F.sum("best").alias("open"), F.sum(F.greatest("best", F.lit(0.0))).alias("filled"), F.max("n_tokens").alias("n_tokens"))
    # One row a query; a window would bring all documents of a query into one task.
    longest = each.groupBy(F.col("query_id")).agg(F.max("n_tokens").alias("longest"))
    each = each.join(longest, "query_id")
    score = F.when(F.col("n_tokens") < F.col("longest"), F.col("filled")).otherwise(F.col("open"))
    return each.select("query_id", "doc_id", F.round(score, 9).alias("score"))


def maxsim(query_tokens: DataFrame, tokens: DataFrame, dim: int, pairs: DataFrame | None = None) -> DataFrame:
    """maxsim_score() of best_similarities(). Zero, NaN and infinite vectors count as zero vectors.

    Without pairs there is a row for each query and document, and one for each query token and document is shuffled: for small sets."""
    return maxsim_score(best_similarities(query_tokens, tokens, dim, pairs))


def contents(documents: DataFrame) -> DataFrame:
    """(doc_id, content): the content of each document's last page; of equal page numbers the greatest content; null pages come first."""
    order = F.struct(F.coalesce("page_number", F.lit(-(2**31))), F.coalesce("content", F.lit("")))
    return documents.where("doc_id is not null").groupBy("doc_id").agg(F.max_by("content", order).alias("content"))


def search(query_tokens: DataFrame, tokens: DataFrame, documents: DataFrame, dim: int, k: int = 10, n_tokens: int | None = None, n_candidates: int | None = None, metric: str = "cosine", scorer: Callable[[DataFrame], DataFrame] = maxsim_score) -> DataFrame:
    """(query_id, rank, doc_id, score, content): the k documents with the largest MaxSim among the candidates of the first stage.

    scorer: makes (query_id, doc_id, score) out of the rows of best_similarities(), by default MaxSim. The metric rules the first stage only;
    MaxSim is always by cosine. Without numbers of token hits and candidates they follow from k.
    Documents without stored content have an empty one. Ties: the better candidate, then the smaller doc_id. Queries without tokens or hits
    have no rows."""
    if k < 1:
        raise ValueError("k must be at least 1")
    hits = token_hits(query_tokens, tokens, n_tokens or expand_parameter(k, *TOKENS), dim, metric)
    # A few rows a query, used twice: written once, so that the tokens are not scanned again for them.
    chosen = materialize(candidates(hits, n_candidates or expand_parameter(k, *CANDIDATES)), "candidates")
    scores = scorer(best_similarities(query_tokens, tokens, dim, chosen))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_rank", "doc_id")
    ranked = scores.join(chosen.select("query_id", "doc_id", "candidate_rank"), ["query_id", "doc_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(contents(documents), "doc_id", "left").select("query_id", "rank", "doc_id", "score", F.coalesce("content", F.lit("")).alias("content"))
