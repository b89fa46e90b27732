"""Pooling of token vectors: hand-written average-linkage and Ward clustering, in numpy, document by document."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import lists
from .knn import vectors_of


@dataclass
class Pooled:
    """Vectors after pooling, and what happened."""

    vectors: np.ndarray
    stats: dict = field(default_factory=dict)


def agglomerate(distance: np.ndarray, method: str, stop_count: int = 1, stop_distance: float = np.inf) -> np.ndarray:
    """Cluster labels: the two closest clusters are merged until `stop_count` are left or the closest are `stop_distance` or more apart.

    method: 'average' or 'ward', by the Lance-Williams update; for Ward the distances must be Euclidean. Each cluster's nearest
    neighbour is remembered, so a merge costs one pass over a row and over those whose neighbour it was. Ties: the pair with the
    smaller indices.
    """
    n = len(distance)
    d = distance.astype(np.float64) ** 2 if method == "ward" else distance.astype(np.float64).copy()
    limit = stop_distance**2 if method == "ward" else stop_distance
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    near = d.argmin(axis=1) if n > 1 else np.zeros(n, int)
    gap = d[np.arange(n), near] if n else np.empty(0)
    for _ in range(n - max(1, stop_count)):
        i = int(np.where(alive, gap, np.inf).argmin())
        j = int(near[i])
        if not gap[i] < limit:
            break
        i, j = min(i, j), max(i, j)
        if method == "ward":
            total = size[i] + size[j] + size
            new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / total
        else:
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
        near[i], gap[i] = new.argmin(), new.min()
        stale = np.flatnonzero(alive & ((near == i) | (near == j)) & (np.arange(n) != i))
        if len(stale):
            near[stale] = d[stale].argmin(axis=1)
            gap[stale] = d[stale, near[stale]]
        closer = np.flatnonzero(alive & (new < gap))
        near[closer], gap[closer] = i, new[closer]
    return np.unique(label, return_inverse=True)[1]


def ward(x: np.ndarray, count: int) -> np.ndarray:
    """Labels of the `count` clusters that Ward's method makes of the rows, in memory of a few times the rows.

    Chains of nearest neighbours are followed until two clusters are each other's nearest, which are merged; in order of their
    heights these merges are those of merging the closest pair first. A cluster is its mean and its size. Ties: the smaller index.
    """
    n = len(x)
    mean, size, alive = x.astype(np.float64).copy(), np.ones(n), np.ones(n, bool)
    square = np.einsum("ij,ij->i", mean, mean)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(alive.argmax()))
        while True:
            i = chain[-1]
            apart = np.maximum(square - 2 * (mean @ mean[i]) + square[i], 0) * (size * size[i] / (size + size[i]))
            apart[~alive] = np.inf
            apart[i] = np.inf
            j = int(apart.argmin())
            if len(chain) > 1 and apart[chain[-2]] <= apart[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        i, j, height = min(i, j), max(i, j), float(apart[j])
        merges.append((height, i, j))
        mean[i] = (size[i] * mean[i] + size[j] * mean[j]) / (size[i] + size[j])
        square[i] = mean[i] @ mean[i]
        size[i] += size[j]
        alive[j] = False
    # a cluster keeps its smaller index, and a merge is never lower than those that made its parts
    root = np.arange(n)
    for at in np.argsort([h for h, _, _ in merges], kind="stable")[: n - count]:
        root[merges[at][2]] = merges[at][1]
    while (root[root] != root).any():
        root = root[root]
    return np.unique(root, return_inverse=True)[1]


def cluster_means(v: np.ndarray, label: np.ndarray) -> np.ndarray:
    out = np.zeros((label.max() + 1, v.shape[1]))
    np.add.at(out, label, v)
    return out / np.bincount(label)[:, None]


def pool_query(v: np.ndarray, max_distance: float, min_clusters: int = 3) -> Pooled:
    """Query tokens closer than max_distance (cosine, average linkage) become their mean, of length 1; others stay as they are.

    Unchanged if max_distance is not positive, if there are no more than min_clusters tokens, or if fewer clusters would be left."""
    n = len(v)
    same = lambda why: Pooled(v, {"original": n, "pooled": n, "ratio": 1.0, "reason": why})
    if max_distance <= 0:
        return same("max_distance <= 0")
    if n <= min_clusters:
        return same("no more tokens than min_clusters")
    length = np.linalg.norm(v, axis=1, keepdims=True)
    unit = np.divide(v, length, out=np.zeros_like(v, np.float64), where=length > 0)
    label = agglomerate(1 - unit @ unit.T, "average", 1, max_distance)
    # clusters in order of their first members
    first = np.unique(label, return_index=True)[1]
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    label = rank[label]
    if len(first) < min_clusters:
        return same("fewer clusters than min_clusters")
    mean, count = cluster_means(v.astype(np.float64), label), np.bincount(label)
    norm = np.linalg.norm(mean, axis=1, keepdims=True)
    out = np.where((count[:, None] > 1) & (norm > 0), mean / np.where(norm > 0, norm, 1), mean)
    return Pooled(out, {"original": n, "pooled": len(out), "ratio": n / len(out), "cluster_sizes": count.tolist()})


def pool_document(v: np.ndarray, factor: int, min_tokens: int = 4, protected: int = 0) -> Pooled:
    """A document's tokens shrunk to about a `factor`-th by Ward clustering of their cosine-distance profiles; means are not rescaled.

    The first `protected` tokens are kept and come last. Unchanged if factor <= 1, if there are no more than min_tokens tokens, or
    fewer than protected + factor; or if fewer than min_tokens would be left."""
    if factor > 1 and int(factor) != factor:
        raise ValueError("factor must be a whole number")
    n = len(v)
    same = lambda why: Pooled(v, {"original": n, "pooled": n, "reason": why})
    if factor <= 1:
        return same("pool_factor <= 1")
    if n <= min_tokens:
        return same("no more tokens than min_tokens")
    if n < protected + factor:
        return same("fewer tokens than protected tokens and pool_factor")
    kept, rest = v[:protected], v[protected:].astype(np.float64)
    # Profiles 1 - rest @ x differ by rest @ (x - y), whose length is that of half @ (x - y) with half' half = rest' rest: as few numbers as
    # a token has, instead of one for each token.
    values, axes = np.linalg.eigh(rest.T @ rest)
    label = ward(rest @ (axes * np.sqrt(np.maximum(values, 0))), max(1, n // int(factor)))
    out = np.concatenate([cluster_means(rest, label), kept])
    if len(out) < min_tokens:
        return same("fewer tokens than min_tokens would be left")
    return Pooled(out, {"original": n, "pooled": len(out), "ratio": n / len(out), "cluster_sizes": np.bincount(label).tolist()})


def pool_documents(tokens: DataFrame, dim: int, factor: int = 2, min_tokens: int = 4, protected: int = 0) -> DataFrame:
    """(doc_id, position, token_embedding, n_original, n_cluster): each document's tokens, pooled; n_cluster: how many tokens a row stands for (1 for
    tokens that were kept). Their order is that of token_id.

    Vectors that are null, of another length or not finite are left out; rows without doc_id too. One document is one group: its
    tokens are bounded by its text."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("token_id", "ascending")])
        right, v = vectors_of(table.column("token_embedding"), dim)
        v = v[np.isfinite(v).all(axis=1)]
        done = pool_document(v, factor, min_tokens, protected) if len(v) else Pooled(np.empty((0, dim)))
        out, held = done.vectors, done.stats.get("cluster_sizes", [])
        doc = pa.array([table.column("doc_id")[0].as_py()] * len(out), pa.string())
        return pa.table([doc, pa.array(np.arange(len(out), dtype=np.int32)), lists(out), pa.array(np.full(len(out), len(v), np.int32)), pa.array(held + [1] * (len(out) - len(held)), pa.int32())], names=["doc_id", "position", "token_embedding", "n_original", "n_cluster"])

    picked = tokens.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("token_id").cast("string").alias("token_id"), "token_embedding").where("doc_id is not null")
    return picked.groupBy("doc_id").applyInArrow(run, "doc_id string, position int, token_embedding array<float>, n_original int, n_cluster int")


def pool_queries(query_tokens: DataFrame, dim: int, max_distance: float = 0.03, min_clusters: int = 3) -> DataFrame:
    """(query_id, position, token_embedding): each query's tokens, pooled."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("position", "ascending")])
        v = vectors_of(table.column("token_embedding"), dim)[1]
        out = pool_query(v, max_distance, min_clusters).vectors
        return pa.table([pa.array([table.column("query_id")[0].as_py()] * len(out), pa.int64()), pa.array(np.arange(len(out), dtype=np.int32)), lists(out.reshape(-1, dim))], names=["query_id", "position", "token_embedding"])

    return query_tokens.select(F.col("query_id").cast("long").alias("query_id"), "position", "token_embedding").where("query_id is not null").groupBy("query_id").applyInArrow(run, "query_id long, position int, token_embedding array<float>")


def pooling_statistics(pooled: DataFrame) -> DataFrame:
    """(doc_id, original, pooled, ratio, largest_cluster): of each document."""
    each = pooled.groupBy("doc_id").agg(F.max("n_original").alias("original"), F.count("*").alias("pooled"), F.max("n_cluster").alias("largest_cluster"))
    return each.select("doc_id", "original", "pooled", (F.col("original") / F.col("pooled")).alias("ratio"), "largest_cluster")


def pooling_summary(pooled: DataFrame) -> DataFrame:
    """(documents, original, pooled, total_reduction): over all pooled documents."""
    each = pooled.groupBy("doc_id").agg(F.max("n_original").alias("o"), F.count("*").alias("p"))
    return each.agg(F.count("*").alias("documents"), F.sum("o").alias("original"), F.sum("p").alias("pooled"), (F.sum("o") / F.greatest(F.sum("p"), F.lit(1))).alias("total_reduction"))


