"""Problem 1: the k most similar vectors for every vector, by an inverted file with product-quantised residuals.

Coarse centroids on two levels. The upper level (cells) is fitted on the driver on a bounded sample and broadcast; its number
grows with the data so that a cell holds about `cell_rows` vectors, and where there are many, they are themselves found through
cells of cells. Every vector is stored in its nearest cell and asked of its `probe_cells` nearest cells. Within the task that owns a
cell, the lower level (lists) is fitted on a bounded sample of the cell's own vectors. A vector's residual to its list's centroid is
stored as its length and the product-quantised code of its direction: directions are alike in tight and in loose lists, so that one
set of codebooks, fitted once on the sample and broadcast, serves all. Each query scans the codes of all vectors in its `probe_lists`
nearest lists through asymmetric distance tables; the `rerank` best of all of them together are compared exactly, in double precision.
In its other cells, where few of its neighbours are, it scans `far_lists` lists and compares `far_rerank`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.clustering import best, kmeans, nearest
from .common import binary, digest, list_lengths, materialize, matrix, mix

DECIMALS = 9


def to_planes(v: np.ndarray) -> np.ndarray:
    """float32 rows with the bytes of equal weight together, which compress better."""
    return np.ascontiguousarray(v.astype("<f4").view(np.uint8).reshape(len(v), v.shape[1], 4).transpose(0, 2, 1)).reshape(len(v), 4 * v.shape[1])


def from_planes(column: pa.Array, dim: int) -> np.ndarray:
    planes = matrix(column, "u1", dim * 4).reshape(-1, 4, dim)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<f4").reshape(-1, dim)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; rows are scaled first, so that no square over- or underflows."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


class Codebooks:
    """Product quantiser of directions: `parts` subspaces with `words` codewords each, fitted on at most `word_rows` rows a codeword.

    Directions are turned at random before they are cut, and half of the rows are directions drawn at random: turned, directions of any
    kind are spread like these, so that what the sample shows too coarsely is still told apart."""

    def __init__(self, sample: np.ndarray, parts: int, words: int, rng: np.random.Generator, word_rows: int = 64) -> None:
        dim = sample.shape[1]
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0].astype(np.float32)
        self.cuts = np.linspace(0, dim, parts + 1).astype(int)
        half = word_rows * words // 2
        x = sample if len(sample) <= half else sample[rng.choice(len(sample), half, replace=False)]
        x = np.concatenate([x @ self.turn, directions(rng.normal(size=(half, dim)))[0]]).astype(np.float32)
        self.books = [kmeans(x[:, a:b], words, 6, rng, False) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def encode(self, rows: np.ndarray) -> np.ndarray:
        rows = rows @ self.turn
        return np.stack([nearest(rows[:, a:b], book, False) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]).astype(np.int32)

    def scores(self, turned: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimated inner products (codes x queries): one table of query times codeword for each subspace, added up by code.

        turned: queries @ turn."""
        total = np.zeros((codes.shape[1], len(turned)), np.float32)
        for m, book in enumerate(self.books):
            total += (book @ turned[:, self.cuts[m] : self.cuts[m + 1]].T)[codes[m]]
        return total


def directions(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals as directions of length 1 (zeros for zero) and lengths."""
    size = np.sqrt(np.einsum("ij,ij->i", residual, residual))
    return residual / np.where(size > 0, size, 1)[:, None], size


class Cells:
    """Coarse centroids for about `count` cells, fitted on a sample; beyond `flat` of them they are looked for through cells of cells."""

    def __init__(self, sample: np.ndarray, count: int, rng: np.random.Generator, flat: int = 256, probe_upper: int = 4) -> None:
        self.probe_upper = probe_upper
        self.upper = kmeans(sample, 1 if count <= flat else round(count**0.5), 10, rng, True)
        own = nearest(sample, self.upper, True)
        parts = []
        for i in range(len(self.upper)):
            members = sample[own == i] if (own == i).any() else self.upper[i : i + 1]
            centroids = kmeans(members, max(1, round(count * len(members) / len(sample))), 10, rng, True)
            held = np.bincount(nearest(members, centroids, True), minlength=len(centroids))
            bound = 2 * len(sample) / count  # a cell with more than twice its share of the sample is cut by centroids of its own
            for j in np.flatnonzero(held > bound):
                inside = members[nearest(members, centroids, True) == j]
                centroids = np.concatenate([centroids, kmeans(inside, round(2 * held[j] / bound), 10, rng, True)])
            parts.append(np.unique(centroids, axis=0))
        self.centroids = np.concatenate(parts)
        self.edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most similar cells of each row, the most similar first; -1 where there are fewer."""
        name, score = np.full((len(x), n), -1), np.full((len(x), n), -np.inf, np.float32)
        asked = best(x @ self.upper.T, self.probe_upper)
        for i in np.unique(asked):
            rows = np.flatnonzero((asked == i).any(axis=1))
            near = x[rows] @ self.centroids[self.edge[i] : self.edge[i + 1]].T
            top = best(near, n)
            both_name = np.concatenate([name[rows], top + self.edge[i]], axis=1)
            both = np.concatenate([score[rows], np.take_along_axis(near, top, 1)], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :n]
            name[rows], score[rows] = np.take_along_axis(both_name, order, 1), np.take_along_axis(both, order, 1)
        return name


class Lists:
    """A cell's vectors in lists: centroids fitted on at most `centre_rows` vectors a list, lengths and codes of the residuals.

    stored: unit rows in double precision; ids: their identifiers."""

    def __init__(self, stored: np.ndarray, ids: np.ndarray, list_rows: int, books: Codebooks, seed: int, centre_rows: int = 40) -> None:
        self.stored, self.ids, self.books = stored, ids, books
        rng = np.random.default_rng(seed)
        x = stored.astype(np.float32)
        lists = max(1, len(x) // list_rows)
        sample = x if len(x) <= centre_rows * lists else x[rng.choice(len(x), centre_rows * lists, replace=False)]
        self.coarse = kmeans(sample, lists, 8, rng, True)
        near = nearest(x, self.coarse, True)
        way, self.length = directions(x - self.coarse[near])
        self.codes = books.encode(way)
        self.order = np.argsort(near, kind="stable")
        self.edge = np.searchsorted(near[self.order], np.arange(len(self.coarse) + 1))

    def search(self, queries: np.ndarray, asking: np.ndarray, k: int, probe_lists: int, rerank: int, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query (unit rows, asking: their identifiers) the positions of its k most similar vectors (-1: none) and the similarities.

        A vector with the query's identifier is left out. Ties: the smaller identifier. Every vector in the query's lists is scored by
        its code, however few they are; the `rerank` best are compared exactly. seen: gets how many were scored and compared.
        """
        found, similarity = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf)
        for at in range(0, len(queries), 4096):
            own = slice(at, at + 4096)
            rows, there = self._shortlist(queries[own].astype(np.float32), probe_lists, rerank, seen)
            exact = np.concatenate([np.matmul(self.stored[rows[a : a + 256]], queries[own][a : a + 256, :, None])[:, :, 0] for a in range(0, len(rows), 256)])
            exact = np.where(there & (self.ids[rows] != asking[own][:, None]), np.round(exact, DECIMALS), -np.inf)
            near = best(exact, k)
            least = np.take_along_axis(exact, near, 1).min(axis=1, keepdims=True)
            if (many := (exact >= least).sum(axis=1) > near.shape[1]).any():  # ties at the edge: of these the smaller identifiers
                near[many] = np.lexsort((self.ids[rows[many]], -exact[many]), axis=1)[:, : near.shape[1]]
            n = near.shape[1]
            similarity[own, :n], found[own, :n] = np.take_along_axis(exact, near, 1), np.take_along_axis(rows, near, 1)
        return np.where(np.isfinite(similarity), found, -1), similarity

    def _shortlist(self, q: np.ndarray, probe_lists: int, rerank: int, seen: dict | None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the positions of the best by their codes, and which of them are there."""
        affinity, turned = q @ self.coarse.T, q @ self.books.turn
        probed = best(affinity, probe_lists)
        slots, lists = probed.shape[1], len(self.coarse)
        flat = np.argsort(probed.ravel(), kind="stable")
        begin = np.searchsorted(probed.ravel()[flat], np.arange(lists + 1))
        size = np.diff(self.edge)
        wide = min(int(size.max()), max(rerank, 5 * len(self.order) // (4 * lists)))  # longer lists send on no more than so many
        estimate, chosen = np.full((len(q), slots, wide), -np.inf, np.float32), np.zeros((len(q), slots, wide), np.int32)
        for one in np.flatnonzero((size > 0) & (np.diff(begin) > 0)):
            members = self.order[self.edge[one] : self.edge[one + 1]]
            who = flat[begin[one] : begin[one + 1]]
            rows, slot = who // slots, who % slots
            score = (self.books.scores(turned[rows], self.codes[:, members]) * self.length[members, None] + affinity[rows, one]).T
            if len(members) <= wide:
                estimate[rows, slot, : len(members)], chosen[rows, slot, : len(members)] = score, members
            else:
                keep = best(score, wide)
                estimate[rows, slot], chosen[rows, slot] = np.take_along_axis(score, keep, 1), members[keep]
            if seen is not None:
                seen["scored"] = seen.get("scored", 0) + score.size
        estimate, chosen = estimate.reshape(len(q), -1), chosen.reshape(len(q), -1)
        keep = best(estimate, rerank)
        there = np.isfinite(np.take_along_axis(estimate, keep, 1))
        if seen is not None:
            seen["compared"] = seen.get("compared", 0) + int(there.sum())
        return np.take_along_axis(chosen, keep, 1), there


def usable(df: DataFrame, id_column: str, vector_column: str, dim: int) -> DataFrame:
    """(row_id, key, vec): rows whose vector has `dim` elements, all finite and not all zero. key: 128 bits of the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            right = np.flatnonzero((list_lengths(column) == dim) & pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False))
            column, ids = column.take(pa.array(right)), batch.column(0).take(pa.array(right))
            flat = pc.cast(pc.fill_null(column.flatten(), float("nan")), pa.float32())
            v = flat.to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
            v = v[good] + np.float32(0)  # -0 is 0
            keys = pa.array([digest(x) for x in map(bytes, v.view(np.uint8).reshape(len(v), 4 * dim))], pa.binary())
            yield pa.record_batch([ids.filter(pa.array(good)), keys, binary(to_planes(v))], names=["row_id", "key", "vec"])

    picked = df.select(F.col(id_column).cast("long").alias("row_id"), F.col(vector_column).cast("array<float>").alias("v"))
    return picked.mapInArrow(run, "row_id long, key binary, vec binary")


def all_neighbours(
    df: DataFrame, id_column: str = "row_id", vector_column: str = "multi_embeddings", dim: int = 64, k: int = 5, cell_rows: int = 12_000, list_rows: int = 80, probe_cells: int = 3, probe_lists: int = 8, rerank: int = 56, far_lists: int = 3, far_rerank: int = 20, sample_rows: int = 65_536, most_sample_rows: int = 1_048_576, parts: int = 32, words: int = 256, seed: int = 7, word_rows: int = 64, centre_rows: int = 40
) -> DataFrame:
    """(row_id, neighbour_id, similarity): the k most similar other rows of every row with a usable vector.

    Similarity: cosine in double precision, rounded to nine decimals; equally similar: the smaller id. A vector is usable if it
    is not null, has `dim` elements, all finite, and is not all zero; other rows, and rows without id, neither ask nor answer.
    Rows with equal vectors are searched once and count as separate answers; ids are taken as unique. Fewer than k+1 usable rows:
    all others come out. An empty table: no rows. Extra columns are ignored.

    The cells and the codebooks are fitted on about `sample_rows` vectors, or eight a cell if that is more, and no more than
    `most_sample_rows`; the codebooks on at most `word_rows` of them a codeword; within a cell the lists are fitted on at most
    `centre_rows` vectors a list. These are bounds of the fitting; all vectors are encoded and indexed.

    There is no bound on the number of cells but an eighth of the sample: with the largest sample cells hold `cell_rows` vectors up to
    1.5 billion rows, more beyond. Dense regions get as many centroids as their vectors call for. A cell that the sample takes to hold
    over four times `cell_rows` vectors is stored in slices, one of over twelve times as many queries is asked in portions; a group is a slice
    and a portion, so that neither side of it is unbounded.
    """
    spark = df.sparkSession
    schema = "row_id long, neighbour_id long, similarity double"
    rows = materialize(usable(df, id_column, vector_column, dim), "p1-rows")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], schema)
    # A row's id is never among more than k+1 copies that matter; one more tells that there are others.
    nth = F.row_number().over(Window.partitionBy("key").orderBy("row_id"))
    firsts = rows.withColumn("nth", nth).where(F.col("nth") <= k + 2)
    distinct = firsts.groupBy("key").agg(F.array_sort(F.collect_list("row_id")).alias("ids"), F.min("vec").alias("vec"))

    share = min(1.0, min(max(sample_rows, 8 * total // cell_rows), most_sample_rows) / total)
    drawn = rows if share == 1 else rows.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    drawn = drawn.select("key", "vec").distinct().orderBy("key").select("vec").toArrow().column(0).combine_chunks()
    sample = unit(from_planes(drawn, dim)).astype(np.float32) if len(drawn) else np.eye(1, dim, dtype=np.float32)
    rng = np.random.default_rng(seed)
    cells = Cells(sample, max(1, min(round(total / cell_rows), len(sample) // 8)), rng)
    asked = cells.nearest(sample, probe_cells)
    per = total / len(sample)
    count = lambda names: np.bincount(names[names >= 0], minlength=len(cells.centroids)) * per
    slices = np.maximum(1, np.ceil(count(asked[:, 0]) / (4 * cell_rows))).astype(np.int64)
    portions = np.maximum(1, np.ceil(count(asked.ravel()) / (12 * cell_rows))).astype(np.int64)
    # Directions of residuals for the codebooks: of the sample, to centroids of as few sampled rows as lists have fitting rows.
    fine = Cells(sample, max(1, len(sample) // centre_rows), rng)
    books = Codebooks(directions(sample - fine.centroids[fine.nearest(sample, 1)[:, 0]])[0], parts, words, rng, word_rows)
    shared = spark.sparkContext.broadcast((cells, slices, portions))  # an eighth of the sample at most

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, slices, portions = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            asked = cells.nearest(unit(from_planes(batch.column("vec"), dim)).astype(np.float32), probe_cells)
            lead = mix(pc.list_element(batch.column("ids"), 0).to_numpy(zero_copy_only=False).astype(np.uint64))
            row, slot = np.nonzero(asked >= 0)
            cell = asked[row, slot]
            n, m = slices[cell], portions[cell]
            size = n * m
            at = np.repeat(np.arange(len(row)), size)
            part = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            row, slot, cell, n, m = row[at], slot[at], cell[at], n[at], m[at]
            mine = lead[row]
            stored = (slot == 0) & (part // m == ((mine >> np.uint64(32)) % n.astype(np.uint64)).astype(np.int64))
            asks = part % m == ((mine & np.uint64(0xFFFFFFFF)) % m.astype(np.uint64)).astype(np.int64)
            use = np.flatnonzero(stored | asks)
            at = pa.array(row[use])
            yield pa.record_batch(
                [pa.array(cell[use].astype(np.int32)), pa.array(part[use].astype(np.int32)), pa.array(stored[use]), pa.array(asks[use]), pa.array(slot[use] == 0), pc.cast(batch.column("ids").take(at), pa.list_(pa.int64())), batch.column("vec").take(at)],
                names=["cell", "part", "stored", "asks", "home", "ids", "vec"],
            )

    answer = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("near", T.ArrayType(T.LongType())), T.StructField("similarity", T.DoubleType())])

    def search(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        name = pc.list_element(ids, 0).to_numpy(zero_copy_only=False)
        v = unit(from_planes(table.column("vec").combine_chunks(), dim))
        held, asking = (np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("stored", "asks"))
        if not len(held):
            return pa.table([pa.array([], ids.type), pa.array([], ids.type), pa.array([], pa.float64())], names=["ids", "near", "similarity"])
        lists = Lists(v[held], name[held], list_rows, books, seed, centre_rows)
        home = table.column("home").to_numpy(zero_copy_only=False)
        out = []
        for who, lists_asked, compared in ((asking[home[asking]], probe_lists, rerank), (asking[~home[asking]], far_lists, far_rerank)):
            if len(who):
                found, similarity = lists.search(v[who], name[who], k, lists_asked, compared)
                row, slot = np.nonzero(found >= 0)
                out.append(pa.table([ids.take(pa.array(who[row])), ids.take(pa.array(held[found[row, slot]])), pa.array(similarity[row, slot])], names=["ids", "near", "similarity"]))
        return pa.concat_tables(out)

    routed = distinct.mapInArrow(route, "cell int, part int, stored boolean, asks boolean, home boolean, ids array<long>, vec binary")
    hits = routed.groupBy("cell", "part").applyInArrow(search, answer)
    # Of all vectors only the k nearest can matter; each answers with its least k+1 ids at most.
    entry = lambda s, i: F.struct((-s).alias("s"), i.alias("i"))
    lead = F.element_at("ids", 1)
    ranked = hits.withColumn("lead", lead).withColumn("nth", F.row_number().over(Window.partitionBy("lead").orderBy(F.desc("similarity"), F.element_at("near", 1)))).where(F.col("nth") <= k)
    others = ranked.groupBy("lead").agg(F.flatten(F.collect_list(F.transform(F.slice("near", 1, k), lambda i: entry(F.col("similarity"), i)))).alias("others"))
    # Vectors without hits (a lone usable vector with copies) still have their copies.
    known = distinct.select("key", "ids", lead.alias("lead")).join(others, "lead", "left")
    offers = known.select("key", "ids", F.array_sort(F.concat(F.coalesce("others", F.array().cast("array<struct<s:double,i:bigint>>")), F.transform("ids", lambda i: entry(F.lit(1.0), i)))).alias("offers"))
    few = offers.select(F.explode(F.slice("ids", 1, k + 1)).alias("row_id"), "offers").select("row_id", F.explode(F.slice(F.filter("offers", lambda o: o.i != F.col("row_id")), 1, k)).alias("o"))
    # Copies beyond the first k+1 of a vector all get the same answer. Their vector may hold a third of all rows: both sides are salted.
    salts = 16
    many = offers.where(F.size("ids") > k + 1).select("key", F.slice("ids", 1, k + 1).alias("ids"), F.slice("offers", 1, k).alias("offers"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rest = rows.select("key", "row_id", F.pmod(F.xxhash64("row_id"), F.lit(salts)).cast("int").alias("salt")).join(many, ["key", "salt"])
    rest = rest.where(~F.array_contains("ids", F.col("row_id"))).select("row_id", F.explode("offers").alias("o"))
    return few.unionByName(rest).select("row_id", F.col("o.i").alias("neighbour_id"), (-F.col("o.s")).alias("similarity"))


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b): each pair of which one is among the other's neighbours, once, smaller id first."""
    return neighbours.select(F.least("row_id", "neighbour_id").alias("row_id_a"), F.greatest("row_id", "neighbour_id").alias("row_id_b")).distinct()


