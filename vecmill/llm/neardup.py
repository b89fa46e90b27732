"""Problem 4: near-duplicates, by Order MinHash candidates verified by banded alignment.

A sketch holds, for each of a number of hash functions, the `take` least occurrence-labelled k-mers of words in text order, two at
least: pairs of long k-mers, which few unrelated texts share, and triples of short ones for edits all over a text, also a short one.
Texts that share a band are candidates. An alignment of a pair's words within a band around the diagonal gives their edit distance;
as an edit touches k sequences of k words at most, few enough edits settle that the pair shares what is asked for, and so do runs of k
equal words at enough places of the band. Only of pairs that this leaves open (blocks moved, shifts beyond the band) are the
sequences themselves compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WordHashes, digest, materialize, words
from .copies import copy_key
from .omh import distinct_kmers, kmers, label, sketch


def texts(df: DataFrame, row_column: str, id_column: str, content_column: str, least_words: int) -> DataFrame:
    """(row_id, cls, copy, tokens): rows of enough words. cls: 64 bits of the word sequence; copy: key of formatting copies;
    tokens: 32 bits of each word, on a task's first row of each class only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for row, identifier, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                w = words(content)
                if len(w) < least_words:
                    continue
                cls = int.from_bytes(digest("\n".join(w))[:8], "little", signed=True)
                new = cls not in seen
                if len(seen) < 1_000_000:
                    seen.add(cls)
                for column, value in zip(out, (row, cls, None if identifier is None else copy_key(identifier, content, "".join(w)), (hashes(w) >> np.uint64(32)).astype("<u4").tobytes() if new else None), strict=True):
                    column.append(value)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["row_id", "cls", "copy", "tokens"])

    picked = df.select(F.col(row_column).cast("long").alias("row_id"), F.col(id_column).cast("string").alias("i"), F.col(content_column).cast("string").alias("c"))
    return picked.where("row_id is not null and length(c) >= " + str(2 * least_words - 1)).mapInArrow(run, "row_id long, cls long, copy binary, tokens binary")


def token_batches(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens end to end, and where each row starts."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    flat = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u4")
    return flat, (offsets - offsets[0]).astype(np.int64) // 4


def banded(classes: DataFrame, sketches: tuple[tuple[int, int, int], ...], seed: int, hot: np.ndarray | None = None, want: bool = False) -> DataFrame:
    """(band, cls): the sketches of every class. sketches: (words of a k-mer, k-mers of a band, bands) each.

    hot: sorted names of bands; only these come out if they are wanted, else all others."""
    total = sum(bands for _, _, bands in sketches)
    shared = None if hot is None else classes.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                flat, starts = token_batches(piece.column(1))
                flat, found = flat.astype(np.uint64), []
                for mer, take, bands in sketches:
                    h, first = kmers(flat, starts, mer)
                    found.append(sketch(label(h, first), first, bands, take, seed + 1000 * mer))
                band, cls = np.concatenate(found, axis=1).ravel(), np.repeat(piece.column(0).to_numpy(), total)
                if shared is not None and len(names := shared.value):
                    keep = (names[np.minimum(np.searchsorted(names, band), len(names) - 1)] == band) == want
                    band, cls = band[keep], cls[keep]
                yield pa.record_batch([pa.array(band), pa.array(cls)], names=["band", "cls"])

    return classes.select("cls", "tokens").mapInArrow(run, "band long, cls long")


def within(entries: DataFrame, name: str) -> DataFrame:
    """(a, b), a < b: classes that share a value of the column `name`. For values that few classes have."""
    ids = entries.groupBy(name).agg(F.array_sort(F.collect_set("cls")).alias("ids")).where(F.size("ids") > 1)
    return ids.select("ids", F.posexplode("ids").alias("at", "a")).select("a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("b"))


def hot_bands(firsts: DataFrame, sketches: tuple[tuple[int, int, int], ...], seed: int, block: int, every: int, most: int) -> np.ndarray:
    """Names of bands that many classes have, told by one class in `every`: a band of far more than block * every classes isn't missed.

    More than `most` of them: ValueError (a broadcast has a bound). Which bands are named doesn't change what is found."""
    some = firsts.where(F.pmod(F.xxhash64("cls", F.lit(seed)), F.lit(every)) == 0)
    names = banded(some, sketches, seed).groupBy("band").agg(F.approx_count_distinct("cls").alias("n")).where(F.col("n") > block).select("band")
    found = names.limit(most + 1).toArrow().column(0).to_numpy()
    if len(found) > most:
        raise ValueError(f"more than {most} hot bands")
    return np.sort(found)


def crowded(classes: DataFrame, k: int, threshold: float, block: int) -> DataFrame:
    """(a, b), a < b: of classes that share hot bands, the pairs that may reach the threshold; none that does is left out.

    The rarest k-word sequences tell: of two texts that reach it, one of the first |x| - ceil(threshold |x|) + 1 sequences of each, in
    one order of all sequences (the fewest classes first), is in the other, and their numbers of sequences are within the threshold of
    each other. So boilerplate that makes a band hot makes no pairs. A sequence that more than `block` classes have among their first is
    never held in one place: its classes are cut into blocks by hash, and each two blocks meet in a group of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                flat, starts = token_batches(piece.column(1))
                grams = distinct_kmers(flat.astype(np.uint64), starts, k)
                size = np.array([len(g) for g in grams], np.int32)
                yield pa.record_batch([pa.array(np.repeat(piece.column(0).to_numpy(), size)), pa.array(np.repeat(size, size)), pa.array(np.concatenate(grams).view(np.int64))], names=["cls", "size", "gram"])

    grams = materialize(classes.select("cls", "tokens").mapInArrow(run, "cls long, size int, gram long"), "p4-grams")
    known = grams.join(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "gram")
    mine = Window.partitionBy("cls")
    first = F.count("*").over(mine) - F.ceil(F.col("size") * F.lit(threshold)) + 1  # sequences that no other class has come before these
    ranked = known.withColumn("nth", F.row_number().over(mine.orderBy("n", "gram"))).withColumn("first", first)
    prefix = materialize(ranked.where("nth <= first").select("gram", "cls", "size", "n"), "p4-prefix")
    some = prefix.where(F.col("n") <= block).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("size", "cls"))).alias("ids")).where(F.size("ids") > 1)
    each = some.select("ids", F.posexplode("ids").alias("at", "x")).select("x", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("y"))
    parted = prefix.where(F.col("n") > block).withColumn("of", F.ceil(F.col("n") / block).cast("int")).withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("of")).cast("int"))
    meets = parted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    meets = meets.select("gram", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", F.struct("size", "cls").alias("c"))
    sides = meets.groupBy("gram", "i", "j").agg(F.collect_set(F.when(F.col("mine") == F.col("i"), F.col("c"))).alias("l"), F.collect_set(F.when(F.col("mine") == F.col("j"), F.col("c"))).alias("r"))
    met = sides.select("r", F.explode("l").alias("x")).select("x", F.explode("r").alias("y"))
    alike = each.unionByName(met).where((F.col("x.cls") != F.col("y.cls")) & (F.least("x.size", "y.size") >= F.lit(threshold) * F.greatest("x.size", "y.size")))
    return alike.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))


def candidates(firsts: DataFrame, classes: DataFrame, sketches: tuple[tuple[int, int, int], ...], seed: int, k: int, threshold: float, block: int = 24, every: int = 64, most_hot: int = 1_000_000) -> DataFrame:
    """(a, b), a < b: classes that share a band, each pair once; of those that share a hot band only, the ones crowded() leaves.

    firsts, classes: (cls, tokens); firsts may have a class more than once."""
    hot = hot_bands(firsts, sketches, seed, block, every, most_hot)
    out = within(banded(firsts, sketches, seed, hot if len(hot) else None), "band")
    if len(hot):
        members = banded(firsts, sketches, seed, hot, True).select("cls").distinct()
        out = out.unionByName(crowded(classes.join(members, "cls", "left_semi"), k, threshold, block * every))
    return out.distinct()


def alignments(x: np.ndarray, x_start: np.ndarray, y: np.ndarray, y_start: np.ndarray, width: int, most: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Of word sequences, pair by pair, the edit distance (-1 if it exceeds the pair's `most` or every path leaves the band), and how many
    of x's places have no run of k equal words in y within the band.

    x, y: the words of all pairs end to end, with where each starts and the total. Paths stay within `width` of the diagonal; an
    upper bound of the true distance, equal to it if that is at most `width`. For each number of edits and each diagonal it is kept how
    far in x these edits lead, runs of equal words being skipped at once.
    """
    n, m, xs, ys = np.diff(x_start), np.diff(y_start), x_start[:-1], y_start[:-1]
    out = np.full(len(n), -1)
    if not len(n):
        return out, out
    # one slot a word of x and one for its end, where no run goes on
    slot = np.concatenate([[0], np.cumsum(n + 1)])
    pair = np.repeat(np.arange(len(n)), n + 1)
    place = (np.arange(slot[-1]) - slot[:-1][pair]).astype(np.int32)
    left = np.where(place < n[pair], x[np.minimum(xs[pair] + place, len(x) - 1)].astype(np.int64), -1)
    right, length = ys[pair] + place, m[pair]
    stop = np.empty((2 * width + 1, len(pair)), np.int32)  # where the run of equal words from a slot on ends
    at = np.arange(len(pair), dtype=np.int32)
    for o in range(-width, width + 1):
        same = (left == y[np.clip(right + o, 0, len(y) - 1)]) & (place + o >= 0) & (place + o < length)
        stop[o + width] = np.minimum.accumulate(np.where(same, np.int32(len(pair)), at)[::-1])[::-1]
    apart = (place + k <= n[pair]) & ~(stop >= at + k).any(axis=0)
    loose = np.add.reduceat(apart, slot[:-1], dtype=np.int64)
    reach = np.arange(-width, width + 1)
    todo, d = np.flatnonzero((most >= 0) & (np.abs(m - n) <= np.minimum(width, most))), 0
    far = np.full((len(todo), 2 * width + 1), -(1 << 40))
    far[:, width] = 0
    while len(todo):
        start = slot[:-1][todo][:, None]
        there = far >= 0
        far = np.where(there, stop[np.arange(2 * width + 1)[None], start + np.maximum(far, 0)] - start, far)
        ended = far[np.arange(len(todo)), width + m[todo] - n[todo]] == n[todo]
        out[todo[ended]] = d
        keep = ~ended & (d < most[todo])
        todo, far, d = todo[keep], far[keep], d + 1
        if not len(todo):
            break
        none = np.full((len(todo), 1), -(1 << 40))
        change, drop, add = far + 1, np.concatenate([far[:, 1:] + 1, none], axis=1), np.concatenate([none, far[:, :-1]], axis=1)
        ends = np.minimum(n[todo][:, None], m[todo][:, None] - reach[None])
        far = np.minimum(np.maximum(np.maximum(change, drop), add), ends)
        far = np.where((far >= 0) & (far + reach[None] >= 0), far, -(1 << 40))
    return out, loose


def similar(pairs: DataFrame, classes: DataFrame, k: int, threshold: float, width: int) -> DataFrame:
    """(a, b, edits, aligned): the pairs whose share of common distinct k-word sequences is at least the threshold.

    A pair is aligned first. An edit touches at most k sequences of either text, so a pair with few edits shares enough of them, and so does
    one whose alignment has runs of k equal words at enough places (aligned: true; edits: null where there are more than would do). Of the
    others the sequences are compared. Texts of any length are aligned whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            size = np.maximum(*(np.diff(np.frombuffer(c.buffers()[1], np.int32, len(c) + 1, c.offset * 4)) for c in (big.column("x"), big.column("y")))) // 4
            order = np.argsort(size, kind="stable")  # texts of like length side by side, within a bound of memory
            cost, at = np.cumsum(size[order].astype(np.int64)), 0
            while at < len(order):
                end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + 200_000)))
                batch = big.take(pa.array(order[at:end]))
                at = end
                (x, xs), (y, ys) = (token_batches(batch.column(name)) for name in ("x", "y"))
                grams = [distinct_kmers(flat.astype(np.uint64), starts, k) for flat, starts in ((x, xs), (y, ys))]
                counts = np.array([[len(g) for g in side] for side in grams])
                needed = threshold / (1 + threshold) * counts.sum(axis=0)
                edits, loose = alignments(x, xs, y, ys, width, np.floor((counts.max(axis=0) - needed) / k + 1e-9).astype(np.int64), k)
                aligned = (edits >= 0) | (counts[0] - loose >= needed - 1e-9)
                good = aligned.copy()
                for i in np.flatnonzero(~good & (counts.min(axis=0) >= threshold * counts.max(axis=0))):
                    good[i] = len(np.intersect1d(grams[0][i], grams[1][i], assume_unique=True)) >= needed[i] - 1e-9
                keep = pa.array(good)
                yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(edits[good].astype(np.int32), mask=edits[good] < 0), pa.array(aligned[good])], names=["a", "b", "edits", "aligned"])

    one, two = (classes.select(F.col("cls").alias(i), F.col("tokens").alias(t)) for i, t in (("a", "x"), ("b", "y")))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long, edits int, aligned boolean")


class NearDuplicates:
    """Rows whose contents share at least `threshold` of their distinct sequences of `k` consecutive words.

    Rows with fewer than `least_words` words (so empty ones), null content or null row id take no part. Texts of the same words
    form one class, are compared once and are near-duplicates of each other. Contents are used whole. An empty table: no rows.
    """

    def __init__(self, df: DataFrame, row_column: str = "row_id", id_column: str = "chunk_id", content_column: str = "content", k: int = 3, threshold: float = 0.5, least_words: int = 20, sketches: tuple[tuple[int, int, int], ...] = ((7, 2, 16), (3, 3, 16)), block: int = 24, every: int = 64, width: int = 12, seed: int = 1) -> None:
        if least_words < max(k, *(mer + take - 1 for mer, take, _ in sketches)):
            raise ValueError("texts must have enough words for a sketch")
        self.rows = materialize(texts(df, row_column, id_column, content_column, least_words), "p4-rows")
        firsts = self.rows.where("tokens is not null")
        classes = firsts.groupBy("cls").agg(F.first("tokens").alias("tokens"))
        pairs = candidates(firsts, classes, sketches, seed, k, threshold, block, every)
        #: (a, b, edits, aligned) between classes
        self.links = materialize(similar(pairs, classes, k, threshold, width), "p4-links")

    def members(self) -> DataFrame:
        """(row_id, group_id, links): every row taking part; its class (the least row id of its word sequence) and the number of
        classes that class is linked to."""
        both = self.links.select(F.col("a").alias("cls")).unionByName(self.links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("links"))
        least = self.rows.groupBy("cls").agg(F.min("row_id").alias("group_id"))
        return self.rows.join(least, "cls").join(both, "cls", "left").select("row_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))

    def row_pairs(self, salt_rows: int = 10_000) -> DataFrame:
        """(row_id_a, row_id_b): every pair of rows that are near-duplicates but not formatting copies of one record.

        Both sides of both joins are salted by a class's number of rows, one salt for every `salt_rows`, as a class may hold many rows."""
        rows = self.rows.select("row_id", "cls", "copy")
        salts = rows.groupBy("cls").agg(F.count("*").alias("n")).select("cls", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"), "n")
        links = self.links.select("a", "b").unionByName(salts.where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b")))
        large = salts.where("salts > 1").select("cls", "salts")
        salted = rows.join(large, "cls", "left").withColumn("salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row_id"), F.col("salts")).cast("int"))).drop("salts")
        for side in ("a", "b"):
            wide = large.select(F.col("cls").alias(side), F.col("salts").alias("of_" + side))
            links = links.join(wide, side, "left").withColumn("salt_" + side, F.explode(F.sequence(F.lit(0), F.coalesce("of_" + side, F.lit(1)) - 1)))
        left, right = (salted.select(F.col("row_id").alias(r), F.col("cls").alias(side), F.col("copy").alias(r + "c"), F.col("salt").alias("salt_" + side)) for r, side in (("p", "a"), ("q", "b")))
        both = links.join(left, ["a", "salt_a"]).select("p", "pc", "a", "b", "salt_b").join(right, ["b", "salt_b"]).where("(a <> b or p < q) and p <> q and not coalesce(pc = qc, false)")
        return both.select(F.least("p", "q").alias("row_id_a"), F.greatest("p", "q").alias("row_id_b")).distinct()
