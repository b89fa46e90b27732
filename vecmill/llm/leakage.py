"""Problem 6: evaluation texts inside a corpus, by a broadcast set of normalised n-grams and a scan of all token windows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, materialize, mix, words

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


@dataclass
class Grams:
    """The n-grams of some test items: word ids by word, and for each length the sorted hashes with their word ids and items."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    by_length: dict[int, tuple[np.ndarray, np.ndarray, list[list[int]]]] = field(default_factory=dict)
    seen: np.ndarray = field(default_factory=lambda: np.zeros(1 << _BITS, bool))


def chain(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """For n = 1, 2, ... the hashes of all windows of n word ids."""
    w = ids.astype(np.uint64) * _STEP
    h = np.zeros(len(ids), np.uint64)
    for n in range(1, min(longest, len(ids)) + 1):
        h = mix(h[: len(ids) - n + 1] + w[n - 1 :])
        yield n, h


def build(items: list[tuple[int, list[str]]], n: int) -> Grams:
    """The grams of n words of each item, or of all its words if it has fewer. Items without words have none.

    An item may come in several parts that overlap by n - 1 words."""
    g = Grams()
    grams: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for item, tokens in items:
        ids = [g.vocabulary.setdefault(w, len(g.vocabulary) + 1) for w in tokens]
        size = min(n, len(ids))
        for i in range(len(ids) - size + 1 if size else 0):
            grams.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).add(item)
    for size, found in grams.items():
        rows = np.array(list(found), np.int64).reshape(-1, size)
        h = np.zeros(len(rows), np.uint64)
        for j in range(size):
            h = mix(h + rows[:, j].astype(np.uint64) * _STEP)
        order = np.argsort(h, kind="stable")
        owners = [sorted(x) for x in found.values()]
        g.by_length[size] = (h[order], rows[order], [owners[i] for i in order])
        g.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return g


def find(g: Grams, texts: list[list[str]]) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, words) of every gram found in the texts."""
    flat = np.zeros(sum(map(len, texts)) + len(texts), np.int64)
    starts, at = np.empty(len(texts), np.int64), 0
    for i, tokens in enumerate(texts):
        starts[i] = at
        flat[at : at + len(tokens)] = np.fromiter(map(g.vocabulary.get, tokens, repeat(0)), np.int64, len(tokens))
        at += len(tokens) + 1  # id 0 is no word of any item, so no window reaches over a text's end
    out = []
    for n, h in chain(flat, max(g.by_length, default=0)):
        if n not in g.by_length:
            continue
        hashes, rows, owners = g.by_length[n]
        maybe = np.flatnonzero(g.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        for which in range(2):  # equal hashes of different grams would be neighbours; the second pass takes the other one
            at = np.searchsorted(hashes, h[maybe]) + which
            inside = at < len(hashes)
            p, q = maybe[inside], at[inside]
            p, q = p[hashes[q] == h[p]], q[hashes[q] == h[p]]
            if len(p):
                same = (flat[p[:, None] + np.arange(n)] == rows[q]).all(axis=1)
                text = np.searchsorted(starts, p, side="right") - 1
                out += [(int(t), item, int(s - starts[t]), n) for t, s, row in zip(text[same], p[same], q[same], strict=True) for item in owners[row]]
    return out


def gram_blocks(items: DataFrame, n: int, item_column: str, item_text_column: str, block_grams: int) -> Iterator[Grams]:
    """The items' grams, at most `block_grams` at a time: items are read one after the other, and one that has more is split over blocks.

    The driver holds one block and one partition of the items. Without items there is one empty block."""
    block, room, any_block = [], block_grams, False
    listed = items.select(F.col(item_column).cast("long").alias("i"), F.col(item_text_column).cast("string").alias("t")).dropna()
    for row in listed.toLocalIterator():
        tokens = words(row.t)
        size = min(n, len(tokens))
        at, grams = 0, len(tokens) - size + 1 if size else 0
        while at < grams:
            take = min(room, grams - at)
            block.append((row.i, tokens[at : at + take + size - 1]))
            at, room = at + take, room - take
            if not room:
                yield build(block, n)
                block, room, any_block = [], block_grams, True
    if block or not any_block:
        yield build(block, n)


def leaked_spans(documents: DataFrame, items: DataFrame, n: int = 12, doc_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", block_grams: int = 500_000) -> DataFrame:
    """(doc_id, text_key, item_id, first_word, n_words): every place where n consecutive words of an item (all, if it has fewer) occur one
    after another as words of a document.

    The items' grams are broadcast in blocks of at most `block_grams`, each of which scans the documents once. If there are several, a
    block's finds are written before the next block is read and broadcast, so that driver and executors hold one block whatever the
    number and size of the items. Items and documents with null id, null text or no words have no hits. Texts are scanned
    whole. Documents given twice are reported twice; text_key, a hash of the text, tells different texts of one id apart.
    """
    spark = documents.sparkSession
    schema = "doc_id long, text_key long, item_id long, first_word int, n_words int"
    picked = documents.select(F.col(doc_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("t")).dropna().withColumn("text_key", F.xxhash64("t"))

    def scan(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    piece = batch.slice(at, 1024)
                    hits = find(g, [words(t) for t in piece.column(1).to_pylist()])
                    columns = list(zip(*hits, strict=True)) or [()] * 4
                    at_text = pa.array(columns[0], pa.int64())
                    yield pa.record_batch([piece.column(0).take(at_text), piece.column(2).take(at_text), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["doc_id", "text_key", "item_id", "first_word", "n_words"])

        return picked.mapInArrow(run, schema)

    found, last = [], None
    for block in gram_blocks(items, n, item_column, item_text_column, block_grams):
        if last is not None:
            found.append(materialize(scan(last), "p6-spans"))
            last.destroy()
        last = spark.sparkContext.broadcast(block)
    found.append(materialize(scan(last), "p6-spans") if found else scan(last))
    return reduce(DataFrame.unionByName, found)


def leaked_pairs(spans: DataFrame) -> DataFrame:
    """(doc_id, item_id), once each."""
    return spans.select("doc_id", "item_id").distinct()


def cut_out(text: str, bad: list[int], mark: str) -> str:
    """A text without the words of these numbers (in order, each once) and what lies between them."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last, i = [], 0, 0
    while i < len(bad):
        j = i
        while j + 1 < len(bad) and bad[j + 1] == bad[j] + 1:
            j += 1
        out += [text[last : at[bad[i]][0]], mark]
        last, i = at[bad[j]][1], j + 1
    return "".join(out) + text[last:]


def without_leaks(documents: DataFrame, items: DataFrame, n: int = 12, doc_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", block_grams: int = 500_000, mark: str = " ") -> DataFrame:
    """(doc_id, clean_text, removed_words): every document; leaked word spans (those of leaked_spans) and what lies between their words
    are cut out.

    Cut where they are found: the documents are read once and no text is shuffled. Each block of grams adds its word numbers to the
    rows it gets and the last one cuts. A document given twice is cleaned in both copies. Null texts stay null; empty items cut nothing.
    """
    spark = documents.sparkSession

    def scan(df: DataFrame, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    piece = batch.slice(at, 1024)
                    cuts = [set(c or ()) for c in piece.column(2).to_pylist()]
                    for text, _, first, size in find(g, [words(t or "") for t in piece.column(1).to_pylist()]):
                        cuts[text].update(range(first, first + size))
                    yield pa.record_batch([piece.column(0), piece.column(1), pa.array([sorted(c) for c in cuts], pa.list_(pa.int32()))], names=["doc_id", "t", "cuts"])

        return df.mapInArrow(run, "doc_id long, t string, cuts array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(2).to_pylist()
            texts = [cut_out(t, c, mark) if c else t for t, c in zip(batch.column(1).to_pylist(), cuts, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string()), pa.array([len(c) for c in cuts], pa.int32())], names=["doc_id", "clean_text", "removed_words"])

    found = documents.select(F.col(doc_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("t"), F.lit(None).cast("array<int>").alias("cuts"))
    for block in gram_blocks(items, n, item_column, item_text_column, block_grams):
        found = scan(found, spark.sparkContext.broadcast(block))
    return found.mapInArrow(cut, "doc_id long, clean_text string, removed_words int")
