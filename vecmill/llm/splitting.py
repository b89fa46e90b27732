"""Problem 5: cutting oversized texts into pieces by agglomerative merging of atomic segments."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ends of atoms, the stronger alternative first: blank lines; sentence ends; single line breaks, blanks and East Asian commas.
_END = re.compile(r"(\s*\n[^\S\n]*\n\s*)|((?<=[.!?…])[\"'”’»)\]]*\s+|(?<=[。！？])[」』）]*\s*)|(\s+|(?<=[、，；]))")
INSIDE, WORD, SENTENCE, PARAGRAPH = range(4)


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Where atoms end, and how strong the boundary at each end is. Atoms of more than `most` characters are cut hard."""
    ends, strength, at = [], [], 0
    for m in _END.finditer(text):
        end = m.end()
        if end <= at:
            continue
        while end - at > most:
            at += most
            ends.append(at)
            strength.append(INSIDE)
        kind = PARAGRAPH if m[1] is not None else SENTENCE if m[2] is not None else WORD
        if at == end:
            strength[-1] = kind
        else:
            ends.append(end)
            strength.append(kind)
        at = end
    while at < len(text):
        at = min(len(text), at + most)
        ends.append(at)
        strength.append(INSIDE)
    return ends, strength


def split_text(text: str, max_chars: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces: none longer than max_chars, each but the first beginning `overlap` characters before the end
    of the one before it, all together the whole text.

    Weakest boundaries are merged first, among equal ones the smallest result, then the leftmost, while the result with its
    overlap fits. An overlap of max_chars or more counts as max_chars - 1; a negative one as 0.
    """
    if len(text) <= max_chars:
        return [(0, len(text))]
    overlap = max(0, min(overlap, max_chars - 1))
    room = max_chars - overlap
    ends, strength = atoms(text, room)
    while len(ends) > 1 and ends[0] < overlap:  # the first piece has to hold the overlap that the second one repeats
        del ends[0], strength[0]
    n = len(ends)
    start = [0, *ends[:-1]]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strength[i], ends[i + 1] - start[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, left, right = heapq.heappop(heap)
        if not alive[left] or not alive[right] or ends[right] - start[left] != size:
            continue
        if size > (max_chars if left == 0 else room):
            continue  # pieces only grow: these two never fit
        # the right one lives on in the left one
        ends[left], strength[left] = ends[right], strength[right]
        alive[right] = False
        after[left] = after[right]
        if after[left] < n:
            before[after[left]] = left
            heapq.heappush(heap, (strength[left], ends[after[left]] - start[left], left, after[left]))
        if left > 0:
            heapq.heappush(heap, (strength[before[left]], ends[left] - start[before[left]], before[left], left))
    pieces, i = [], 0
    while i < n:
        pieces.append((start[i] - (overlap if i else 0), ends[i]))
        i = after[i]
    return pieces


def split_oversized(df: DataFrame, limits: DataFrame, row_column: str = "row_id", content_column: str = "content", group_column: str = "book_name", most_broadcast: int = 100_000) -> DataFrame:
    """(row_id, piece, pieces, start_char, end_char, piece_text): the pieces of every row whose content exceeds its group's limit.

    limits: (group, max_chars, overlap_chars). Rows with null content, of a group without limit, or with a limit that is null or
    below 1, are not oversized; a null overlap counts as 0; of several limits of one group the least holds. The limits are
    broadcast if they are at most `most_broadcast` rows. Rows that come twice are cut twice. Texts are cut whole.
    """
    if limits.columns != ["group", "max_chars", "overlap_chars"]:
        raise ValueError("limits must have the columns group, max_chars, overlap_chars")
    limit = limits.where("group is not null and max_chars >= 1").groupBy("group").agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))).alias("l"))
    limit = limit.select(F.col("group").alias("__group"), F.col("l.max_chars").cast("int").alias("__most"), F.col("l.overlap_chars").cast("int").alias("__overlap"))
    if limits.limit(most_broadcast + 1).count() <= most_broadcast:
        limit = F.broadcast(limit)
    picked = df.select(F.col(row_column).cast("long").alias("row_id"), F.col(content_column).cast("string").alias("c"), F.col(group_column).alias("__group"))
    large = picked.join(limit, "__group").where(F.length("c") > F.col("__most")).select("row_id", "c", "__most", "__overlap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                out: list[list] = [[] for _ in range(6)]
                for row, text, most, overlap in zip(*(x.to_pylist() for x in piece.columns), strict=True):
                    cuts = split_text(text, most, overlap)
                    for i, (a, z) in enumerate(cuts):
                        for column, value in zip(out, (row, i, len(cuts), a, z, text[a:z]), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["row_id", "piece", "pieces", "start_char", "end_char", "piece_text"])

    return large.mapInArrow(run, "row_id long, piece int, pieces int, start_char int, end_char int, piece_text string")
