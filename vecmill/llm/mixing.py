"""Problem 7: mixing sources to target weights, by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The public pattern of the byte-level vocabulary: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_loaded: dict = {}


def encoding(folder: str, vocabulary: str):
    """The tokenizer, loaded once in each process."""
    if (folder, vocabulary) not in _loaded:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(folder, vocabulary).read_bytes().splitlines())}
        _loaded[folder, vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[folder, vocabulary]


def spelled_alike(source: Column) -> Column:
    """A source's name without differences of case, hyphens, underscores and blanks; null if nothing is left."""
    bare = F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", bare)


def token_counts(df: DataFrame, id_column: str, text_column: str, source_column: str, tokenizers: str, vocabulary: str) -> DataFrame:
    """(doc_id, source, tokens) of the documents that have an id, a source and a text that is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizers, vocabulary).encode_ordinary
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(encode(t)) for t in batch.column(2).to_pylist()], pa.int64())], names=["doc_id", "source", "tokens"])

    picked = df.select(F.col(id_column).cast("long").alias("doc_id"), spelled_alike(F.col(source_column)).alias("source"), F.col(text_column).cast("string").alias("t"))
    return picked.where("doc_id is not null and source is not null and t <> ''").mapInArrow(run, "doc_id long, source string, tokens long")


def sainte_lague(seats: int, weights: dict, capacity: dict) -> dict:
    """Seats for each party: one by one to the highest weight / (2 * seats + 1), until a party's capacity is full.

    Ties: the smaller name. Fewer seats than asked for if all capacities are full. All seats with a quotient above some bound are
    given at once, the bound being found by bisection, so that the time doesn't grow with the number of seats.
    """
    parties = [p for p, w in weights.items() if w > 0 and capacity[p] > 0]
    seats = min(seats, sum(capacity[p] for p in parties))
    got = dict.fromkeys(weights, 0)
    if seats <= 0:
        return got

    def above(quotient: float) -> dict:
        return {p: min(capacity[p], max(0, math.ceil((weights[p] / quotient + 1) / 2) - 1)) for p in parties}

    low, high = min(weights[p] / (2 * capacity[p] + 1) for p in parties) / 2, 2 * max(weights[p] for p in parties)
    for _ in range(200):  # `high` gives no more than there are
        middle = math.sqrt(low) * math.sqrt(high)
        if not low < middle < high:
            break
        low, high = (low, middle) if sum(above(middle).values()) <= seats else (middle, high)
    got |= above(high * (1 + 1e-9))  # clear of the rounding of the quotients at the bound
    heap = [(-weights[p] / (2 * got[p] + 1), p) for p in parties if got[p] < capacity[p]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got.values())):
        _, p = heapq.heappop(heap)
        got[p] += 1
        if got[p] < capacity[p]:
            heapq.heappush(heap, (-weights[p] / (2 * got[p] + 1), p))
    return got


def shard_quotas(seats: int, blocks: int, size: int, repeats: int) -> tuple[int, int, int]:
    """What sainte_lague gives the shards of a source that has `blocks` blocks, `size` in each shard but the last: the first shards (as
    many as the second number) get one more than the first number, the other full ones that many, the last shard the third number.

    All shards are full but perhaps the last, so one search over the last one's seats does, whatever the number of shards.
    """
    full, rest = divmod(blocks, size)
    if not rest:
        every, more = divmod(seats, max(1, full))
        return every, more, 0

    def before(last: int) -> int:
        """Seats the full shards have when the last shard gets its seat of that number; equal quotients go to the smaller shard."""
        return full * min((size * (2 * last - 1) + rest) // (2 * rest), size * repeats)

    least, most = 0, min(seats, rest * repeats)
    while least < most:
        middle = (least + most + 1) // 2
        least, most = (middle, most) if before(middle) + middle <= seats else (least, middle - 1)
    every, more = divmod(seats - least, full) if full else (0, 0)
    return every, more, least


class Mixture:
    """Documents drawn so that each source reaches its target share of all tokens.

    A source's documents are put in a seeded order and cut, over the whole source, into blocks of `width` tokens (a document belongs
    to the block in which it begins), so that a source has as many blocks as its tokens make, however many documents, partitions and
    shards there are; only its last block is short. The width is a `least_blocks`-th of the smallest source. The blocks of a source
    lie in shards of `shard_blocks`, or more if these hold fewer than `shard_documents` documents on average. Blocks are apportioned to the sources by Sainte-Lague over the target shares, at most `max_repeats`
    times a source's blocks, and a source's quota to its shards in the same way. In a shard every block is taken quota/blocks times,
    and the remainder once more: as many blocks in a row, from a seeded one on. The documents lie in a seeded order, so a row of
    blocks is a random draw, and only its two ends, not each block's, may be a document off.

    The number of blocks drawn is the largest at which no source with documents falls short of its share, or that for
    `total_tokens`. Targets of sources without documents can't be reached; the other sources keep their proportions. A document comes
    at most max_repeats times; one given several times counts once, with the least source name and token count. Documents
    with null id, text or source, with an empty text, or of a source without target, are not drawn; targets with a null, zero or
    negative share or fewer than one repeat count as no target; of several targets of a source the first by share holds. Empty
    tables: nothing is drawn.

    On the driver there is one row a source with target, at most `most_sources`. The rows shuffled are ids and counts, not texts; a
    source of any size is spread over buckets of about `bucket_documents` documents.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, least_blocks: int = 64, shard_blocks: int = 256, shard_documents: int = 4096, bucket_documents: int = 20_000, seed: int = 1, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, most_sources: int = 10_000) -> None:
        spark = documents.sparkSession
        named = targets.select(spelled_alike(F.col("source")).alias("source"), F.col("source").alias("label"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
        rows = named.where("source is not null and target_share > 0 and max_repeats >= 1").limit(most_sources + 1).collect()
        if len(rows) > most_sources:
            raise ValueError(f"more than {most_sources} sources")
        self.targets = {}
        for r in sorted(rows, key=lambda r: (r.source, r.target_share, r.label, r.max_repeats)):
            self.targets.setdefault(r.source, r)
        wanted = spark.createDataFrame([(s,) for s in self.targets], "source string")
        counted = token_counts(documents, id_column, text_column, source_column, tokenizers, vocabulary).join(F.broadcast(wanted), "source")
        once = materialize(counted.groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("d")).select("doc_id", "d.source", "d.tokens"), "p7-tokens")
        size = {r.source: r for r in once.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}  # one row a target at most
        have = {s: r.t for s, r in size.items() if r.t > 0}
        #: tokens of a block
        self.width = max(1, min(have.values(), default=1) // least_blocks)
        blocks = {s: -(-t // self.width) for s, t in have.items()}
        shares = {s: self.targets[s].target_share for s in have}
        documents_of_block = self.width * sum(size[s].n for s in have) / max(1, sum(have.values()))
        shard_blocks = max(shard_blocks, math.ceil(shard_documents / documents_of_block)) if have else shard_blocks
        capacity = {s: blocks[s] * self.targets[s].max_repeats for s in have}
        whole = sum(shares.values())
        seats = int(min((capacity[s] * whole / w for s, w in shares.items()), default=0)) if total_tokens is None else round(total_tokens / self.width)
        #: blocks of each source to be drawn
        self.quota = sainte_lague(seats, shares, capacity)
        plan = [(s, self.targets[s].label, blocks[s], *shard_quotas(q, blocks[s], shard_blocks, self.targets[s].max_repeats)) for s, q in self.quota.items()]
        quotas = F.broadcast(spark.createDataFrame(plan, "source string, label string, blocks long, every long, more long, last long"))
        buckets = max(1, -(-sum(r.n for r in size.values()) // bucket_documents))
        draw = F.xxhash64("doc_id", F.lit(seed))
        placed = once.withColumn("draw", draw).withColumn("bucket", F.pmod("draw", F.lit(buckets)))
        sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
        ahead = sums.select("source", "bucket", (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("ahead"))
        inner = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
        block = F.floor((F.col("inner") + F.col("ahead")) / self.width)
        at = placed.withColumn("inner", inner).join(ahead, ["source", "bucket"]).withColumn("block", block).join(quotas, "source")
        shard, place = F.expr(f"block div {shard_blocks}"), F.col("block") % shard_blocks
        held = F.least(F.lit(shard_blocks), F.col("blocks") - shard * shard_blocks)
        due = F.when(held < shard_blocks, F.col("last")).otherwise(F.col("every") + (shard < F.col("more")).cast("long"))
        begin = F.pmod(F.xxhash64("source", shard, F.lit(seed + 1)), held)
        copies = F.floor(due / held) + (F.pmod(place - begin, held) < due % held).cast("long")
        #: (doc_id, source, tokens, copies): the documents drawn
        self.drawn = at.withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", F.col("label").alias("source"), "tokens", "copies")

    def shares(self) -> DataFrame:
        """(source, target_share, scaled_share, actual_share, tokens, documents, most_copies, max_repeats): one row for each target.

        scaled_share: the target among the sources that have documents; 0 for a source that has none."""
        spark = self.drawn.sparkSession
        whole = sum(self.targets[s].target_share for s in self.quota)
        listed = [(r.label, r.target_share, r.target_share / whole if s in self.quota else 0.0, r.max_repeats) for s, r in self.targets.items()]
        targets = spark.createDataFrame(listed, "source string, target_share double, scaled_share double, max_repeats int")
        got = self.drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
        all_tokens = F.sum("tokens").over(Window.partitionBy())
        full = targets.join(F.broadcast(got), "source", "left").fillna(0, ["tokens", "documents", "most_copies"])
        return full.select("source", "target_share", "scaled_share", F.when(all_tokens > 0, F.col("tokens") / all_tokens).otherwise(F.lit(0.0)).alias("actual_share"), "tokens", "documents", "most_copies", "max_repeats")
