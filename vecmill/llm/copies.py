"""Problem 3: copies hidden by formatting. Records are collapsed by a canonical key that formatting does not change."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum, digest, materialize

FIELD = re.compile(r"([^:;|{}\n\r]{1,80}):(.*)", re.S)
LEAST_FIELDS = 3


def fields(text: str) -> list[tuple[str, str]] | None:
    """The named fields of a text that consists of three or more of them, else None.

    Notations: a flat JSON object; `name: value` on lines; or separated by `;` or by `|`. A value may hold the separators of the
    other notations: lines are tried first, then `|`, then `;`, and the first in which every part is a field is taken.
    """
    bare = text.strip()
    if bare.startswith("{") and bare.endswith("}"):
        try:
            pairs = json.loads(bare, object_pairs_hook=lambda x: x, parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            return None
        if not isinstance(pairs, list) or len(pairs) < LEAST_FIELDS or any(isinstance(v, list) for _, v in pairs):
            return None
        return [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in pairs]
    if bare.count(":") < LEAST_FIELDS:
        return None
    for separator in ("\n", "|", ";"):
        parts = [p for p in (bare.splitlines() if separator == "\n" else bare.split(separator)) if p.strip()]
        if len(parts) < LEAST_FIELDS:
            continue
        found = [FIELD.fullmatch(p.strip().rstrip(";|").rstrip() if separator == "\n" else p.strip()) for p in parts]
        if all(m and alnum(m[1]) for m in found):
            return [(m[1], m[2]) for m in found]
    return None


def canonical(text: str, bare: str | None = None) -> str:
    """Equal for two texts exactly if they say the same: the same letters and digits in order, or the same set of named fields.

    bare: alnum(text), if it is known."""
    named = fields(text)
    if named is None:
        return "T" + (alnum(text) if bare is None else bare)
    return "F" + "\x1e".join(sorted({alnum(k) + "\x1f" + alnum(v) for k, v in named}))


def copy_key(identifier: str, content: str, bare: str | None = None) -> bytes:
    return digest(alnum(identifier) + "\x1d" + canonical(content, bare))


def keyed(df: DataFrame, row_column: str, id_column: str, content_column: str) -> DataFrame:
    """(row_id, key) of the rows in which none of the three columns is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [copy_key(i, c) for i, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), pa.array(keys, pa.binary())], names=["row_id", "key"])

    picked = df.select(F.col(row_column).cast("long").alias("row_id"), F.col(id_column).cast("string").alias("i"), F.col(content_column).cast("string").alias("c"))
    return picked.dropna().mapInArrow(run, "row_id long, key binary")


class Copies:
    """Rows that agree apart from whitespace, letter case, punctuation and the order of named fields.

    Keys are counted exactly, with partial counts before the shuffle; those of more than `hot` rows are hot. There are at most
    rows/`hot` of them, and they are broadcast if they are no more than `most_broadcast`, else joined by shuffle. Rows under hot
    keys are salted and aggregated on two levels, all others in one shuffle. The representative is the least row id.

    Rows with null row id, identifier or content are in no group. Identifiers or contents without letters and digits are equal
    to each other. Rows delivered twice under one row id count as two copies. An empty table has no groups.
    """

    def __init__(self, df: DataFrame, row_column: str = "row_id", id_column: str = "chunk_id", content_column: str = "content", hot: int = 10_000, salts: int = 64, most_broadcast: int = 200_000) -> None:
        self.salts = salts
        self.rows = materialize(keyed(df, row_column, id_column, content_column), "p3-keys")
        counts = self.rows.groupBy("key").agg(F.count("*").alias("n"), F.min("row_id").alias("representative"))
        self.hot = materialize(counts.where(F.col("n") > hot), "p3-hot")
        hot_keys = self.hot.count()
        self.any_hot = hot_keys > 0
        self._hint = (lambda x: F.broadcast(x)) if hot_keys <= most_broadcast else (lambda x: x)

    def _cold(self) -> DataFrame:
        return self.rows.join(self._hint(self.hot.select("key")), "key", "left_anti") if self.any_hot else self.rows

    def _salted(self) -> DataFrame:
        return self.rows.join(self._hint(self.hot.select("key")), "key", "left_semi").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(self.salts)))

    def collapsed(self) -> DataFrame:
        """(row_id, copies): one row for each distinct record, its representative and how many rows say the same."""
        cold = self._cold().groupBy("key").agg(F.min("row_id").alias("row_id"), F.count("*").alias("copies"))
        if self.any_hot:
            part = self._salted().groupBy("key", "salt").agg(F.min("row_id").alias("row_id"), F.count("*").alias("copies"))
            cold = cold.unionByName(part.groupBy("key").agg(F.min("row_id").alias("row_id"), F.sum("copies").alias("copies")))
        return cold.select("row_id", "copies")

    def members(self) -> DataFrame:
        """(row_id, representative) of every row that has a key."""
        cold = self._cold().groupBy("key").agg(F.min("row_id").alias("representative"), F.collect_list("row_id").alias("ids"))
        out = cold.select(F.explode("ids").alias("row_id"), "representative")
        if self.any_hot:
            out = out.unionByName(self.rows.join(self._hint(self.hot.select("key", "representative")), "key").select("row_id", "representative"))
        return out

    def pairs(self) -> DataFrame:
        """(row_id_a, row_id_b): each pair of rows in a group, as the result asks for. A group of n has n(n-1)/2."""
        cold = self._cold().groupBy("key").agg(F.array_sort(F.collect_set("row_id")).alias("ids")).where(F.size("ids") > 1)
        out = cold.select("ids", F.posexplode("ids").alias("at", "row_id_a")).select("row_id_a", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("row_id_b"))
        if self.any_hot:
            left = self._salted().select("key", "salt", F.col("row_id").alias("row_id_a")).distinct()
            right = self._salted().select("key", F.col("row_id").alias("row_id_b")).distinct().withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.salts - 1).cast("long"))))
            out = out.unionByName(left.join(right, ["key", "salt"]).where("row_id_a < row_id_b").select("row_id_a", "row_id_b"))
        return out
