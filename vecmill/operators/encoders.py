"""Encoders: anything with `name`, `dim` and encode(texts) -> rows, or for tokens encode_tokens(texts) -> matrices."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

WORD = re.compile(r"[^\W_]+")


class Encoder(Protocol):
    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class TokenEncoder(Protocol):
    name: str
    dim: int
    supports_images: bool

    def encode_tokens(self, texts: list[str]) -> list[np.ndarray]: ...


class HashingEncoder:
    """A deterministic encoder for tests and offline use: a word's vector is read from its MD5, a text's is the mean of its words'.

    Texts without words have the zero vector, and no tokens."""

    supports_images = False

    def __init__(self, dim: int, name: str = "hashing") -> None:
        if not 1 <= dim <= 16:
            raise ValueError("dim must be within 1 and 16")
        self.dim, self.name, self._known = dim, name, {}

    def __str__(self) -> str:
        return f"{self.name} ({self.dim})"

    def word(self, w: str) -> np.ndarray:
        if w not in self._known:
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[w] = ((np.frombuffer(hashlib.md5(w.encode()).digest()[: self.dim], np.uint8) - 127.5) / 127.5).astype(np.float32)
        return self._known[w]

    def encode_tokens(self, texts: list[str]) -> list[np.ndarray]:
        found = [WORD.findall(text.lower()) for text in texts]
        place: dict[str, int] = {}
        at = np.array([place.setdefault(w, len(place)) for each in found for w in each], np.int64)
        known = np.array([self.word(w) for w in place], np.float32).reshape(-1, self.dim)  # each distinct word once
        return np.split(known[at], np.cumsum([len(each) for each in found])[:-1]) if texts else []

    def encode(self, texts: list[str]) -> np.ndarray:
        means = [t.mean(axis=0, dtype=np.float64) if len(t) else np.zeros(self.dim) for t in self.encode_tokens(texts)]
        return np.array(means, np.float32).reshape(-1, self.dim)


def checked_tokens(found: list, dim: int) -> list[np.ndarray]:
    """Token matrices, if they are arrays (else TypeError) of two axes and the right width (else ValueError)."""
    for t in found:
        if not isinstance(t, np.ndarray):
            raise TypeError("token vectors must be an array")
        if t.ndim != 2 or t.shape[1] != dim:
            raise ValueError(f"token vectors must be rows of {dim} numbers")
    return found


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as one list of floats a row."""
    rows = np.ascontiguousarray(rows, np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])), pa.array(rows.ravel()))


def encode_column(df: DataFrame, text_column: str, encoders: dict[str, Encoder]) -> DataFrame:
    """df with a vector column for each encoder, in one pass; null texts have null vectors. Columns of these names are replaced."""
    base = df.drop(*encoders)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields), *(f"`{c}` array<float>" for c in encoders)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_column).to_pylist()
            null = pa.array([t is None for t in texts])
            columns = [pa.compute.if_else(null, None, lists(e.encode([t or "" for t in texts]))) for e in encoders.values()]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, *encoders])

    return base.mapInArrow(run, schema)


def encode_tokens(df: DataFrame, id_columns: list[str], text_column: str, encoder: TokenEncoder, pool: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(*id_columns, position, token_embedding): one row for each token vector of each text, pooled if asked; null texts have none.

    Token vectors whose norm is zero are left out after encoding. An encoder that gives anything but matrices of its dimension: TypeError
    or ValueError."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                found = checked_tokens(encoder.encode_tokens([t or "" for t in piece.column(len(id_columns)).to_pylist()]), encoder.dim)
                found = [t[np.abs(t).max(axis=1) > 0] if len(t) else t for t in found]
                if pool:
                    found = [pool(t) if len(t) else t for t in found]
                take = pa.array(np.repeat(np.arange(len(found)), [len(t) for t in found]))
                position = pa.array(np.concatenate([np.arange(len(t)) for t in found]).astype(np.int32))
                yield pa.record_batch([*(piece.column(i).take(take) for i in range(len(id_columns))), position, lists(np.concatenate(found))], names=[*id_columns, "position", "token_embedding"])

    return df.select(*id_columns, F.col(text_column).cast("string").alias("__text")).mapInArrow(run, f"{kinds}, position int, token_embedding array<float>")


def parallel_map(df: DataFrame, order: list[str], column: str, function: Callable[[list], list], result: str) -> DataFrame:
    """df's `order` and `column` columns with `result`: function applied to batches of values, in order of `order`.

    The function gets and gives a list; how many run at once is the number of partitions."""
    kind, target = df.schema[column].dataType.simpleString(), result.split(" ")[0]
    made = to_arrow_type(T.StructType.fromDDL(result).fields[0].dataType)
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = function(batch.column(column).to_pylist())
            if len(values) != batch.num_rows:
                raise ValueError("the function must give one result for each value")
            yield pa.record_batch([*batch.columns, pa.array(values, made)], names=[*batch.schema.names, target])

    return df.select(*order, column).mapInArrow(run, f"{keys}, `{column}` {kind}, {result}").orderBy(*order)
