"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from ..session import materialize, new_path, shared_dir

__all__ = ["materialize", "new_path", "shared_dir"]

#: A word is a maximal run of letters or digits (Unicode L and N).
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The lower-cased words of a text."""
    found = WORD.findall(text)
    return "\n".join(found).lower().split("\n") if found else []


def alnum(text: str) -> str:
    """Letters and digits only, case ignored."""
    return "".join(WORD.findall(text)).lower()


def digest(data: bytes | str) -> bytes:
    """128 bits that stand for the value; equal values and no others (but for chance 2^-128 a pair) are equal."""
    return xxhash.xxh3_128_digest(data)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit affects every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 200_000) -> None:
        self.most, self.known = most, {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            for w in set(tokens).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def binary(rows: np.ndarray) -> pa.Array:
    """A contiguous matrix as one binary value a row."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(rows)])


def matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """The reverse of binary()."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, width), dtype)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(-1, width)


def list_lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
