"""Order MinHash sketches over word k-mers, and the verification of candidate pairs by banded alignment."""

from __future__ import annotations

import numpy as np

from .common import mix

LONGEST = np.uint64(22)  # bits for a position: texts of up to four million words are told apart by it


def kmers(hashes: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words that lie within one text, and where each text's k-mers start.

    hashes: the word hashes of many texts end to end; starts: where each text begins, then the total.
    Every text must have at least k words.
    """
    n = len(hashes) - k + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        h = mix(h + hashes[j : j + n] * np.uint64(0x9E3779B97F4A7C15))
    counts = np.diff(starts) - (k - 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(first[-1]) + np.repeat(starts[:-1] - first[:-1], counts)
    return h[at], first


def label(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes that also hold which occurrence in its text a k-mer is: repeated k-mers count each time."""
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    mark = np.sort(mix(h + text * np.uint64(0xC2B2AE3D27D4EB4F)))
    if not (mark[1:] == mark[:-1]).any():
        return h
    again = mark[1:][mark[1:] == mark[:-1]]
    at = np.flatnonzero(np.isin(mix(h + text * np.uint64(0xC2B2AE3D27D4EB4F)), again))  # the repeated ones only
    order = at[np.lexsort((h[at], text[at]))]
    same = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(order)), 0))
    nth = (np.arange(len(order)) - begin).astype(np.uint64)
    out = h.copy()
    out[order] = np.where(nth > 0, mix(h[order] + nth * np.uint64(0xD6E8FEB86659FD93)), h[order])
    return out


def distinct_kmers(hashes: np.ndarray, starts: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct k-mers of each text, in order of their hashes."""
    h, first = kmers(hashes, starts, k)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])[: len(h)]
    return np.split(h[new], np.searchsorted(text[new], np.arange(1, len(first) - 1)))


def sketch(h: np.ndarray, first: np.ndarray, bands: int, take: int, seed: int = 1) -> np.ndarray:
    """For each text and band, a hash of the band's `take` least labelled k-mers in the order in which the text has them.

    Every text must have at least `take` k-mers. Two texts agree in a band with probability about J^take, J being the share of
    labelled k-mers they have in common, if these keep their order.
    """
    count, start = np.diff(first), first[:-1]
    position = np.arange(len(h), dtype=np.uint64) - np.repeat(start.astype(np.uint64), count)
    low = (np.uint64(1) << LONGEST) - np.uint64(1)
    out = np.empty((len(start), bands), np.int64)
    keys = mix(np.arange(seed, seed + bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    for b in range(bands):
        g = (mix(h ^ keys[b]) & ~low) | position
        least = np.empty((take, len(start)), np.int64)
        for t in range(take):
            least[t] = (np.minimum.reduceat(g, start) & low).astype(np.int64)
            g[start + least[t]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least.sort(axis=0)
        band = np.full(len(start), keys[b])
        for at in least:
            band = mix(band + h[start + at] * np.uint64(0x9E3779B97F4A7C15))
        out[:, b] = band.view(np.int64)
    return out
