"""Hashes of words and word shingles for whole Arrow columns of texts, with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 1 << 16

LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), BASE | np.uint64(1), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row edges) of consecutive rows; a text longer than a chunk is one alone."""
    texts = texts.fill_null("")
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(edges, edges[row] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, row + 1), row + CHUNK_ROWS, len(texts))
        yield row, data[edges[row] : edges[last]], edges[row : last + 1] - edges[row]
        row = last


@dataclass
class Words:
    """Words of a chunk in order: byte ranges, 64-bit hashes, and the index of the first word of each row."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, edges: np.ndarray, lower: bool = True) -> Words:
    """Words are runs of bytes other than white space; they end with their row."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~IS_SPACE[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    cut = edges[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    before[cut] = False
    after[cut - 1] = False
    inside = inside[1:-1]
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    lengths = ends - starts
    letters = data[inside]
    if lower:
        letters = LOWER_BYTES[letters]
    if len(starts):
        at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(len(letters)) - np.repeat(at, lengths)
        weighted = (letters.astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
        hashes = mix(np.add.reduceat(weighted, at) + lengths.astype(np.uint64) * BASE)
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(starts, ends, hashes, np.searchsorted(starts, edges))


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words; shorter by k - 1 than the input."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i, p in enumerate(powers(k + 1)[1:]):
        total += hashes[i : i + n] * p
    return mix(total + np.uint64(k))


def shingles(found: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer than k words is one shingle."""
    runs = runs_of(found.hashes, k)
    for a, b in zip(found.first[:-1], found.first[1:]):
        n = b - a
        if n >= k:
            yield np.unique(runs[a : b - k + 1])
        else:
            yield runs_of(found.hashes[a:b], n) if n else np.zeros(0, np.uint64)
