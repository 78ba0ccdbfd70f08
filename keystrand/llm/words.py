"""Words and shingles of UTF-8 text as numpy arrays, for code inside Arrow tasks.

A word is a run of bytes other than space and 0x09 to 0x0D; A-Z count as a-z. Words and shingles are 64-bit hashes:
a word's is a polynomial over a table of byte values, a shingle's a weighted sum of its words', both mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SHINGLE = 5
CHUNK = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with no visible structure left."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[LOWER]
BASE = 0xD6E8FEB86659FD93
PLACES = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, dtype=np.uint64))])
    down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse, dtype=np.uint64))])
    return up, down


@dataclass
class Words:
    """Words of some texts: first[i]:first[i + 1] are the i-th text's."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def shingles(self, size: int = SHINGLE) -> np.ndarray:
        """Hash of the ``size`` words from each word on; those that reach beyond a text's end mean nothing."""
        n = max(0, len(self.hashes) - size + 1)
        total = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            total += self.hashes[k : k + n] * PLACES[k]
        return mix64(total + np.uint64(size))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each, or of one row that is longer."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def words_of(data: np.ndarray, at: np.ndarray) -> Words:
    """Words of the texts data[at[i]:at[i + 1]]."""
    begin, end = int(at[0]), int(at[-1])
    part, edges = data[begin:end], at - begin
    n = len(part)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(WHITE[part], out=inside[1:-1])
    body = inside[1:-1]
    cuts = edges[:-1][edges[:-1] < n]
    opened = body & ~inside[:-2]
    opened[cuts] = body[cuts]
    closed = body & ~inside[2:]
    closed[cuts[cuts > 0] - 1] = body[cuts[cuts > 0] - 1]
    starts, ends = np.flatnonzero(opened), np.flatnonzero(closed) + 1
    up, down = _powers(max(CHUNK + (1 << 18), 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTES[part] * up[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, np.searchsorted(starts, edges), starts + begin, ends + begin)


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than a shingle count as one, none as none."""
    every = words.shingles()
    for low, high in zip(words.first[:-1], words.first[1:], strict=True):
        n = high - low
        if n >= SHINGLE:
            yield np.unique(every[low : high - SHINGLE + 1])
        elif n:
            yield mix64((words.hashes[low:high] * PLACES[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)
