"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.llm.store import bounded_batches, free, saved
from keystrand.llm.words import PLACES, SHINGLE, Words, chunks, mix64, shingle_sets, text_buffers, words_of

THRESHOLD = 0.75
RADIUS = 23
BLOCKS = 8
ITEMS_AT_ONCE = 20_000
#: Pairs of a window and an item, and words between the first and last window, that stand in memory at once.
PAIRS_AT_ONCE = 1 << 21
WORDS_AT_ONCE = 1 << 12
BITS = np.arange(64, dtype=np.uint64)
NEAR = [np.array([v for v in range(256) if bin(v).count("1") <= d], dtype=np.uint8) for d in range(9)]
POPCOUNT = np.array([bin(v).count("1") for v in range(256)], dtype=np.uint8)


def signed_bits(hashes: np.ndarray) -> np.ndarray:
    """1 and -1 for the bits of 64-bit hashes."""
    return ((hashes[:, None] >> BITS) & np.uint64(1)).astype(np.float64) * 2 - 1


def fold(sums: np.ndarray) -> np.ndarray:
    """The SimHash of summed bits as eight bytes."""
    return np.packbits(sums > 0, axis=1, bitorder="little")


@dataclass
class Group:
    """Items with windows of one size: for each byte of a fingerprint and each value the items that may be near."""

    size: int
    ids: np.ndarray
    prints: np.ndarray
    near: np.ndarray
    counts: list[dict[int, int]]
    totals: np.ndarray


class Index:
    """What tasks need of at most ``ITEMS_AT_ONCE`` items: fingerprints, blocks and shingles with weights.

    A shingle weighs log(1 + items / items that hold it), so what many items share counts less. Both counts are of the
    whole benchmark: ``total`` items, and ``shared``, the hashes in order of shingles that two or more of them hold, with
    their counts. A shingle of one item weighs as much as an unknown one, so no more is needed. Without them the
    given items are the whole benchmark. Two fingerprints within ``RADIUS`` differ by at most RADIUS // BLOCKS bits in
    one of ``BLOCKS`` bytes: every such byte value is listed, so no fingerprint within the radius is missed.
    """

    def __init__(self, ids: list[int], texts: list[str], total: int | None = None, shared: tuple[np.ndarray, np.ndarray] | None = None):
        column = pa.array(texts, pa.string())
        data, at = text_buffers(column)
        words = words_of(data, at)
        every, sizes = words.shingles(), np.diff(words.first)
        held = [set(s.tolist()) for s in shingle_sets(words)]
        spread: dict[int, int] = {}
        for s in held:
            for h in s:
                spread[h] = spread.get(h, 0) + 1
        if shared is None:
            often = sorted(h for h, n in spread.items() if n > 1)
            total, shared = len(ids), (np.array(often, dtype=np.uint64), np.array([spread[h] for h in often], dtype=np.int64))
        self.top = float(np.log(1 + total))
        self.keys = np.array(sorted(spread), dtype=np.uint64)
        self.shared, self.weights = shared[0], np.log(1 + total / shared[1])
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.short: dict[int, list[tuple[int, int]]] = {}
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, (low, n) in enumerate(zip(words.first[:-1], sizes, strict=True)):
            if n >= SHINGLE:
                by_size.setdefault(int(n) - SHINGLE + 1, []).append((ids[i], every[low : low + n - SHINGLE + 1]))
            elif n:
                self.short.setdefault(int(n), []).append((ids[i], int(next(iter(held[i])))))
        self.groups = [self._group(size, rows) for size, rows in sorted(by_size.items())]

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(hashes), self.top)
        at = np.minimum(np.searchsorted(self.shared, hashes), len(self.shared) - 1)
        return np.where(self.shared[at] == hashes, self.weights[at], self.top)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that some item holds."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.filter[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        return maybe[self.keys[at] == hashes[maybe]]

    def _group(self, size: int, rows: list[tuple[int, np.ndarray]]) -> Group:
        prints = np.concatenate([fold((signed_bits(h) * self.weigh(h)[:, None]).sum(axis=0, keepdims=True)) for _, h in rows])
        near = np.zeros((BLOCKS, 256, len(rows)), dtype=bool)
        for block in range(BLOCKS):
            for k, value in enumerate(prints[:, block]):
                near[block, value ^ NEAR[RADIUS // BLOCKS], k] = True
        counts = [dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True)) for _, h in rows]
        return Group(size, np.array([i for i, _ in rows]), prints, near, counts, np.array([self.weigh(h).sum() for _, h in rows]))

    def alike(self, window: np.ndarray, weights: np.ndarray, group: Group, k: int) -> float:
        """Weighted Jaccard of a window's and an item's shingles, repeats counted."""
        left, shared = dict(group.counts[k]), 0.0
        for h, w in zip(window.tolist(), weights.tolist(), strict=True):
            if left.get(h, 0):
                left[h] -= 1
                shared += w
        return min(1.0, float(shared / max(1e-12, weights.sum() + group.totals[k] - shared)))

    def find(self, shingles: np.ndarray, hits: np.ndarray) -> dict[int, tuple[float, int]]:
        """item -> (best similarity, the first word of the first window that has it) over the item-sized windows. A text
        shorter than an item is one window. ``hits`` are the places of shingles that some item holds: what a window and
        an item share can't weigh more than the window's hits, so a window whose hits weigh less than 0.75 of every
        item of its size is passed over, and no other."""
        found: dict[int, tuple[float, int]] = {}
        weights = self.weigh(shingles)
        held = np.zeros(len(shingles) + 1)
        held[hits + 1] = weights[hits]
        held = np.cumsum(held)
        for group in self.groups:
            size = min(group.size, len(shingles))
            starts = np.flatnonzero(held[size:] - held[: len(held) - size] >= THRESHOLD * group.totals.min() - 1e-6)
            most = max(1, min(WORDS_AT_ONCE, PAIRS_AT_ONCE // len(group.ids)))
            while len(starts):
                n = min(most, int(np.searchsorted(starts, starts[0] + WORDS_AT_ONCE)))
                self._windows(shingles, weights, group, size, starts[:n], found)
                starts = starts[n:]
        return found

    def _windows(self, shingles, weights, group, size, starts, found) -> None:
        low, high = starts[0], starts[-1] + size
        region, w = shingles[low:high], weights[low:high]
        sums = np.zeros((len(region) + 1, 64))
        np.cumsum(signed_bits(region) * w[:, None], axis=0, out=sums[1:])
        prints = fold(sums[starts - low + size] - sums[starts - low])
        near = np.zeros((len(starts), len(group.ids)), dtype=bool)
        for block in range(BLOCKS):
            near |= group.near[block, prints[:, block]]
        rows, items = np.nonzero(near)
        within = POPCOUNT[prints[rows] ^ group.prints[items]].sum(axis=1) <= RADIUS
        for r, k in zip(rows[within], items[within], strict=True):
            s = int(starts[r])
            share = self.alike(shingles[s : s + size], weights[s : s + size], group, int(k))
            item = int(group.ids[k])
            if share >= THRESHOLD and share > found.get(item, (0.0, 0))[0]:
                found[item] = (share, s)

    def find_short(self, words: Words, low: int, high: int, found: dict[int, tuple[float, int]]) -> None:
        """Items of fewer words than a shingle: found where the same words stand in a row."""
        for n, rows in self.short.items():
            total = np.zeros(max(0, high - low - n + 1), dtype=np.uint64)
            for k in range(n):
                total += words.hashes[low + k : low + k + len(total)] * PLACES[k]
            total = mix64(total + np.uint64(n))
            for item, h in rows:
                at = np.flatnonzero(total == np.uint64(h))
                if len(at):
                    found[item] = (1.0, int(at[0]))


def _search(docs: DataFrame, index: Index) -> DataFrame:
    """The columns of ``docs`` but for text, then item_id, similarity and first_word, a row for each find."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    keys = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            for low, high in chunks(at):
                words = words_of(data, at[low : high + 1])
                every = words.shingles()
                hits = index.known(every)
                rows = []
                ends = words.first[1:] - SHINGLE + 1
                edges = np.searchsorted(hits, np.stack([words.first[:-1], np.maximum(ends, words.first[:-1])]))
                for i in range(high - low):
                    found: dict[int, tuple[float, int]] = {}
                    a, z = words.first[i], words.first[i + 1]
                    own = hits[edges[0, i] : edges[1, i]]
                    if len(own):
                        found = index.find(every[a : z - SHINGLE + 1], own - a)
                    if index.short:
                        index.find_short(words, a, z, found)
                    rows += [(low + i, item, share, start) for item, (share, start) in sorted(found.items())]
                if rows:
                    at_row, item, share, start = (np.array([r[k] for r in rows], dtype=t) for k, t in enumerate((np.int64, np.int64, np.float64, np.int64)))
                    own = [batch.column(c).take(pa.array(at_row)) for c in keys]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(item), pa.array(share), pa.array(start)], [*keys, "item_id", "similarity", "first_word"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, schema + ", item_id long, similarity double, first_word long")


def shared_shingles(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order of the shingles that two or more items hold, and how many do, counted over all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_buffers(batch.column("text"))
            for low, high in chunks(at):
                sets = [*shingle_sets(words_of(data, at[low : high + 1])), np.zeros(0, np.uint64)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["shingle"])

    counts = items.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").toArrow()
    hashes, n = counts.column("shingle").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _finds(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    total = items.count()
    blocks = max(1, -(-total // ITEMS_AT_ONCE))
    shared, out = shared_shingles(items), None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        found = _search(docs, Index([r.item_id for r in rows], [r.text for r in rows], total, shared))
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word): documents with a window of an item's size whose weighted shingle
    similarity to the item is 0.75 or more, and the best such window, the first of equals.

    Words are lower-cased (A-Z) and compared over whole texts. Items of fewer than five words are found word for word;
    items without words and null texts match nothing. Items go to tasks in blocks of about ``ITEMS_AT_ONCE``, one
    pass over the documents for each; shingles are weighed by counts over all items, so results don't depend on the
    blocks. Beside a block only the shingles that items share are broadcast with their counts. Repeated rows are
    reported as often as they stand; repeated item ids are one item each time. A long text is read whole, and what a
    task holds for its windows is bounded. An empty table on either side gives an empty result; other columns are not
    read.
    """
    return _finds(docs.select("doc_id", "text"), benchmark)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows; columns as they came. Rows are told by 128 bits of their text, so those
    without doc_id, or of one doc_id with different texts, are judged each by itself."""
    one, two = F.xxhash64("text"), F.xxhash64(F.lit("leak"), "text")
    first, second = free(docs, "leak_one"), free(docs, "leak_two")
    gone = saved(_finds(docs.select("text", one.alias(first), two.alias(second)), benchmark).select(first, second).distinct(), "leaks")
    gone = gone.select(F.col(first).alias("_" + first), F.col(second).alias("_" + second))
    return docs.join(gone, (one == F.col("_" + first)) & (two == F.col("_" + second)), "left_anti").select(*docs.columns)
