"""Line deduplication by an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from keystrand.llm.store import bounded_batches, dropped, saved
from keystrand.llm.words import chunks, mix64, text_buffers, words_of

SKETCH = 1 << 20
SLICE = 1 << 14
MARKS = 1 << 25
SEEN = 1 << 20
#: Prefix tokens that a task packs at once, and that a bucket of them is to hold.
PACKED = 1 << 19
BUCKET = 1 << 17
#: Candidates that a task looks at together.
TILE = 1 << 22
#: Signatures of a set, each of two least hashes: what the first search goes by.
SIGNATURES = 3
#: Sets of a signature, the earliest ones, of which the likest is held against each later set.
CENTRES = 2
#: Earlier sets, the likest ones, that an open set is held against before all others.
BEST = 4
#: Stretches of ids by which the join tells earlier sets from later ones.
ERAS = 1 << 7
TURNS = mix64(np.arange(1, 2 * SIGNATURES + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
#: What is sent of a prefix token: half of its hash, its place from the rarest on, the set's size, first hash and parities, and in one byte whether the set is
#: settled and, from the second bit on, its era.
FIELDS = (("token", np.uint32), ("at", np.uint32), ("n", np.uint32), ("h1", np.uint64), ("even", np.uint64), ("odd", np.uint64), ("settled", np.uint8))
#: What a document is known by, and the order of lines.
KEY = ("doc_id", "text_id")
PLACE = (*KEY, "line")


@dataclass
class Lines:
    """Lines with tokens of some texts: first[i]:first[i + 1] are the i-th line's sorted distinct token hashes."""

    row: np.ndarray
    number: np.ndarray
    first: np.ndarray
    tokens: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two sums that stand for each set."""
        return _summed(self.tokens, self.first), _summed(mix64(self.tokens + np.uint64(7)), self.first)

    def parities(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits a set: whether an odd number of its tokens falls to the bit."""
        bits = np.uint64(1) << (self.tokens >> np.uint64(58))
        odd = (self.tokens & np.uint64(1)).astype(bool)
        return tuple(np.bitwise_xor.reduceat(np.where(x, bits, np.uint64(0)), self.first[:-1]) if len(bits) else bits for x in (~odd, odd))

    def signatures(self) -> np.ndarray:
        """``SIGNATURES`` hashes a set, in rows; two sets share one as often as the square of their similarity."""
        if not len(self.tokens):
            return np.zeros((0, SIGNATURES), np.uint64)
        least = [np.minimum.reduceat(self.tokens * t, self.first[:-1]) for t in TURNS]
        return np.stack([mix64(a + mix64(b + np.uint64(i))) for i, (a, b) in enumerate(zip(least[::2], least[1::2], strict=True))], axis=1)

    def by_rarity(self, counts: np.ndarray) -> np.ndarray:
        """The order of lines, then of the counts of tokens."""
        of = np.repeat(np.arange(len(self.sizes), dtype=np.uint64), self.sizes)
        rare = counts[(self.tokens >> np.uint64(44)).astype(np.int64)]
        if len(of) >= 1 << 28:
            return np.lexsort((rare, of))
        key = (of << np.uint64(36)) | (rare.astype(np.uint64) << np.uint64(28)) | np.arange(len(of), dtype=np.uint64)
        key.sort()
        return (key & np.uint64((1 << 28) - 1)).astype(np.int64)


def _summed(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1]) if len(values) else np.zeros(0, np.uint64)


def _by_line(place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The order of lines, then hashes. One number of 64 bits tells it, unless lines are many or hashes too close."""
    if place[-1] < 1 << 20:
        key = (place.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20))
        order = np.argsort(key)
        key, sorted_hashes = key[order], hashes[order]
        if not ((key[1:] == key[:-1]) & (sorted_hashes[1:] != sorted_hashes[:-1])).any():
            return order
    return np.lexsort((hashes, place))


def _lines(data: np.ndarray, at: np.ndarray) -> Lines:
    words = words_of(data, at)
    if not len(words.starts):
        none = np.zeros(0, np.int64)
        return Lines(none, none, np.zeros(1, np.int64), np.zeros(0, np.uint64))
    breaks = np.flatnonzero(data[at[0] : at[-1]] == 0x0A) + at[0]
    line = np.searchsorted(breaks, words.starts)
    row = np.repeat(np.arange(len(at) - 1), np.diff(words.first))
    opened = np.concatenate([[True], (line[1:] != line[:-1]) | (row[1:] != row[:-1])])
    place = np.cumsum(opened) - 1
    order = _by_line(place, words.hashes)
    tokens = words.hashes[order]
    fresh = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (place[1:] != place[:-1])])
    heads = row[opened]
    number = line[opened] - np.searchsorted(breaks, at[:-1])[heads]
    first = np.concatenate([np.searchsorted(place[fresh], np.arange(len(heads))), [int(fresh.sum())]])
    return Lines(heads, number, first, tokens[fresh])


def _unseen(seen: dict[tuple[int, int], int], one: np.ndarray, two: np.ndarray, era: np.ndarray) -> np.ndarray:
    """Which sets the task hasn't met yet in so early an era. What it remembers is bounded: past ``SEEN`` sets it starts
    anew, and later steps fold what then comes twice."""
    out = np.zeros(len(one), dtype=bool)
    for i, (*key, at) in enumerate(zip(one.tolist(), two.tolist(), era.tolist(), strict=True)):
        key = tuple(key)
        if seen.get(key, ERAS) > at:
            if len(seen) >= SEEN:
                seen.clear()
            seen[key] = at
            out[i] = True
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, at = text_buffers(batch.column("text"))
        for low, high in chunks(at):
            yield {c: batch.column(c).slice(low, high - low) for c in KEY if c in batch.schema.names}, data, at[low : high + 1]


def _eras(ids: pa.Array, span: tuple[int, int]) -> np.ndarray:
    """The stretch of ``span`` each id falls in, which never falls as places rise: ids that are null come first."""
    least, most = span
    past = ids.cast(pa.int64()).fill_null(least).to_numpy(zero_copy_only=False).view(np.uint64) - np.array(least).astype(np.int64).view(np.uint64)
    return np.minimum(past >> np.uint64(max(0, (most - least + 1).bit_length() - ERAS.bit_length() + 1)), np.uint64(ERAS - 1)).astype(np.uint8)


def _keyed(docs: DataFrame) -> DataFrame:
    """A document is known by its id and its text, so that those without id stand each for itself."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")


def _scan(docs: DataFrame) -> DataFrame:
    """A row for each line with tokens: the set's size, 128-bit hash, half of its parities and its signatures. Rows
    without ``line`` hold, in slices, how many lines of a task have a token of each of ``SKETCH`` hash buckets."""
    names = [*PLACE, "n", "h1", "h2", "bits", "signatures", "counts"]

    def run(batches):
        counts, held = np.zeros(SKETCH, np.int64), []
        for ids, data, at in _batches(batches):
            lines = _lines(data, at)
            held.append((lines.tokens >> np.uint64(44)).astype(np.int64))
            if sum(map(len, held)) >= SKETCH:
                counts += np.bincount(np.concatenate(held), minlength=SKETCH)
                held = []
            hashes = [pa.array(x.view(np.int64)) for x in (*lines.hashes(), lines.parities()[0])]
            ends = np.arange(len(lines.row) + 1, dtype=np.int32) * np.int32(SIGNATURES)
            signatures = pa.ListArray.from_arrays(pa.array(ends), pa.array(lines.signatures().reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(lines.row)) for x in ids.values()), pa.array(lines.number.astype(np.int32)), pa.array(lines.sizes.astype(np.int32)), *hashes, signatures, pa.nulls(len(lines.row), pa.binary())], names)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=SKETCH)
        if counts.any():
            parts = counts.astype(np.uint32).reshape(-1, SLICE)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = [pa.nulls(len(parts), k) for k in kinds]
            columns[3], columns[8] = pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return _keyed(docs).mapInArrow(run, "doc_id long, text_id long, line int, n int, h1 long, h2 long, bits long, signatures array<long>, counts binary")


def token_sketch(scanned: DataFrame) -> np.ndarray:
    """Over all lines, how many hold a token of each of ``SKETCH`` hash buckets, as eight steps for each doubling: a byte
    a bucket, whatever the input.

    Spark sums the tasks' slices; the driver takes one array. It only orders tokens by rarity, so a shared bucket or
    step costs time and changes no result.
    """

    def add(key, table):
        total = sum(np.frombuffer(x.as_py(), np.uint32).astype(np.int64) for x in table.column("counts"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "steps": pa.array([np.round(8 * np.log2(total + 1)).astype(np.uint8).tobytes()], pa.binary())})

    parts = scanned.filter("line is null").select(F.col("n").alias("part"), "counts")
    out = np.zeros((SKETCH // SLICE, SLICE), np.uint8)
    for r in parts.groupBy("part").applyInArrow(add, "part int, steps binary").collect():
        out[r.part] = np.frombuffer(r.steps, np.uint8)
    return out.reshape(-1)


def _packed(columns: dict[str, np.ndarray], bucket: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: its prefix tokens' fields one after the other, by size and place, so that they compress."""
    most = np.uint64((1 << 16) - 1)
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(32)) | (np.minimum(columns["n"], most) << np.uint64(16)) | np.minimum(columns["at"], most))
    bucket = bucket[order]
    columns = {name: columns[name][order] for name, _ in FIELDS}
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    data = [b"".join(x[low:high].tobytes() for x in columns.values()) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int32)), pa.array(data, pa.binary())], ["bucket", "data"])


def _unpacked(blobs: pa.ChunkedArray) -> dict[str, np.ndarray]:
    width, parts = sum(np.dtype(k).itemsize for _, k in FIELDS), {name: [] for name, _ in FIELDS}
    for blob in blobs:
        data, at = blob.as_buffer(), 0
        n = data.size // width
        for name, kind in FIELDS:
            parts[name].append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return {name: np.concatenate(x) for name, x in parts.items()}


def _prefixes(docs: DataFrame, counts: np.ndarray, settled: tuple[np.ndarray, np.ndarray], buckets: int, span: tuple[int, int] = (0, 0)) -> DataFrame:
    """(bucket, data): the tokens of the prefix of each set, the rarest n - ceil(3n / 4) + 1, in which it must meet any
    similar set, packed by buckets of their hashes. A task tells of equal sets once, and again if one is of an earlier era; ``span``
    holds the least and the greatest id."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, tuple(np.packbits(x) for x in settled)))

    def run(batches):
        (counts, packed), seen = shared.value, {}
        marks = [np.unpackbits(x).view(bool) for x in packed]
        held, total = [], 0

        def flushed():
            return _packed({k: np.concatenate([x[k] for x, _ in held]) for k, _ in FIELDS}, np.concatenate([b for _, b in held]))

        for ids, data, at in _batches(batches):
            lines = _lines(data, at)
            era = _eras(ids["doc_id"], span)[lines.row]
            one, two = lines.hashes()
            n = lines.sizes
            of = np.repeat(np.arange(len(n)), n)
            rank = np.arange(len(of)) - lines.first[of]
            kept = (rank < (n - (3 * n + 3) // 4 + 1)[of]) & _unseen(seen, one, two, era)[of]
            tokens = lines.tokens[lines.by_rarity(counts)[kept]]
            of, rank = of[kept], rank[kept]
            even, odd = lines.parities()
            done = (_marked(marks[0], one) & ~_marked(marks[1], two)) | (era << 1)
            values = (tokens >> np.uint64(32), rank, n[of], one[of], even[of], odd[of], done[of])
            held.append(({k: v.astype(kind) for (k, kind), v in zip(FIELDS, values, strict=True)}, (tokens % np.uint64(buckets)).astype(np.int32)))
            total += len(tokens)
            if total >= PACKED:
                yield flushed()
                held, total = [], 0
        if held:
            yield flushed()

    return docs.select("doc_id", "text").mapInArrow(run, "bucket int, data binary")


def _line_mark(text_id, line):
    return text_id ^ (line * 1_000_003)


def _fetch(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """The full token sets of lines that are marked by text and number. Other lines are not parted into tokens, and a
    task tells of equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def run(batches):
        marks, seen = np.unpackbits(shared.value).view(bool), {}
        for ids, data, at in _batches(batches):
            breaks = np.flatnonzero(data[at[0] : at[-1]] == 0x0A) + at[0]
            held = np.diff(np.searchsorted(breaks, at)) + 1
            row = np.repeat(np.arange(len(held)), held)
            every = np.arange(len(row))
            starts, ends = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
            heads = np.cumsum(held) - held
            number = every - heads[row]
            starts[heads], ends[heads + held - 1] = at[:-1], at[1:]
            starts[number > 0], ends[number < held[row] - 1] = breaks + 1, breaks
            text_id = ids["text_id"].to_numpy(zero_copy_only=False)
            kept = _marked(marks, _line_mark(text_id[row], number).view(np.uint64)) & (ends > starts)
            size = (ends - starts)[kept]
            if not len(size):
                continue
            to = np.concatenate([[0], np.cumsum(size)])
            lines = _lines(data[np.repeat(starts[kept] - to[:-1], size) + np.arange(to[-1])], to)
            one, two = lines.hashes()
            kept = _unseen(seen, one, two, np.zeros(len(one), np.uint8))
            n = lines.sizes
            flat = lines.tokens[np.repeat(kept, n)].view(np.int64)
            hashes = [pa.array(x[kept].view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([*hashes, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[kept])]).astype(np.int32)), pa.array(flat))], ["h1", "h2", "tokens"])

    return _keyed(docs).mapInArrow(run, "h1 long, h2 long, tokens array<long>")


def _marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return marks[(hashes % np.uint64(len(marks))).astype(np.int64)]


def _marks(hashes: DataFrame) -> np.ndarray:
    """A bit for each of ``MARKS`` buckets that a hash (the only column) falls in. The driver takes one row for each 32
    buckets, whatever the input."""
    bucket = F.col(hashes.columns[0]).bitwiseAND(F.lit(MARKS - 1)).cast("int")
    words = hashes.select(bucket.alias("at")).groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at & 31)")).alias("bits"))
    out = np.zeros(MARKS // 32, np.uint32)
    rows = words.toArrow()
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return ((out[:, None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)).astype(bool).reshape(-1)


def _with_first(folded: DataFrame) -> DataFrame:
    """(g1, h1): for each signature of a set, the likest by parities of the ``CENTRES`` sets that come first with it, if
    the two seem similar: sizes differ by a quarter at most, and each bit in which the parities differ, of half of the
    tokens, stands for one and a half that one set has alone. So a set gives ``SIGNATURES`` pairs at most, however many sets are like it.
    Sets of one or two tokens are similar to none but themselves."""
    dealt = folded.filter("n > 2").select(F.explode("signatures").alias("signature"), "h1", "n", "bits", "place").repartition("signature")
    till = W.partitionBy("signature").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    own, names = F.struct("h1", "n", "bits"), [f"c{i}" for i in range(CENTRES)]
    rows = dealt.withColumn("c0", F.first(own).over(till)).filter(F.col("h1") != F.col("c0.h1"))
    rows = rows.select("*", *(F.nth_value(own, i).over(till).alias(c) for i, c in enumerate(names[1:], 1)))

    def centre(c):
        n, m = F.col("n"), F.col(f"{c}.n")
        alone = F.bit_count(F.col("bits").bitwiseXOR(F.col(f"{c}.bits")))
        fit = (F.col("h1") != F.col(f"{c}.h1")) & (4 * F.least(n, m) >= 3 * F.greatest(n, m)) & (2 * (n + m) - 3 * alone >= 4 * F.ceil(3 * (n + m) / F.lit(7)))
        return F.when(fit, F.struct((alone / (n + m)).alias("unlike"), F.col(f"{c}.h1").alias("h1")))

    likest = rows.select("h1", F.least(*map(centre, names)).alias("c")).filter(F.col("c").isNotNull())
    return likest.select(F.least("c.h1", "h1").alias("g1"), F.greatest("c.h1", "h1").alias("h1")).distinct()


def _pairs_of(x: dict[str, np.ndarray], y: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(h1 of an open set, h1 of another that may come earlier, how alike they seem), for tokens of x among the rarest n - ceil(6n / 7) + 1 of their sets and equal ones
    of y in sets of as many tokens up to a third more, if the sets may be similar: the tokens that can still follow in
    both suffice, and each bit in which the parities differ is a token that one set has alone. y is by token and size."""
    short = x["at"] <= x["n"] - (6 * x["n"] + 6) // 7
    x = {k: v[short] for k, v in x.items()}
    key = (y["token"].astype(np.uint64) << np.uint64(32)) | y["n"].astype(np.uint64)
    low = x["token"].astype(np.uint64) << np.uint64(32)
    begin = np.searchsorted(key, low | x["n"].astype(np.uint64))
    size = np.searchsorted(key, low | (4 * x["n"] // 3).astype(np.uint64), side="right") - begin
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] + TILE, side="right")) - 1)
        i = np.repeat(np.arange(at, to), size[at:to])
        j = np.arange(total[at], total[to]) + (begin - total[:-1])[i]
        at = to
        n, m = x["n"][i], y["n"][j]
        need = (3 * (n + m) + 6) // 7
        fit = (np.minimum(n - x["at"][i], m - y["at"][j]) >= need) & (x["h1"][i] != y["h1"][j])
        i, j = i[fit], j[fit]
        alone = np.bitwise_count(x["even"][i] ^ y["even"][j]) + np.bitwise_count(x["odd"][i] ^ y["odd"][j])
        both, need = (n + m)[fit], need[fit]
        fit = both - alone >= 2 * need
        i, j, alike = i[fit], j[fit], ((both - alone) / (both + alone))[fit]
        for a, b, k, m in ((x, y, i, j), (y, x, j, i)):
            later = ~a["settled"][k] & (a["era"][k] >= b["era"][m])
            yield a["h1"][k[later]], b["h1"][m[later]], alike[later]


def _met(prefixes: DataFrame) -> DataFrame:
    """(h1, best, rest): for each open set the sets that share a token of their prefixes with it, may be similar and may
    come earlier; the likest ``BEST`` of a bucket first. A set settled already needs none, and one known to come later
    can't settle it. Sets that stand in some ``rest`` have a row without any.

    Of two similar sets the one of fewer tokens holds a common one among its rarest n - ceil(6n / 7) + 1 already."""

    def listed(of: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)), pa.array(values.view(np.int64)))

    def meet(table):
        rows = {k: v.astype(np.int64) if k in ("at", "n") else v for k, v in _unpacked(table.column("data")).items()}
        order = np.argsort((rows["token"].astype(np.uint64) << np.uint64(32)) | rows["n"].astype(np.uint64))
        rows = {k: v[order] for k, v in rows.items()}
        sets, of = np.unique(rows["h1"], return_inverse=True)
        era = np.full(len(sets), ERAS, np.uint8)
        np.minimum.at(era, of, rows["settled"] >> 1)
        done = (rows["settled"] & 1).astype(bool)
        rows |= {"settled": done, "era": era[of]}
        unsettled, settled = ({k: v[which] for k, v in rows.items()} for which in (~done, done))
        found = [pair for x, y in ((unsettled, unsettled), (unsettled, settled), (settled, unsettled)) for pair in _pairs_of(x, y)]
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0))
        later, other, alike = (np.concatenate(x) for x in zip(none, *found, strict=True))
        order = np.lexsort((other, -alike, later))
        later, other = later[order], other[order]
        fresh = np.ones(len(later), bool)
        fresh[1:] = (later[1:] != later[:-1]) | (other[1:] != other[:-1])
        later, other = later[fresh], other[fresh]
        sets, heads, of = np.unique(later, return_index=True, return_inverse=True)
        best = np.arange(len(later)) - heads[of] < BEST
        more = np.unique(other[~best])
        n = len(sets) + len(more)
        return pa.table({"h1": np.concatenate([sets, more]).view(np.int64), "best": listed(of[best], other[best], n), "rest": listed(of[~best], other[~best], n)})

    return prefixes.groupBy("bucket").applyInArrow(meet, "h1 long, best array<long>, rest array<long>")


def _unheld(listed: DataFrame, *held: DataFrame) -> DataFrame:
    """(g1, h1): pairs of (h1, g1) that were in none of ``held``, the lesser hash first."""
    pairs = listed.select(F.least("g1", "h1").alias("g1"), F.greatest("g1", "h1").alias("h1")).distinct()
    for before in held:
        pairs = pairs.join(before, ["g1", "h1"], "left_anti")
    return pairs


def _whole(docs: DataFrame, folded: DataFrame, sides: DataFrame) -> DataFrame:
    """(h1, h2, tokens, place): the full sets of the first hashes in ``sides``."""
    wanted = saved(folded.select("h1", "h2", "place").join(sides.distinct().hint("shuffle_hash"), "h1", "left_semi"), "lines-wanted")
    mark = F.col("place.text_id").bitwiseXOR(F.col("place.line").cast("long") * 1_000_003)
    whole = _fetch(docs, _marks(wanted.select(mark.alias("mark")))).join(wanted, ["h1", "h2"])
    sets = saved(whole.dropDuplicates(["h1", "h2"]), "line-tokens")
    dropped(wanted)
    return sets


def _later(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(h1, h2, place) of the later set of each pair whose full sets are similar."""
    left = sets.select(F.col("h1").alias("_h1"), F.struct("place", "h1", "h2").alias("x"), F.col("tokens").alias("xs"))
    right = sets.select(F.col("h1").alias("_g1"), F.struct("place", "h1", "h2").alias("y"), F.col("tokens").alias("ys"))
    both = pairs.join(left, F.col("h1") == F.col("_h1")).join(right, F.col("g1") == F.col("_g1"))
    shared = F.size(F.array_intersect("xs", "ys"))
    apart = ~F.col("x.place").eqNullSafe(F.col("y.place"))
    alike = both.filter(apart & (4 * shared >= 3 * (F.size("xs") + F.size("ys") - shared))).select(F.greatest("x", "y").alias("later"))
    return saved(alike.select("later.h1", "later.h2", "later.place").distinct(), "lines-later")


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("h1").union(pairs.select("g1"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, line): lines whose token set has a Jaccard similarity of 0.75 or more with that of an earlier
    line; text_id is a hash of the text.

    Lines are parted by U+000A and numbered from 0; tokens are words with A-Z lower-cased; lines come in the order of
    doc_id, then text_id, then number. Equal sets fold into the first of them. Sets join on a common token of their
    prefixes; length, positions and parities rule pairs out, and what passes is confirmed on the full sets. So that groups
    of near copies don't give all their pairs, sets are first held against one of the earliest with each of their
    signatures; those found later than a similar one are settled. The whole join then lists for each open set those that
    may come earlier. Open sets are held against the likest few, and only those that stay open against all others.
    Prefixes are shuffled packed, a row for each bucket of token hashes that a task has tokens of; the tokens of one
    bucket meet in one task. Settled sets are told by two
    tables of bits: first hashes of settled sets, less second hashes of others that fall on them. So none is taken for
    settled that isn't.

    Lines without tokens stay. Null texts have no lines. Rows alike in doc_id and text are one document and lose the same
    lines; other rows of one doc_id, or without one, stand each for itself, those without first. Other columns are not
    read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    scanned = saved(_scan(docs), "lines")
    lines = scanned.filter("line is not null")
    folded = saved(lines.groupBy("h1", "h2", "n").agg(F.min(F.struct(*PLACE)).alias("place"), F.first("bits").alias("bits"), F.first("signatures").alias("signatures"), F.count("*").alias("copies")), "line-sets")
    tested = saved(_with_first(folded), "line-pairs")
    tokens = _whole(docs, folded, _both(tested))
    early = _later(tokens, tested)
    dropped(tokens)
    settled = _marks(early.select("h1"))
    at = F.col("h1").bitwiseAND(F.lit(MARKS - 1))
    marked = folded.select("h1", "h2", at.alias("_at")).join(early.select(at.alias("_at")).distinct().hint("shuffle_hash"), "_at", "left_semi")
    fallen = marked.join(early, ["h1", "h2"], "left_anti")
    sent, least, most = folded.agg(F.sum(F.expr("n - ceil(3 * n / 4) + 1")), F.min("place.doc_id"), F.max("place.doc_id")).first()
    prefixes = _prefixes(docs, token_sketch(scanned), (settled, _marks(fallen.select("h2"))), (sent or 0) // BUCKET + 1, (least or 0, most or 0))
    met = saved(_met(prefixes), "line-candidates")
    best = saved(_unheld(met.select("h1", F.explode("best").alias("g1")), tested), "line-pairs")
    sets = _whole(docs, folded, _both(best).union(met.filter((F.size("best") == 0) | (F.size("rest") > 0)).select("h1")))
    near = _later(sets, best)
    still = sets.select("h1", "h2").join(near, ["h1", "h2"], "left_anti").select("h1").distinct()
    left = met.filter(F.size("rest") > 0).select("h1", "rest").join(still, "h1", "left_semi")
    pairs = saved(_unheld(left.select("h1", F.explode("rest").alias("g1")), tested, best), "line-pairs")
    far = _later(sets, pairs)
    late = early.union(near).union(far).distinct()
    often = folded.filter("copies > 1").select("h1", "h2", "place").join(late.select("h1", "h2", F.lit(True).alias("late")), ["h1", "h2"], "left")
    again = often.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "place", "late").hint("shuffle_hash")
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    copies = lines.select(*PLACE, "h1", "h2").join(again, same).filter(F.col("late").isNotNull() | ~F.struct(*PLACE).eqNullSafe(F.col("place")))
    out = saved(copies.select(*PLACE).union(late.select("place.*")).distinct(), "lines-removed")
    for table in (early, near, far, tested, met, best, pairs, sets, scanned, folded):
        dropped(table)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) for every row of ``docs``: the text without the lines of
    :func:`removed_lines`. Null text stays null with no lines."""
    gone = removed_lines(docs).groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_id").alias("_text_id")).agg(F.collect_set("line").alias("removed"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("text") == F.col("_text_id"))
    joined = docs.select("doc_id", "text").join(gone.hint("shuffle_hash"), same, "left")
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(removed, i))
    text = F.when(F.size(removed) == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(breaks + 1)
    return joined.select("doc_id", n.cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), text.alias("text"))
