"""Near-duplicate documents: one-permutation MinHash, optimal densification, banded buckets, star-shaped edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.llm.graph import components, extended
from keystrand.llm.store import bounded_batches, dropped, free, saved
from keystrand.llm.words import chunks, mix64, shingle_sets, text_buffers, words_of

BANDS = 50
ROWS = 4
BINS = BANDS * ROWS
THRESHOLD = 75
#: Rows of one token that a task of the last join holds on its indexed side.
SALTED = 2_000


@lru_cache(maxsize=1)
def _turns() -> np.ndarray:
    """For each bin the places of all bins in an order of its own, as ranks: where an empty bin looks first, then next."""
    at = np.arange(BINS * BINS, dtype=np.uint64).reshape(BINS, BINS)
    return np.argsort(np.argsort(mix64(at + np.uint64(0x5851F42D4C957F2D)), axis=1), axis=1).astype(np.int16)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each of ``BINS`` equal ranges; an empty range takes that of the first filled one in its own
    fixed random order (optimal densification). ``shingles`` is sorted and not empty."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    filled = bins[first].astype(np.int64)
    out = np.empty(BINS, dtype=np.uint64)
    out[filled] = shingles[first]
    if len(filled) < BINS:
        empty = np.setdiff1d(np.arange(BINS), filled, assume_unique=True)
        out[empty] = shingles[first][np.argmin(_turns()[empty][:, filled], axis=1)]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    mixed = mix64(values.reshape(BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=np.uint64))
    return mix64(mixed.sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_buffers(batch.column("text"))
        for low, high in chunks(at):
            n, one, two, keys = [], [], [], []
            for s in shingle_sets(words_of(data, at[low : high + 1])):
                n.append(len(s))
                one.append(s.sum(dtype=np.uint64))
                two.append(mix64(s + np.uint64(11)).sum(dtype=np.uint64))
                if len(s):
                    keys.append(band_keys(signature(s)))
            sizes = np.array(n, dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            hashes = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), pa.array(sizes), *hashes, bands], ["doc_id", "n", "h1", "h2", "bands"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = text_buffers(batch.column("text"))
        for low, high in chunks(at):
            sets = list(shingle_sets(words_of(data, at[low : high + 1])))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), lists], ["doc_id", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are alike enough."""
    left = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("sb"))
    joined = pairs.join(left, F.col("a") == F.col("x")).join(right, F.col("b") == F.col("y"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return joined.filter(100 * shared >= THRESHOLD * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _ordered(a: str, b: str, na: str, nb: str, rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) whose sizes allow the similarity at all."""
    fit = 100 * F.least(na, nb) >= THRESHOLD * F.greatest(na, nb)
    return rows.filter(fit & (F.col(a) != F.col(b))).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _across(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, id, n, component) of buckets whose members are in two components or more."""
    known = labels.select(F.col("id").alias("_id"), F.col("component"))
    placed = members.join(known, F.col("id") == F.col("_id"), "left").select("band", "key", "id", "n", F.coalesce("component", "id").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select(F.col("key").alias("_key"))
    return placed.join(split, F.col("key") == F.col("_key"), "left_semi")


def _prefixes(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """(token, salts, at, short, id, n, component): the shingles of each set that stand in its prefix and in sets of two
    components, with their place in the order of how often they are held; those of one component only come first and
    are left out, as they part no two components. Of two sets alike enough, the one that is not larger has a shingle among its
    ``short`` ones that the other has in its prefix."""
    own = apart.select("id", "n", "component").distinct()
    held = sets.join(own, F.col("doc_id") == F.col("id")).select("id", "n", "component", F.explode("shingles").alias("token"))
    counts = held.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("count")).filter("lo < hi").select(F.col("token").alias("_token"), "count")
    common = held.join(counts, F.col("token") == F.col("_token")).groupBy("id", "n", "component").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("common"))
    before = F.col("n") - F.size("common")
    least = lambda up, down: F.floor((F.col("n") * up + (down - 1)) / down)
    length = F.greatest(F.lit(0), F.col("n") - least(THRESHOLD, 100) + 1 - before).cast("int")
    rows = common.select("id", "n", "component", before.alias("before"), F.posexplode(F.slice("common", 1, length)).alias("at", "t"))
    placed = rows.select("id", "n", "component", (F.col("at") + F.col("before")).alias("at"), F.col("t.token").alias("token"), (F.floor(F.col("t.count") / SALTED) + 1).cast("int").alias("salts"))
    return placed.withColumn("short", F.col("at") <= F.col("n") - least(2 * THRESHOLD, 100 + THRESHOLD))


def _left_apart(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """All pairs of different components that can be alike enough, by prefixes, sizes and places; none is missed."""
    prefixes = saved(_prefixes(apart, sets), "near-prefixes")
    short = prefixes.filter("short").select("token", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("cid"), F.col("n").alias("cn"), F.col("component").alias("cc"), F.col("at").alias("ca"))
    other = prefixes.select(F.col("token").alias("_token"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("_salt"), "id", "n", "component", "at")
    sized = (F.col("cn") <= F.col("n")) & (100 * F.col("cn") >= THRESHOLD * F.col("n"))
    placed = (100 + THRESHOLD) * F.least(F.col("n") - F.col("at"), F.col("cn") - F.col("ca")) >= THRESHOLD * (F.col("n") + F.col("cn"))
    met = short.join(other, (F.col("token") == F.col("_token")) & (F.col("salt") == F.col("_salt")) & (F.col("component") != F.col("cc")) & sized & placed)
    return _ordered("id", "cid", "n", "cn", met)


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; the smallest doc_id of a component is kept.

    Sets are the distinct five-word shingles of whole texts (fewer words: all of them as one; none: linked to nothing).
    Equal sets fold into one representative first, so groups of exact copies cost one row. Representatives meet in
    buckets of bands of their signatures. Within a bucket the edges are stars, never all pairs: (1) every member with the
    member of the least id and with one drawn by a hash, (2) in buckets whose members are not yet connected, every
    member with the one that has most links so far. What then stands in a bucket with members of two components is
    (3) joined on prefixes of the full sets, the least held shingles first: every pair of different components that
    sizes and places allow is tested, so no link between members of a bucket is lost, and the search ends there. Every
    edge is confirmed on the full sets. Edges of (1) and (2) grow in proportion to the members of buckets, whatever a
    bucket's size. Two sets at the threshold share no bucket in less than one of 20,000 pairs, as simulated for unions
    of 4 to 800 shingles (``tests/llm/test_near_dup_whole.py``).

    Repeated rows of one doc_id are one document and stay or go together. A row without doc_id is in no component and
    is kept. Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n long, h1 long, h2 long, bands array<long>"
    signed = saved(docs.select("doc_id", "text").mapInArrow(_sign, schema), "near-signed")
    folded = saved(signed.filter("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "near-folded")
    buckets = folded.select("id", "n", F.posexplode("bands").alias("band", "key"))
    member = F.struct("id", "n")
    centre = F.min_by(member, F.xxhash64("id"))
    stars = buckets.groupBy("key").agg(F.min(member).alias("first"), centre.alias("drawn"), F.count("*").alias("size")).filter("size > 1").withColumnRenamed("key", "_key")
    starred = saved(buckets.join(stars, F.col("key") == F.col("_key")).select("band", "key", "id", "n", "first", "drawn"), "near-starred")
    members = starred.select("band", "key", "id", "n")
    two = starred.select("id", "n", F.explode(F.array("first", "drawn")).alias("c")).select("id", "n", F.col("c.id").alias("cid"), F.col("c.n").alias("cn"))
    tested = saved(_ordered("id", "cid", "n", "cn", two), "near-pairs")
    wanted = members.select(F.col("id").alias("_id")).distinct()
    sets = saved(docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_id"), "left_semi").mapInArrow(_gather, "doc_id long, shingles array<long>"), "near-sets")
    links = saved(_verified(tested, sets), "near-links")
    labels = components(links)

    degrees = links.select(F.explode(F.array("a", "b")).alias("_d")).groupBy("_d").agg(F.count("*").alias("degree"))
    apart = _across(members, labels)
    weighed = apart.join(degrees, F.col("id") == F.col("_d"), "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hubs = weighed.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("turned"), "id", "n", "component")).alias("hub")).select(F.col("key").alias("_key"), F.col("hub.id").alias("cid"), F.col("hub.n").alias("cn"), F.col("hub.component").alias("cc"))
    pairs = _ordered("id", "cid", "n", "cn", apart.join(hubs, F.col("key") == F.col("_key")).filter("component <> cc"))
    more = saved(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs")
    fresh = saved(_verified(more, sets), "near-links")
    if not fresh.isEmpty():
        labels, tested = extended(labels, fresh), tested.unionByName(more)
    more = saved(_left_apart(_across(members, labels), sets).join(tested, ["a", "b"], "left_anti"), "near-pairs")
    fresh = saved(_verified(more, sets), "near-links")
    if not fresh.isEmpty():
        labels = extended(labels, fresh)
    dropped(sets)
    reps = folded.select("n", "h1", "h2", "id").join(labels.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    found = reps.select(F.col("n").alias("_n"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.coalesce("component", "id").alias("_component"))
    same = (F.col("n") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    out = signed.select("doc_id", "n", "h1", "h2").join(found, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest doc_id; columns as they came.

    A row without doc_id is known by its text instead and comes after all that have one. Of rows alike in doc_id and
    text one stays. Rows of one doc_id with different texts are one document. Rows without words all stay, but for
    repeated ones.
    """
    key, same, gone, copies = (free(docs, n) for n in ("near_key", "near_text", "near_gone", "near_copies"))
    by_text = F.xxhash64("text").bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), by_text), same: F.xxhash64("text")})
    found = classes(keyed.select(F.col(key).alias("doc_id"), "text"))
    left = saved(found.filter("not kept").select(F.col("doc_id").alias(gone)).distinct(), "near-gone")
    kept = keyed.join(left, F.col(key) == F.col(gone), "left_anti")
    often = saved(keyed.groupBy(F.col(key).alias(gone), F.col(same).alias(copies)).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "near-repeated")
    if often.isEmpty():
        return kept.select(*docs.columns)
    repeated = (F.col(key) == F.col(gone)) & (F.col(same) == F.col(copies))
    once = kept.join(often, repeated, "left_semi").dropDuplicates([key, same])
    return kept.join(often, repeated, "left_anti").unionByName(once).select(*docs.columns)
