"""Sharding down a hierarchical weighted hash tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrand.llm.copies import numbered
from keystrand.llm.store import free

REGION = 10
RACK = 5


def _sizes(total: int, most: int) -> list[int]:
    return [min(most, total - at) for at in range(0, total, most)]


def _hashed(*parts: Column, digits: int) -> Column:
    """The first hex digits of the parts' MD5, as a number; null counts as empty text."""
    text = F.concat(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _drawn(key: Column, path: str, weights: list[int]) -> Column:
    """Index of the child with the least -ln(u) / weight, u drawn from the key and the child's path: a child wins in
    proportion to its weight, and a change of one weight moves keys only into or out of that child."""
    if len(weights) == 1:
        return F.lit(0)
    draws = []
    for child, weight in enumerate(weights):
        u = (_hashed(F.lit(f"{path}/{child}:"), key, digits=12) + F.lit(0.5)) / F.lit(float(2**48))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("at"), F.lit(child).alias("child")))
    return F.least(*draws)["child"]


def tree_shard(doc_id: Column, shards: int, region: int = REGION, rack: int = RACK) -> Column:
    """Shard of a document: regions of ``region`` shards hold racks of ``rack``, and weights are numbers of shards.

    A shard added after a full region opens a region of its own, so it takes rows only into itself; one added to a
    region that is not full moves rows within and into that region alone.
    """
    regions = _sizes(shards, region)
    by_region = []
    for r, size in enumerate(regions):
        racks = _sizes(size, rack)
        by_rack = [F.lit(r * region + k * rack) + _drawn(doc_id, f"{r}/{k}", [1] * n) for k, n in enumerate(racks)]
        by_region.append(_picked(_drawn(doc_id, str(r), racks), by_rack))
    return _picked(_drawn(doc_id, "", regions), by_region).cast("int")


def _picked(at: Column, options: list[Column]) -> Column:
    if len(options) == 1:
        return options[0]
    out = F.when(at == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(at == i, option)
    return out


def assign_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``, under the law ``key``.

    size is the text's UTF-8 bytes plus 16, null text counts none and has the check sum of the empty text. Rows of a
    null doc_id go together, as do repeated rows of one doc_id. Slots number a shard's rows from 0 by a hash bucket of
    id, check sum, size and the number among rows alike in these, so a bucket holds about a 256th of a shard whatever
    repeats; a running sum of bucket counts joins them, so no task sorts a whole shard. Other columns are not read; an
    empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    told = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = numbered(told, "copy", "doc_id", "size", "text_crc32")
    slot_key = [x for c in ("doc_id", "size", "text_crc32", "copy") for x in (F.lit(":"), F.col(c))]
    bucket = _hashed(F.lit("slot"), *slot_key, digits=2).cast("int")
    rows = rows.select("*", tree_shard(F.col("doc_id"), shards).alias("shard"), tree_shard(F.col("doc_id"), shards + 1).alias("grown_shard"), bucket.alias("bucket"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col("shard").alias("_shard"), F.col("bucket").alias("_bucket"), F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "copy")) - 1
    placed = rows.withColumn("place", place).join(starts, (F.col("shard") == F.col("_shard")) & (F.col("bucket") == F.col("_bucket")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """``docs`` with the column shard (renamed with underscores before it if ``docs`` has one). Texts aren't shuffled."""
    return docs.withColumn(free(docs, "shard"), tree_shard(F.col("doc_id"), shards))
