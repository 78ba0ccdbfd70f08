"""Rank, select and run lengths over a bit sequence (pos, bit). Positions are distinct and ascend; gaps are allowed.

The answers for ones mirror those for zeros; only zeros are pinned by the original tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrand.plans.prefix import BUCKET, ranged, running_sums


def _is(value: int):
    return (F.col("bit") == value).cast("long")


def rank(bits: DataFrame, value: int) -> DataFrame:
    """(pos, rank): bits of ``value`` strictly before each position."""
    return running_sums(ranged(bits, "pos"), ["pos"], {"rank": _is(value)}).select("pos", F.col("rank").cast("long").alias("rank"))


def select(bits: DataFrame, value: int) -> DataFrame:
    """(i, pos): the position of the i-th bit of ``value``, from 0."""
    found = ranged(bits.filter(F.col("bit") == value), "pos")
    return running_sums(found, ["pos"], {"i": F.lit(1)}).select(F.col("i").cast("long").alias("i"), "pos")


def run_before(bits: DataFrame, value: int) -> DataFrame:
    """(pos, n): bits of ``value`` in a row that end just before each position.

    That is the rank at the position less the rank at the last other bit before it, so two running sums and a running
    maximum do; a run may cross any number of ranges.
    """
    ranked = running_sums(ranged(bits, "pos"), ["pos"], {"rank": _is(value)})
    stop = F.when(F.col("bit") != value, F.col("rank"))
    inside = F.max(stop).over(W.partitionBy(BUCKET).orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    per = ranked.groupBy(BUCKET).agg(F.max(stop).alias("_stop"))
    carried = per.select(F.col(BUCKET).alias("_at"), F.max("_stop").over(W.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    joined = ranked.withColumn("_inside", inside).join(F.broadcast(carried), F.col(BUCKET) == F.col("_at"))
    return joined.select("pos", (F.col("rank") - F.coalesce("_inside", "_carried", F.lit(0))).cast("long").alias("n"))


def run_from(bits: DataFrame, value: int) -> DataFrame:
    """(pos, n): bits of ``value`` in a row that start at each position; 0 at any other bit."""
    ranked = running_sums(ranged(bits, "pos"), ["pos"], {"rank": _is(value)})
    stop = F.when(F.col("bit") != value, F.col("rank"))
    inside = F.min(stop).over(W.partitionBy(BUCKET).orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0))
    per = ranked.groupBy(BUCKET).agg(F.min(stop).alias("_stop"))
    carried = per.select(F.col(BUCKET).alias("_at"), F.min("_stop").over(W.orderBy(F.desc(BUCKET)).rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    whole = ranked.agg(F.sum(_is(value)).alias("_whole"))
    joined = ranked.withColumn("_inside", inside).join(F.broadcast(carried), F.col(BUCKET) == F.col("_at")).join(F.broadcast(whole))
    return joined.select("pos", (F.coalesce("_inside", "_carried", "_whole") - F.col("rank")).cast("long").alias("n"))


def is_one(bits: DataFrame) -> DataFrame:
    return bits.select("pos", (F.col("bit") == 1).alias("is1"))
