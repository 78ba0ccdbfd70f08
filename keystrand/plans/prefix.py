"""Running sums and neighbours over a global order, in two passes, so that no window takes the whole table.

Rows are dealt by ranges of the order; each range is summed up in one row; a window over those few rows (one a
partition) gives each range what came before it; windows inside the ranges do the rest. What follows a row is read as
what comes before it in the order turned round, since a window that ends with the last row takes quadratic time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrand.plans.tables import saved

BUCKET = "_bucket"


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in ranges of ``order``, numbered by ``_bucket`` and written out, since partition numbers don't outlast a
    recomputation. Rows that are equal in ``order`` share a range."""
    return saved(df.repartitionByRange(*order).withColumn(BUCKET, F.spark_partition_id()), "ranged")


def _with_carry(df: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """One row a bucket is joined: as many as partitions, so it is safe to broadcast."""
    return df.join(F.broadcast(per_bucket.withColumnRenamed(BUCKET, "_at")), F.col(BUCKET) == F.col("_at")).drop("_at")


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], inclusive: bool = False) -> DataFrame:
    """``df`` (from :func:`ranged`) with each sum over the rows before, or up to and with, its own."""
    totals = df.groupBy(BUCKET).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    before = W.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(BUCKET, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_base_{n}") for n in sums])
    inside = W.partitionBy(BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    part = df.withColumns({n: F.coalesce(F.sum(e).over(inside), F.lit(0)) for n, e in sums.items()})
    joined = _with_carry(part, bases)
    return joined.withColumns({n: F.col(n) + F.col(f"_base_{n}") for n in sums}).drop(*[f"_base_{n}" for n in sums])


def previous(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` (from :func:`ranged`) with the value of the row before as ``name``; null for the first."""
    last = df.groupBy(BUCKET).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select(BUCKET, F.lag("_last").over(W.orderBy(BUCKET)).alias("_carried"))
    inside = W.partitionBy(BUCKET).orderBy(*order)
    joined = _with_carry(df.withColumns({"_lagged": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1}), carried)
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lagged"))).drop("_lagged", "_first", "_carried")


def next_key(df: DataFrame, order: list[str], key: str, name: str) -> DataFrame:
    """``df`` (from :func:`ranged`) with the first ``key`` that isn't null in this row or a later one as ``name``."""
    least = df.groupBy(BUCKET).agg(F.min_by(key, F.when(F.col(key).isNotNull(), F.struct(*order))).alias("_least"))
    carried = least.select(BUCKET, F.last("_least", ignorenulls=True).over(W.orderBy(F.desc(BUCKET)).rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    inside = W.partitionBy(BUCKET).orderBy(*[F.desc(c) for c in order]).rowsBetween(W.unboundedPreceding, 0)
    joined = _with_carry(df.withColumn("_own", F.last(key, ignorenulls=True).over(inside)), carried)
    return joined.withColumn(name, F.coalesce("_own", "_carried")).drop("_own", "_carried")
