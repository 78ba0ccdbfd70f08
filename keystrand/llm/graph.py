"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.llm.store import dropped, saved


def _drawn(c: str) -> Column:
    return F.struct(F.xxhash64(c).alias("draw"), F.col(c).alias("own"))


def _pairs(edges: DataFrame) -> DataFrame:
    return saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for each end of an edge (a, b) with two ends the smallest id that it reaches.

    Every round each id goes to the one of least hash among itself and its neighbours, and on to where that one goes;
    edges are then between what is left, and those that have become loops or repeat go. As the order is drawn, a share
    of the ids goes in each round, also from a long chain. Tables stand in the shared folder; the driver sees none.
    """
    now, labels = _pairs(edges), None
    first = now
    while labels is None or not now.isEmpty():
        both = now.union(now.select("b", "a"))
        up = saved(both.groupBy("a").agg(F.min(_drawn("b")).alias("near")).select(F.col("a").alias("id"), F.least(_drawn("a"), F.col("near"))["own"].alias("parent")), "parents")
        onward = up.select(F.col("id").alias("_id"), F.col("parent").alias("root"))
        step = saved(up.join(onward, F.col("parent") == F.col("_id")).select("id", "root"), "roots")
        at_a, at_b = (step.select(F.col("id").alias(f"_{c}"), F.col("root").alias(f"root_{c}")) for c in "ab")
        ahead = _pairs(now.join(at_a, F.col("a") == F.col("_a")).join(at_b, F.col("b") == F.col("_b")).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        if labels is not None:
            moved = step.select(F.col("id").alias("_id"), F.col("root").alias("next"))
            labels = labels.join(moved, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("next", "root").alias("root"))
        labels = saved(step if labels is None else labels, "labels")
        for table in (up, step, *([] if now is first else [now])):
            dropped(table)
        now = ahead
    least = labels.groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("component"))
    out = saved(labels.join(least, F.col("root") == F.col("_root")).select("id", "component"), "components")
    for table in (first, labels, now):
        dropped(table)
    return out


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of :func:`components` after more edges: only these edges, between components, are gone through."""
    a, b = (labels.select(F.col("id").alias(f"_{c}"), F.col("component").alias(f"at_{c}")) for c in "ab")
    between = edges.join(a, F.col("a") == F.col("_a"), "left").join(b, F.col("b") == F.col("_b"), "left")
    merged = components(between.select(F.coalesce("at_a", "a").alias("a"), F.coalesce("at_b", "b").alias("b")))
    moved = merged.select(F.col("id").alias("_id"), F.col("component").alias("merged"))
    old = labels.join(moved, F.col("component") == F.col("_id"), "left").select("id", F.coalesce("merged", "component").alias("component"))
    fresh = merged.join(labels.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")
    return saved(old.unionByName(fresh), "components")
