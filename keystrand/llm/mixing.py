"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrand.llm.copies import numbered
from keystrand.llm.store import free, saved

BITS = 12
LEVELS = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, copy: Column) -> Column:
    """A fixed draw of 36 bits from a row's id, its text and its number among rows alike in both."""
    key = F.concat_ws(":", F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), copy.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, target): shares of all sizes by weight; a target stops at ``cap`` times its source's size.

    Targets are min(cap * size, level * weight) for the one level at which they sum to the whole. Sources are put in
    order of size cap over weight; the first whose share of what is left fits sets the level. One row a source, so the
    unpartitioned windows see as many rows as there are sources.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("weight"), F.col("source").asc_nulls_last())
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    levelled = ranked.withColumn("own_level", level)
    fits = F.when(F.col("own_level") * F.col("weight") <= F.col("most"), F.col("own_level"))
    target = F.least(F.col("most"), F.coalesce(F.first(fits, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), F.col("own_level")) * F.col("weight"))
    return levelled.select("source", "source_size", target.alias("target"))


def _thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with ``threshold``: documents whose draw is below it are taken once more than ``repeats`` times.

    Each level sums sizes by source and by the next bits of the draw, and only rows of the bucket in which the budget
    ends go on to the next. At the last level the bucket is one draw; it is in if at least half of it fits.
    """
    found = plan.withColumns({"prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inner = sized.select(F.col("source").alias("s"), "size", F.shiftright("draw", shift).alias("bucket"), F.shiftright("draw", shift + BITS).alias("parent"))
        rows = inner.join(found, F.col("s").eqNullSafe(F.col("source")) & (F.col("parent") == F.col("prefix")))
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.first("extra").alias("extra"), F.first("before").alias("start"))
        by = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        upto = sums.withColumn("upto", F.col("start") + F.sum("n").over(by))
        edge = upto.filter(F.col("upto") > F.col("extra")).groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"), F.col("upto"))).alias("edge"))
        found = plan.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(*plan.columns, F.col("edge.bucket").alias("prefix"), F.col("edge.before").alias("before"), F.col("edge.upto").alias("upto"))
    half = (F.col("upto") + F.col("before") <= 2 * F.col("extra")).cast("long")
    return found.select(*plan.columns, F.coalesce(F.col("prefix") + half, F.lit(0).cast("long")).alias("threshold"))


def mix_plan(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """One row a source: (s, source_size, target, times, threshold)."""
    size = F.greatest(F.col("source_size"), F.lit(1))
    plan = source_targets(sized, weights, cap)
    plan = plan.withColumn("times", F.floor(F.col("target") / size)).withColumn("extra", F.col("target") - F.col("times") * F.col("source_size"))
    plan = saved(plan, "mix-plan")
    return saved(_thresholds(sized, plan).select(F.col("source").alias("s"), "source_size", "target", "times", "threshold"), "mix-thresholds")


def _drawn(docs: DataFrame, copy: str, at: str) -> DataFrame:
    """``docs`` with each row's draw as ``at``."""
    told = numbered(docs, copy, "doc_id", F.coalesce("text", F.lit("")))
    return told.withColumn(at, draw(F.col("doc_id"), F.col("text"), F.col(copy)))


def _sized(docs: DataFrame) -> DataFrame:
    rows = _drawn(docs.select("doc_id", "source", "text"), "copy", "draw")
    return saved(rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), "draw"), "mix-sized")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, repeats) for every row of ``docs``.

    A source takes each of its documents floor(target / size of the source) times, and those with a draw below the
    source's threshold once more. Draws depend on doc_id and text, and on a number among rows alike in both, so reruns
    agree, a larger target keeps what a smaller one took, and rows without doc_id are drawn each for itself. Null or
    empty text: size 0, nothing taken. A null source is a source of its own, the last. Columns of ``docs`` other than
    doc_id, text and source are not read. An empty table gives an empty result.
    """
    sized = _sized(docs)
    found = mix_plan(sized, weights, cap)
    joined = sized.join(found, F.col("source").eqNullSafe(F.col("s")))
    repeats = F.least(F.col("times") + (F.col("draw") < F.col("threshold")).cast("long"), F.lit(int(cap)).cast("long"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` takes it; columns as they came. Texts aren't shuffled: a row
    needs only the plan of its source."""
    at, of, copies, copy, drawn = (free(docs, n) for n in ("mix", "mix_source", "mix_copies", "mix_copy", "mix_draw"))
    found = mix_plan(_sized(docs), weights, cap).select(F.struct("times", "threshold").alias(at), F.col("s").alias(of))
    joined = _drawn(docs, copy, drawn).join(found, F.col("source").eqNullSafe(F.col(of)))
    once_more = (F.col(drawn) < F.col(at)["threshold"]).cast("long")
    repeats = F.least(F.col(at)["times"] + once_more, F.lit(int(cap)).cast("long"))
    taken = joined.withColumn(copies, F.when(repeats > 0, F.sequence(F.lit(1).cast("long"), repeats)))
    return taken.withColumn(copies, F.explode(copies)).select(*docs.columns)
