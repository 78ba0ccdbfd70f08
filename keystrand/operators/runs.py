"""Run-length sequences, delta-coded integers and sorted runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.plans.prefix import previous, ranged, running_sums

#: Fixed value: the largest integer a run may start from (39 bits).
MOST = 0x7FFFFFFFFF


def encode(rows: DataFrame, order: list[str], value: str, sign: int) -> DataFrame:
    """(run, base, len): greedy runs in which each value is the one before plus ``sign`` (1 or -1)."""
    stepped = previous(ranged(rows.select(*{*order, value}), *order), order, value, "_before")
    broken = (F.col("_before").isNull() | (F.col(value) != F.col("_before") + sign)).cast("long")
    numbered = running_sums(stepped, order, {"run": broken}, inclusive=True)
    base = F.min(value) if sign > 0 else F.max(value)
    return numbered.groupBy((F.col("run") - 1).cast("long").alias("run")).agg(base.cast("long").alias("base"), F.count("*").alias("len"))


def expand(runs: DataFrame, sign: int) -> DataFrame:
    """(run, k, value): the integers of each run."""
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1))
    return runs.select("run", "base", steps.alias("k")).select("run", "k", (F.col("base") + sign * F.col("k")).alias("value"))


def varint_bytes(n: Column) -> Column:
    """Bytes of an unsigned integer in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(n)) / F.lit(7))).cast("long")


def encoded_bytes(runs: DataFrame) -> DataFrame:
    """(n_runs, n_values, n_bytes): five bytes a run, and a variable-length count for those longer than one. A base
    beyond 39 bits is an error."""
    base = F.when(F.col("base") <= MOST, F.col("base")).otherwise(F.raise_error(F.lit("value beyond 39 bits")).cast("long"))
    size = F.lit(5) + F.when(F.col("len") > 1, varint_bytes(F.col("len"))).otherwise(0)
    return runs.filter(base >= 0).agg(F.count("*").alias("n_runs"), F.sum("len").alias("n_values"), F.sum(size).cast("long").alias("n_bytes"))


def differences(rows: DataFrame, value: str) -> DataFrame:
    """(value, diff) of ascending integers; the first one's difference is itself."""
    stepped = previous(ranged(rows.select(F.col(value).cast("long").alias("value")), "value"), ["value"], "value", "_before")
    return stepped.select("value", (F.col("value") - F.coalesce("_before", F.lit(0))).alias("diff"))


def undo_differences(diffs: DataFrame, order: str) -> DataFrame:
    """(order, value): the running sum of ``diff``."""
    return running_sums(ranged(diffs, order), [order], {"_sum": F.col("diff")}, inclusive=True).select(order, F.col("_sum").cast("long").alias("decoded"))


def units(diffs: DataFrame, least: int, width: int) -> DataFrame:
    """Differences as units of ``width`` bits: 0 where the difference stands apart as ``large``; else, for one bit, 1
    for ``least``, and for more bits what is added to ``least``."""
    small = F.col("diff") == least if width == 1 else F.col("diff").between(least + 1, least + (1 << width) - 1)
    unit = F.when(small, F.lit(1).cast("long") if width == 1 else F.col("diff") - least).otherwise(F.lit(0).cast("long"))
    return diffs.select("value", unit.alias("unit"), F.when(~small, F.col("diff")).alias("large"))


def undo_units(coded: DataFrame, least: int, width: int) -> DataFrame:
    """(value, decoded): units decoded as a running sum."""
    small = F.lit(least) if width == 1 else F.lit(least) + F.col("unit")
    diffs = coded.select("value", F.when(F.col("unit") != 0, small).otherwise(F.col("large")).alias("diff"))
    return undo_differences(diffs, "value")


def sorted_runs(rows: DataFrame, seq: str, line: str) -> DataFrame:
    """(seq, run): a run starts wherever a line is less than the one before, bytewise; equal lines go on."""
    stepped = previous(ranged(rows.select(seq, line), seq), [seq], line, "_before")
    broken = F.coalesce(F.col("_before") > F.col(line), F.lit(False)).cast("long")
    return running_sums(stepped, [seq], {"run": broken}, inclusive=True).select(seq, F.col("run").cast("long").alias("run"))


def write_sorted_runs(rows: DataFrame, seq: str, line: str, path: str) -> None:
    """The lines of each run, in order, in a folder of its own."""
    runs = sorted_runs(rows, seq, line).join(rows.select(seq, line), seq)
    runs.repartition("run").sortWithinPartitions("run", seq).select(F.format_string("%06d", "run").alias("run"), F.col(line).alias("value")).write.partitionBy("run").text(path)
