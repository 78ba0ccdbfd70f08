"""Ordered key sets: distinct byte strings with scan, seek, ordinal and membership queries.

UTF-8 strings sort in Spark as their bytes do. Duplicates fold, since a key set is a set; how the original builder
treats them is not visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.plans.prefix import next_key, ranged, running_sums


def build(rows: DataFrame, column: str) -> DataFrame:
    """The key set (word) of a column; nulls are dropped."""
    return rows.select(F.col(column).alias("word")).filter("word is not null").distinct()


def words(rows: DataFrame, column: str, separators: str = "[ \n]") -> DataFrame:
    """The key set of a text column's non-empty pieces."""
    return rows.select(F.explode(F.split(column, separators)).alias("word")).filter("word <> ''").distinct()


def scan(keys: DataFrame) -> DataFrame:
    """All words in byte order."""
    return keys.select("word").orderBy("word")


def write_text(keys: DataFrame, path: str) -> int:
    """Write all words in order, one a line, and return how many there are."""
    scan(keys).write.text(path)
    return keys.sparkSession.read.text(path, lineSep="\n").count()


def stats(keys: DataFrame) -> DataFrame:
    """(n_keys, key_bytes)."""
    return keys.agg(F.count("*").alias("n_keys"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)).cast("long").alias("key_bytes"))


def first(keys: DataFrame) -> DataFrame:
    """The least word, as a cursor at the beginning stands on it; no row for an empty set."""
    return keys.agg(F.min("word").alias("word")).filter("word is not null")


def last(keys: DataFrame) -> DataFrame:
    """The greatest word; no row for an empty set. That a cursor at the end stands there is our reading of the name."""
    return keys.agg(F.max("word").alias("word")).filter("word is not null")


def ordinals(keys: DataFrame) -> DataFrame:
    """(word, ord): the number of lesser words. Our reading of the word count that automata keep."""
    return running_sums(ranged(keys, "word"), ["word"], {"ord": F.lit(1)}).select("word", F.col("ord").cast("long").alias("ord"))


def lower_bound(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, found): for each probe the least word not below it, null if there is none.

    Probes and keys are put in one order, a probe before an equal key, and each takes the next key: no range join.
    That the cursor is put on that word is our reading of the name; that every stored word is found is fixed.
    """
    both = probes.select(F.col("probe").alias("at"), F.lit(0).alias("is_key"), F.lit(None).cast("string").alias("key")).unionByName(keys.select(F.col("word").alias("at"), F.lit(1).alias("is_key"), F.col("word").alias("key")))
    return next_key(ranged(both, "at"), ["at", "is_key"], "key", "found").filter("is_key = 0").select(F.col("at").alias("probe"), "found")


def seek(keys: DataFrame, probe: str) -> DataFrame:
    """The least word not below one probe; the comparison reaches the Parquet scan."""
    return keys.filter(F.col("word") >= probe).orderBy("word").limit(1)


def with_prefix(keys: DataFrame, prefix: str) -> DataFrame:
    return keys.filter(F.col("word").startswith(prefix)).select("word")


def members(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows of ``probes`` (word) that are in the set."""
    return probes.join(keys, "word", "left_semi")


def missing(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows of ``probes`` (word) that are not in the set."""
    return probes.join(keys, "word", "left_anti")
