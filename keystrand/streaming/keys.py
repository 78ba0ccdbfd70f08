"""Key sets and counts over streams, kept up incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_words(lines: DataFrame, column: str, ts: str, delay: str = "10 minutes", separators: str = "[ \n]") -> DataFrame:
    """(word, ts) at a word's first sight; state is let go after ``delay`` of event time, so it stays bounded."""
    words = lines.withWatermark(ts, delay).select(F.explode(F.split(column, separators)).alias("word"), F.col(ts).alias("ts"))
    return words.filter("word <> ''").dropDuplicatesWithinWatermark(["word"])


def byte_counts(rows: DataFrame, column: str) -> DataFrame:
    """(n_records, n_bytes) so far."""
    return rows.groupBy().agg(F.count("*").alias("n_records"), F.sum(F.octet_length(column)).alias("n_bytes"))
