"""Record stores: fetch by id, dictionary coding, reordering, sizes, entropy, suffix arrays, sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrand.operators.keyset import build, ordinals
from keystrand.plans.prefix import ranged, running_sums

#: Rows of one text's suffixes in a batch; each carries the text.
SUFFIXES_AT_ONCE = 1 << 10


def get(records: DataFrame, wanted: DataFrame, rec_id: str) -> DataFrame:
    """The records with the ids of ``wanted``. Spark broadcasts the ids if they are few."""
    return records.join(wanted.select(rec_id).distinct(), rec_id, "left_semi")


def dictionary(rows: DataFrame, column: str) -> DataFrame:
    """(code, value): dense codes from 0 in byte order."""
    return ordinals(build(rows, column)).select(F.col("ord").alias("code"), F.col("word").alias("value"))


def encoded(rows: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """``rows`` with ``code`` in the column's stead."""
    return rows.join(codes.withColumnRenamed("value", column), column).drop(column)


def decoded(rows: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    return rows.join(codes.withColumnRenamed("value", column), "code").drop("code")


def reordered(records: DataFrame, order: list[str], rec_id: str) -> DataFrame:
    """(new_id, old id, ...): ``records`` numbered from 0 in a new order; only ids are sorted, payloads are joined."""
    keys = ranged(records.select(*{*order, rec_id}), *order)
    numbered = running_sums(keys, order, {"new_id": F.lit(1)}).select(F.col("new_id").cast("long").alias("new_id"), rec_id)
    return numbered.join(records, rec_id)


def sizes(records: DataFrame, by: str, column: str) -> DataFrame:
    return records.groupBy(by).agg(F.count("*").alias("n_records"), F.sum(F.octet_length(column)).cast("long").alias("n_bytes"))


def fixed_or_variable(records: DataFrame, column: str) -> DataFrame:
    """``column`` with ``route``: fixed for values of the most frequent length (the shortest of equals), else variable."""
    lengths = records.groupBy(F.octet_length(column).alias("len")).agg(F.count("*").alias("n"))
    fixed = lengths.agg(F.max_by("len", F.struct("n", -F.col("len"))).alias("fixed"))
    return records.join(F.broadcast(fixed)).select(column, F.when(F.octet_length(column) == F.col("fixed"), "fixed").otherwise("variable").alias("route"))


def entropy(rows: DataFrame, column: str) -> DataFrame:
    """(n_symbols, bits): Shannon entropy of a column's characters, to six digits."""
    counts = rows.select(F.explode(F.split(column, "")).alias("c")).filter("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return counts.join(F.broadcast(total)).agg(F.count("*").alias("n_symbols"), F.round(-F.sum(share * F.log2(share)), 6).alias("bits"))


def byte_entropy(rows: DataFrame, column: str) -> DataFrame:
    """:func:`entropy` of a column's bytes."""
    return entropy(rows.select(F.decode(F.col(column).cast("binary"), "ISO-8859-1").alias("bytes")), "bytes")


def suffix_order(text: str) -> np.ndarray:
    """Where the suffixes of a text start, in their order, by doubling the length that is compared: memory in proportion
    to the text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    n, width = len(points), 1
    rank = np.unique(points, return_inverse=True)[1] + 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - width)] = rank[width:]
        order = np.lexsort((ahead, rank))
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (ahead[order][1:] != ahead[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if fresh.all() or width >= n:
            return order
        width *= 2


def suffix_array(texts: DataFrame, column: str) -> DataFrame:
    """(column, rank, at): the suffixes of each row's text in order, by character positions from 0; null and empty texts
    have none. A text is sorted where it stands, so it may be long; rows aren't shuffled."""

    def run(batches):
        for batch in batches:
            for text in batch.column(0):
                order = suffix_order(text.as_py() or "") if text.as_py() else np.zeros(0, np.int64)
                for low in range(0, len(order), SUFFIXES_AT_ONCE):
                    part = order[low : low + SUFFIXES_AT_ONCE]
                    same = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([text.as_py()])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([same, pa.array(np.arange(low, low + len(part))), pa.array(part)], [column, "rank", "at"])

    return texts.select(column).mapInArrow(run, f"`{column}` string, rank long, at long")


def sample(rows: DataFrame, rec_id: str, per_mille: int) -> DataFrame:
    """A fixed sample by id for dictionaries, of ids of any sign and size."""
    return rows.filter(F.pmod(F.pmod(F.col(rec_id), F.lit(1000)) * 7919, F.lit(1000)) < per_mille).select(rec_id)
