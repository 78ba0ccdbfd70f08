"""Token counts from flat token files: separators are searched block by block, and counts stitched by a prefix scan."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keystrand.llm.store import bounded_batches, deleted, folder, saved

BLOCK_BYTES = 1 << 20
SUPER = 1024


def read_token_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, start, data): byte ranges of the flat files under ``path``, read with a seek each.

    Only names and lengths are listed by Spark's binary source; no file is read whole. ``block_bytes`` is a multiple of
    the token width, so no token is cut.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "length")
    return read_ranges(listed, block_bytes)


def read_ranges(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:func:`read_token_files` for the files of the given names and lengths (file, length); empty ones give no rows."""
    ranges = files.filter("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long"))).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, length, start in zip(*(batch.column(c).to_pylist() for c in ("file", "length", "start")), strict=True):
                system, name = fs.FileSystem.from_uri(file)
                with system.open_input_file(name) as f:
                    data = f.read_at(min(block_bytes, length - start), start)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([start // block_bytes]), pa.array([start]), pa.array([data], pa.binary())], ["file", "block", "start", "data"])

    schema = "file string, block long, start long, data binary"
    return ranges.repartition(F.col("file"), F.col("start")).mapInArrow(run, schema)


def write_token_files(docs: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], separator: int, folder: str, dtype: str = "<u2") -> DataFrame:
    """Write ``docs`` into flat token files in ``folder``, one a partition: (file, length, first, ids).

    A file holds each document's tokens, then the separator, with nothing to say where one starts. A row with a length
    tells of a whole file. Rows with ids list, for the caller alone, which documents went in from the ``first`` on. A
    task that is run again writes a file of another name, so only those that the rows name count: save the rows before
    reading the files. Null text has no tokens. A token that is the separator or doesn't fit ``dtype`` is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        def row(length, first, ids):
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([length], pa.int64()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], ["file", "length", "first", "ids"])

        head = next(batches, None)
        if head is None:
            return
        task, encode, most = TaskContext.get(), encoder(), np.iinfo(dtype).max
        file = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, name = fs.FileSystem.from_uri(file)
        system.create_dir(name.rpartition("/")[0], recursive=True)
        first = length = 0
        with system.open_output_stream(name, buffer_size=BLOCK_BYTES) as f:
            for batch in chain([head], batches):
                for text in batch.column("text"):
                    tokens = np.array([*encode(text.as_py() or ""), separator], dtype=np.int64)
                    if (tokens[:-1] == separator).any() or tokens.min() < 0 or tokens.max() > most:
                        raise ValueError(f"a token is the separator {separator} or does not fit {dtype}")
                    piece = tokens.astype(dtype).tobytes()
                    f.write(piece)
                    length += len(piece)
                yield row(None, first, batch.column("doc_id").to_pylist())
                first += len(batch)
        yield row(length, None, None)

    return docs.select("doc_id", "text").mapInArrow(run, "file string, length long, first long, ids array<long>")


def scan(blocks: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """(file, block, start, tokens, ends): for each block its first token's place, its length and its separators' places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(dtype).itemsize
        for batch in batches:
            at = [s // width for s in batch.column("start").to_pylist()]
            parts = [np.frombuffer(d.as_buffer(), dtype=dtype) for d in batch.column("data")]
            ends = [np.flatnonzero(p == separator).astype(np.int64) + s for p, s in zip(parts, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(at, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "start", "tokens", "ends"])

    return blocks.select("file", "block", "start", "data").mapInArrow(run, "file string, block long, start long, tokens long, ends array<long>")


def _running(agg: Callable[[Column], Column], value: Column, by: list[str], order: str) -> Column:
    return agg(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1))


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, place, n_tokens, complete): the documents of each file in order, with their lengths without separators.

    A block needs from those before it the number of separators and the place of the last one. Both are scanned first
    over groups of ``SUPER`` blocks, then within a group, so no task holds all blocks of a long file. Tokens after a
    file's last separator are a document that isn't complete.
    """
    rows = scanned.select("file", "block", "ends", (F.col("start") + F.col("tokens")).alias("stop"), F.floor(F.col("block") / SUPER).alias("super"), F.size("ends").alias("n"), F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1).alias("last"))
    groups = rows.groupBy("file", "super").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("stop").alias("stop"))
    carried = groups.select(F.col("file").alias("_file"), F.col("super").alias("_super"), F.coalesce(_running(F.sum, F.col("n"), ["file"], "super"), F.lit(0)).alias("gn"), _running(F.max, F.col("last"), ["file"], "super").alias("glast"))
    within = rows.select("file", "super", "ends", F.coalesce(_running(F.sum, F.col("n"), ["file", "super"], "block"), F.lit(0)).alias("bn"), _running(F.max, F.col("last"), ["file", "super"], "block").alias("blast"))
    joined = within.join(carried, (F.col("file") == F.col("_file")) & (F.col("super") == F.col("_super")))
    before = F.coalesce("blast", "glast", F.lit(-1))
    lengths = F.zip_with("ends", F.concat(F.array(before), F.col("ends")), lambda end, start: end - start - 1)
    whole = joined.select("file", (F.col("gn") + F.col("bn")).alias("base"), F.posexplode(F.slice(lengths, 1, F.size("ends"))).alias("k", "n_tokens"))
    done = whole.select("file", (F.col("base") + F.col("k")).cast("long").alias("place"), F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(True).alias("complete"))
    totals = groups.groupBy("file").agg(F.sum("n").alias("place"), (F.max("stop") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens"))
    tails = totals.filter("n_tokens > 0").select("file", F.col("place").cast("long"), "n_tokens", F.lit(False).alias("complete"))
    return done.unionByName(tails)


def bpe_encoder(spark: SparkSession, ranks_path: str, pattern: str) -> Callable[[], Callable[[str], list[int]]]:
    """A factory, for tasks, of byte-pair encoders over a public vocabulary file of ranks; special tokens' strings in a
    text are ordinary text. The file, of fixed size, is broadcast."""
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def make() -> Callable[[str], list[int]]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return make


def count_tokens(docs: DataFrame, encoder, separator: int, dtype: str = "<u2") -> DataFrame:
    """(doc_id, n_tokens) for every row of ``docs``: its texts go into flat token files, which are then scanned.

    Null and empty texts count 0, very long ones are encoded whole and scanned in blocks like any others; repeated rows
    and rows without doc_id are counted one by one; an empty table gives an empty result. Other columns are not read.
    The files stand in the shared folder until their separators are known.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = folder(spark, "token-files")
    written = saved(write_token_files(docs, encoder, separator, path, dtype), "tokens")
    ends = saved(scan(read_ranges(written.filter("length is not null")), separator, dtype), "token-ends")
    deleted(spark, path)
    listed = written.filter("ids is not null").select(F.col("file").alias("_file"), "first", F.posexplode("ids").alias("k", "doc_id"))
    known = listed.select("_file", (F.col("first") + F.col("k")).alias("_place"), "doc_id")
    return stitch(ends).join(known, (F.col("file") == F.col("_file")) & (F.col("place") == F.col("_place"))).select("doc_id", "n_tokens")
