"""Checksums: XXH64 with any seed, CRC-32C, and verification. CRC-16 is left out: its polynomial is not known."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the reversed Castagnoli polynomial.
CASTAGNOLI = 0x82F63B78


def xxh64(data: Column, seed: int = 42) -> Column:
    """XXH64 of bytes as a signed integer; null has the seed as Spark has it for 42, else null. Spark's own function has
    the seed 42; others go through Arrow batches."""
    if seed == 42:
        return F.xxhash64(data)
    return _xxh64_pieces(F.when(data.isNotNull(), F.array(data.cast("binary"))), F.lit(seed).cast("long"))


def xxh64_of_pieces(pieces: Column, seed: int = 0) -> Column:
    """XXH64 of an array of byte strings fed one after the other, which is that of their concatenation; null pieces add
    nothing, a null array stays null."""
    return _xxh64_pieces(pieces.cast("array<binary>"), F.lit(seed).cast("long"))


@F.arrow_udf(T.LongType())
def _xxh64_pieces(pieces: pa.Array, seed: pa.Array) -> pa.Array:
    import xxhash

    out = np.zeros(len(pieces), np.uint64)
    for i, (row, start) in enumerate(zip(pieces, seed.to_numpy(), strict=True)):
        state = xxhash.xxh64(seed=int(start) % (1 << 64))
        for piece in row.values or ():
            if piece.is_valid:
                state.update(piece.as_buffer())
        out[i] = state.intdigest()
    return pc.if_else(pieces.is_valid(), pa.array(out.view(np.int64)), pa.scalar(None, pa.int64()))


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> np.uint32(1)) ^ np.uint32(CASTAGNOLI), crc >> np.uint32(1)).astype(np.uint32)
    return crc


def crc32c_of(values: list[bytes]) -> np.ndarray:
    """CRC-32C of many byte strings, advanced together one byte at a time, the longest first."""
    table, lengths = _table(), np.array([len(v) for v in values], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    data = np.frombuffer(b"".join(values[i] for i in order), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(lengths[order])])[:-1]
    crc = np.full(len(values), 0xFFFFFFFF, dtype=np.uint32)
    live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    for k, n in enumerate(live):
        part = crc[:n]
        crc[:n] = table[(part ^ data[starts[:n] + k]) & np.uint32(0xFF)] ^ (part >> np.uint32(8))
    out = np.empty(len(values), np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    """CRC-32C of a binary column; null stays null."""
    known = data.notna()
    out = pd.Series(pd.array([None] * len(data), dtype="Int64"), index=data.index)
    out[known] = crc32c_of([bytes(x) for x in data[known]])
    return out


def mismatches(rows: DataFrame, key: str, stored: Column, actual: Column) -> DataFrame:
    """(key, old, new) of rows whose stored checksum isn't the actual one."""
    return rows.select(key, stored.alias("old"), actual.alias("new")).filter(~F.col("old").eqNullSafe(F.col("new")))


def verified(value: Column, stored: Column, actual: Column, message: str) -> Column:
    """``value``, or an error that names both checksums."""
    said = F.format_string("%s: Old = 0x%16X , New = 0x%16X", F.lit(message), stored.cast("long"), actual.cast("long"))
    return F.when(stored == actual, value).otherwise(F.raise_error(said).cast("string"))
