"""Variable-length integers in groups of seven bits, least first (our own choice: the original layout is not known)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups of seven bits in 64.
LONGEST = 10


def encoded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of unsigned integers, laid end to end, and where each ends."""
    places = np.arange(LONGEST, dtype=np.uint64) * np.uint64(7)
    groups = (numbers[:, None] >> places).astype(np.uint64)
    lengths = 1 + (groups[:, 1:] > 0).sum(axis=1)
    used = np.arange(LONGEST) < lengths[:, None]
    more = np.arange(LONGEST) < lengths[:, None] - 1
    return ((groups & np.uint64(0x7F)).astype(np.uint8) | (more * np.uint8(0x80)))[used], np.cumsum(lengths)


def decoded(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The unsigned integers whose bytes are data[first[i]:first[i + 1]]; bits beyond 64 are lost."""
    sizes = np.diff(first)
    place = np.arange(len(data)) - np.repeat(first[:-1], sizes)
    parts = np.where(place < LONGEST, (data & np.uint8(0x7F)).astype(np.uint64) << np.minimum(7 * place, 63).astype(np.uint64), np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
    return total[first[1:]] - total[first[:-1]]


@F.arrow_udf(T.BinaryType())
def encode_varint(n: pa.Array) -> pa.Array:
    """Bytes of integers taken as unsigned ones of 64 bits, so a negative takes ten; null stays null."""
    known = n.is_valid()
    data, ends = encoded(n.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    plain = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pc.if_else(known, plain, pa.scalar(None, pa.binary()))


@F.arrow_udf(T.LongType())
def decode_varint(data: pa.Array) -> pa.Array:
    """The integers that :func:`encode_varint` takes; no bytes give 0, null stays null."""
    flat = data.cast(pa.large_binary()).fill_null(b"")
    _, offsets, bytes_of = flat.buffers()
    first = np.frombuffer(offsets, dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    whole = np.frombuffer(bytes_of, dtype=np.uint8) if bytes_of is not None else np.zeros(0, np.uint8)
    numbers = decoded(whole[first[0] : first[-1]], first - first[0]).view(np.int64)
    return pc.if_else(data.is_valid(), pa.array(numbers), pa.scalar(None, pa.int64()))


def zigzag(n):
    """A signed column as an unsigned one: 0, -1, 1, -2 become 0, 1, 2, 3."""
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(n):
    return F.shiftrightunsigned(n, 1).bitwiseXOR(-(n.bitwiseAND(F.lit(1))))
