"""Byte and string functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def little_endian(n: Column) -> Column:
    """Four bytes of an integer, least first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, at, 2) for at in (7, 5, 3, 1)]))


def big_endian(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def split_pair(line: Column) -> tuple[Column, Column]:
    """Key and value at the first tab; without one the value is empty. Later tabs stay in the value."""
    at = F.instr(line, "\t")
    return F.when(at == 0, line).otherwise(F.substring(line, F.lit(1), at - 1)), F.when(at == 0, F.lit("")).otherwise(F.substring(line, at + 1, F.length(line)))


def packed_pair(key: Column, value: Column, order=little_endian) -> Column:
    """Key length, value length, key, value as bytes."""
    return F.concat(order(F.octet_length(key)), order(F.octet_length(value)), key.cast("binary"), value.cast("binary"))


def decoded_hex(h: Column, strict: bool = True) -> Column:
    """Bytes of hexadecimal digits; an odd last digit is dropped. A bad digit is an error, or null if not strict."""
    even = F.substring(h, F.lit(1), (F.length(h) - F.length(h) % 2).cast("int"))
    if not strict:
        return F.unhex(even)
    return F.when(h.rlike("^[0-9A-Fa-f]*$"), F.unhex(even)).otherwise(F.unhex(F.raise_error(F.concat(F.lit("not hexadecimal: "), h)).cast("string")))


def framed(data: Column) -> Column:
    """Bytes after their length plus four, as a document frame has it."""
    return F.concat(little_endian(F.octet_length(data) + 4), data)


def reversed_bytes(text: Column) -> Column:
    """The bytes of a text in reverse, up to its first NUL."""
    cut = F.substring_index(F.decode(text.cast("binary"), "ISO-8859-1"), "\u0000", 1)
    return F.encode(F.reverse(cut), "ISO-8859-1")


def chomped(line: Column) -> Column:
    """A line without the line ends that close it."""
    return F.regexp_replace(line, r"[\r\n]+$", "")


def joined(*parts: Column) -> Column:
    return F.concat(*parts)


def translated(text: Column, source: str, target: str) -> Column:
    return F.translate(text, source, target)


def translated_bytes(data: Column, table: bytes) -> Column:
    """Each byte of ``data`` as the entry of a table of 256 for it."""
    if len(table) != 256:
        raise ValueError("a table of bytes has 256 entries")
    pairs = [(bytes([i]).decode("latin-1"), table[i : i + 1].decode("latin-1")) for i in range(256) if i != table[i]]
    latin = F.decode(data.cast("binary"), "ISO-8859-1")
    # a NUL as a target would delete, so it is set in afterwards
    told = F.translate(latin, "".join(a for a, _ in pairs), "".join(b for _, b in pairs).replace("\0", "\u0100"))
    return F.encode(F.replace(told, F.lit("\u0100"), F.lit("\0")), "ISO-8859-1")


def aligned(n: Column, to: int = 64) -> Column:
    """n rounded up to a multiple of ``to``, a power of two; exact over all long integers whose result is one."""
    if to < 1 or to & (to - 1):
        raise ValueError("an alignment is a power of two")
    return (n.cast("long") + F.lit(to - 1)).bitwiseAND(F.lit(-to).cast("long"))
