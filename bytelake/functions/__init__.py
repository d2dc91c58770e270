"""Column expressions on binary content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def byte_at(content: Column | str, offset: int | Column) -> Column:
    """Value of the byte at an offset from 0; null beyond the end."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    one = F.substring(col(content), at.cast("int") + 1, F.lit(1))
    return F.when(F.octet_length(one) == 1, F.conv(F.hex(one), 16, 10).cast("int"))


def word_at(content: Column | str, offset: int | Column) -> Column:
    """Little-endian 16-bit word at an offset; null where it doesn't fit."""
    second = offset + 1
    return byte_at(content, offset) + 256 * byte_at(content, second)


def has_bytes(content: Column | str, data: bytes, offset: int = 0) -> Column:
    """Whether content holds the bytes at the offset; false where they don't fit."""
    return F.coalesce(F.substring(col(content), offset + 1, len(data)) == F.lit(bytearray(data)), F.lit(False))


def latin(content: Column | str) -> Column:
    """One character for each byte, so that regular expressions search bytes."""
    return F.decode(col(content), "ISO-8859-1")


def gram_key(packed: Column | str, n: int) -> Column:
    """Key such as 01_0a_ff of an n-gram packed big-endian into a long."""
    return F.regexp_replace(F.lower(F.lpad(F.hex(col(packed)), 2 * n, "0")), "(..)(?!$)", "$1_")


def base64_encode(content: Column | str) -> Column:
    return F.base64(col(content))


def base64_decode(text: Column | str) -> Column:
    """Bytes of base64 text; padding and foreign characters are dropped first, bits that make no whole byte last."""
    clean = F.regexp_replace(col(text), "[^A-Za-z0-9+/]", "")
    whole = F.length(clean) - F.when(F.length(clean) % 4 == 1, 1).otherwise(0)
    clean = F.substring(clean, F.lit(1), whole)
    return F.unbase64(F.rpad(clean, ((F.length(clean) + 3) / 4).cast("int") * 4, F.lit("=")))


def hex_bytes(content: Column | str) -> Column:
    """Two-digit lower-case hex of each byte, separated by spaces."""
    return F.regexp_replace(F.lower(F.hex(col(content))), "(..)(?!$)", "$1 ")
