"""Column functions over BINARY: integers of either byte order, four-character codes, and their encoders.

Positions are 1-based, as in substring. Spark has no unsigned types: up to four bytes decode to BIGINT, eight to
DECIMAL(20,0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = "decimal(20,0)"


def _at(data: Column, pos: Column | int, n: int) -> Column:
    return F.substring(data, pos if isinstance(pos, Column) else F.lit(pos), F.lit(n))


def be_uint(data: Column, pos: Column | int, n: int) -> Column:
    """Big-endian unsigned integer of n <= 7 bytes, BIGINT."""
    return F.conv(F.hex(_at(data, pos, n)), 16, 10).cast("bigint")


def be_u64(data: Column, pos: Column | int) -> Column:
    """Big-endian unsigned 64-bit integer, DECIMAL(20,0)."""
    return F.conv(F.hex(_at(data, pos, 8)), 16, 10).cast(U64)


def le_uint(data: Column, pos: Column | int, n: int) -> Column:
    """Little-endian unsigned integer of n <= 7 bytes, BIGINT."""
    at = pos if isinstance(pos, Column) else F.lit(pos)
    return F.conv(F.concat(*[F.hex(_at(data, at + F.lit(k), 1)) for k in reversed(range(n))]), 16, 10).cast("bigint")


def le_u64(data: Column, pos: Column | int) -> Column:
    """Little-endian unsigned 64-bit integer, DECIMAL(20,0)."""
    at = pos if isinstance(pos, Column) else F.lit(pos)
    return F.conv(F.concat(*[F.hex(_at(data, at + F.lit(k), 1)) for k in reversed(range(8))]), 16, 10).cast(U64)


def fourcc(data: Column, pos: Column | int) -> Column:
    """Four bytes as text, one character a byte."""
    return F.decode(_at(data, pos, 4), "ISO-8859-1")


def be32(value: Column) -> Column:
    """Four bytes, big-endian."""
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 8, "0"))


def le_hex(value: Column, n: int) -> Column:
    """Hex digits of n little-endian bytes."""
    full = F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")
    return F.concat(*[F.substring(full, 2 * k + 1, 2) for k in reversed(range(n))])


def text(value: str) -> Column:
    """A literal four-character code as BINARY."""
    return F.encode(F.lit(value), "ISO-8859-1")


def repeated(byte: int, n: Column) -> Column:
    """n times a byte, as BINARY."""
    return F.lpad(F.lit(b""), n.cast("int"), F.lit(bytes([byte])))
