"""Column helpers for literals, bytes and big-endian numbers; all stay in the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked(query: str | bytes) -> str | bytes:
    if not query:
        raise ValueError("an empty query")
    return query


def quoted(literal: str) -> str:
    """A regular expression for exactly this text."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def byte_view(col: Column) -> Column:
    """Bytes as a string of as many characters, so that string functions count bytes."""
    return F.decode(col.cast("binary"), "ISO-8859-1")


def byte_text(query: str | bytes) -> str:
    return (query if isinstance(query, bytes) else query.encode("utf-8")).decode("latin-1")


def occurrences(col: Column, query: str | bytes, binary: bool = False) -> Column:
    """How often a literal occurs in a value, overlaps included; 0 in a null."""
    text = byte_view(col) if binary else col
    literal = byte_text(checked(query)) if binary else checked(query)
    ahead = f"(?={quoted(literal)})"
    return F.coalesce(F.regexp_count(text, F.lit(ahead)), F.lit(0)).cast("long")


def has(col: Column, query: str | bytes) -> Column:
    """Whether a string or binary value contains a literal; false in a null."""
    literal = F.lit(checked(query)) if isinstance(query, str) else F.lit(bytes(query))
    return F.coalesce(F.contains(col, literal), F.lit(False))


def until(col: Column, offset: int, delimiter: str) -> Column:
    """From an offset to the next delimiter, or to the end."""
    return F.substring_index(F.substring(col, offset + 1, 2**31 - 1), checked(delimiter), 1)


def big_endian(col: Column, offset: int, size: int) -> Column:
    """The signed number of 2, 4 or 8 bytes at an offset; null where the value ends before."""
    part = F.substring(col, offset + 1, size)
    kind = {2: "short", 4: "int", 8: "long"}[size]
    number = F.conv(F.hex(part), 16, 10).cast("decimal(20,0)")
    signed = F.when(number >= F.lit(Decimal(2 ** (8 * size - 1))), number - F.lit(Decimal(2 ** (8 * size)))).otherwise(number)
    return F.when(F.octet_length(part) == size, signed.cast(kind))


def first_non_ascii(col: Column) -> Column:
    """Offset in bytes of the first byte beyond ASCII, -1 without one."""
    return F.regexp_instr(byte_view(col), F.lit("[^\\x00-\\x7F]")) - 1


def padded(col: Column, width: int) -> Column:
    """A whole number as text with leading zeros, the sign first."""
    digits = F.abs(col.cast("decimal(38,0)")).cast("string")
    sign = F.when(col < 0, "-").otherwise("")
    return F.concat(sign, F.lpad(digits, F.greatest(F.length(digits), F.lit(width) - F.length(sign)), F.lit("0")))


def resumable(col: Column, offset: Column | int, length: int) -> Column:
    """Part of a value and the offset at which to go on, as a struct (content, next)."""
    start = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substring(col, start + 1, F.lit(length))
    return F.struct(part.alias("content"), (start + F.length(part)).cast("long").alias("next"))


def typed(col: Column, kind: str) -> Column:
    """Text as a typed value, null where it isn't one; booleans also as 1 and 0."""
    return F.when(col == "1", True).when(col == "0", False).otherwise(col.try_cast(kind)) if kind == "boolean" else col.try_cast(kind)
