"""Turning raw text fields into typed values; bad values become NULL, never errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character that counts as white space, carriage returns of Windows files included.
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def blank_to_null(col: Column) -> Column:
    """Strip surrounding white space; an empty rest is NULL."""
    return F.nullif(F.btrim(col, F.lit(_BLANKS)), F.lit(""))


def to_amount(col: Column) -> Column:
    return blank_to_null(col).try_cast("double")


def parse_timestamp(col: Column) -> Column:
    """Minute or second precision, zero padding optional, as a zone-free timestamp."""
    text = blank_to_null(col)
    minute = F.try_to_timestamp(text, F.lit("yyyy/M/d H:m"))
    second = F.try_to_timestamp(text, F.lit("yyyy/M/d H:m:s"))
    return F.coalesce(minute, second).cast("timestamp_ntz")


def strip_leading_zeros(col: Column) -> Column:
    return F.ltrim(col, F.lit("0"))


def shard_number(key: Column, shards: int) -> Column:
    """Stable shard 1..n of a text key, the same value in every run and language."""
    return (F.crc32(key) % F.lit(shards) + 1).cast("int")
