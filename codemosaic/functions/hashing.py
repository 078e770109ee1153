"""Content and symbol hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET, _PRIME = 14695981039346656037, 1099511628211
_LOW = 0xFFFFFFFF


def fnv1a64(data: bytes) -> str:
    """FNV-1a, 64 bits, as 16 hexadecimal digits."""
    h = _OFFSET
    for b in data:
        h = (h ^ b) * _PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fnv1a64_column(text: Column) -> Column:
    """fnv1a64 of a column's UTF-8 bytes, in expressions alone.

    The state is two halves of 32 bits, so no product leaves 64 bits: with PRIME = 2^40 + 435 and x the low half after
    the exclusive or, low' = 435 x mod 2^32 and high' = 435 high + carry + x * 2^8 mod 2^32.
    """
    hexed = F.hex(text.cast("binary"))
    step = F.transform(F.sequence(F.lit(0), (F.length(hexed) / 2 - 1).cast("int")), lambda i: F.conv(hexed.substr((i * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    data = F.when(F.length(hexed) == 0, F.array().cast("array<bigint>")).otherwise(step)
    start = F.struct(F.lit(_OFFSET >> 32).cast("long").alias("high"), F.lit(_OFFSET & _LOW).cast("long").alias("low"))

    def merge(state: Column, b: Column) -> Column:
        product = state["low"].bitwiseXOR(b) * 435
        high = state["high"] * 435 + F.shiftright(product, 32) + state["low"].bitwiseXOR(b) * 256
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("high"), product.bitwiseAND(F.lit(_LOW)).alias("low"))

    return F.aggregate(data, start, merge, lambda s: F.lower(F.concat(F.lpad(F.hex(s["high"]), 8, "0"), F.lpad(F.hex(s["low"]), 8, "0"))))


def content_hash(text: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(text.cast("binary"), 256)
