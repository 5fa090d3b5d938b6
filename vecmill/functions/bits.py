"""Bit hashes as longs: function 0 is the most significant of ``bits`` bits, so that equal prefixes sort together."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pack(flags: Column, bits: int = 32) -> Column:
    """A hash from an array of booleans."""
    return F.aggregate(flags, F.lit(0).cast("long"), lambda h, b: h * 2 + b.cast("long")) * F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(bits) - F.size(flags))


def bit_string(h: Column, bits: int = 32) -> Column:
    return F.lpad(F.bin(h), bits, "0")


def prefix_key(h: Column, prefix: Column | int, bits: int = 32) -> Column:
    """What two hashes share if and only if their first ``prefix`` bits are equal; also orders by prefix."""
    return F.call_function("shiftrightunsigned", h, (F.lit(bits) - prefix).cast("int") if isinstance(prefix, Column) else F.lit(bits - prefix))


def prefix_eq(a: Column, b: Column, prefix: Column | int, bits: int = 32) -> Column:
    return prefix_key(a, prefix, bits) == prefix_key(b, prefix, bits)


def lcp(a: Column, b: Column, bits: int = 32) -> Column:
    """Leading bits that two hashes share."""
    x = a.bitwiseXOR(b)
    return F.when(x == 0, F.lit(bits)).otherwise(F.lit(bits) - F.length(F.bin(x)))
