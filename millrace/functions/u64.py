"""Unsigned 64-bit arithmetic on BIGINT bit patterns, as native expressions that hold under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
GOLDEN_GAMMA = 0x9E3779B97F4A7C15
MIX_ONE, MIX_TWO = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SPLIT_SALT = 0x94D049BB133111EB
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
_LOW22, _LOW20, _LOW44 = (1 << 22) - 1, (1 << 20) - 1, (1 << 44) - 1


def lit(x: int) -> Column:
    """An unsigned constant as the BIGINT of its bits."""
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _ushift(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def multiply(x: Column, y: int) -> Column:
    """x * y modulo 2^64, in limbs of 22, 22 and 20 bits whose products fit a BIGINT."""
    a0, a1, a2 = x.bitwiseAND(lit(_LOW22)), _ushift(x, 22).bitwiseAND(lit(_LOW22)), _ushift(x, 44)
    b0, b1, b2 = y & _LOW22, y >> 22 & _LOW22, y >> 44
    r1 = a0 * lit(b1) + a1 * lit(b0)
    low = a0 * lit(b0) + F.shiftleft(r1.bitwiseAND(lit(_LOW22)), 22)
    high = _ushift(low, 44) + _ushift(r1, 22) + a0 * lit(b2) + a1 * lit(b1) + a2 * lit(b0)
    return F.shiftleft(high.bitwiseAND(lit(_LOW20)), 44).bitwiseOR(low.bitwiseAND(lit(_LOW44)))


def add(x: Column, y: int) -> Column:
    """x + y modulo 2^64."""
    low = x.bitwiseAND(lit(0xFFFFFFFF)) + lit(y & 0xFFFFFFFF)
    high = _ushift(x, 32) + lit(y >> 32) + _ushift(low, 32)
    return F.shiftleft(high.bitwiseAND(lit(0xFFFFFFFF)), 32).bitwiseOR(low.bitwiseAND(lit(0xFFFFFFFF)))


def with_mix64(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the finalizer of SplitMix64 (without its increment) of a column.

    Each product is a column of its own: nested, its limbs would be written out many times over.
    """
    x = F.col(source)
    df = df.withColumn("__m1", x.bitwiseXOR(_ushift(x, 30)))
    df = df.withColumn("__m2", multiply(F.col("__m1"), MIX_ONE))
    df = df.withColumn("__m3", F.col("__m2").bitwiseXOR(_ushift(F.col("__m2"), 27)))
    df = df.withColumn("__m4", multiply(F.col("__m3"), MIX_TWO))
    return df.withColumn(target, F.col("__m4").bitwiseXOR(_ushift(F.col("__m4"), 31))).drop("__m1", "__m2", "__m3", "__m4")


def with_splitmix64(df: DataFrame, state: str, target: str) -> DataFrame:
    """Add the next number of a SplitMix64 generator in the state of a column."""
    return with_mix64(df.withColumn("__state", add(F.col(state), GOLDEN_GAMMA)), "__state", target).drop("__state")


def modulo(x: Column, n: int) -> Column:
    """Unsigned remainder: both halves' remainders, put together."""
    half = (1 << 32) % n
    return F.pmod(F.pmod(_ushift(x, 32), F.lit(n)) * half + F.pmod(x.bitwiseAND(lit(0xFFFFFFFF)), F.lit(n)), F.lit(n))


def order_key(x: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of x."""
    return x.bitwiseXOR(lit(1 << 63))


def fnv1a(data: Column) -> Column:
    """FNV-1a of a binary column, a byte at a time."""
    bits = F.hex(data)
    codes = F.transform(F.sequence(F.lit(1), F.greatest(F.length(bits) / 2, F.lit(1)).cast("int")), lambda k: F.conv(F.substring(bits, (2 * k - 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    folded = F.aggregate(codes, lit(FNV_OFFSET), lambda h, b: multiply(h.bitwiseXOR(b), FNV_PRIME))
    return F.when(F.octet_length(data) == 0, lit(FNV_OFFSET)).otherwise(folded)
