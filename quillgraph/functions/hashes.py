"""Hash functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_56(term: Column) -> Column:
    """A 56-bit id of a text, the same in every engine that has md5: its first 14 hex digits. Null gives null."""
    return F.conv(F.substring(F.md5(term), 1, 14), 16, 10).cast("long")


def _signed_bytes(term: Column) -> Column:
    """The UTF-8 bytes as numbers from -128 to 127."""
    digits = F.hex(F.encode(term, "UTF-8"))
    at = F.sequence(F.lit(0), F.octet_length(term) - 1)
    byte = lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long")
    return F.when(F.octet_length(term) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(at, lambda i: F.when(byte(i) > 127, byte(i) - 256).otherwise(byte(i)))
    )


def polynomial_hash(term: Column, *, seed: int = 5381, factor: int = 33, modulus: int = 1 << 56) -> Column:
    """``h = h * factor + byte`` over the signed bytes, modulo ``modulus`` (below 2^57, so that nothing overflows).

    With the defaults this is the 56-bit variant of the classic times-33 string hash.
    """
    return F.aggregate(_signed_bytes(term), F.lit(seed).cast("long"), lambda h, b: F.pmod(h * factor + b, F.lit(modulus)))


def fnv1a_56(term: Column) -> Column:
    """FNV-1a over signed bytes, start 0, prime 16777619, modulo 2^56.

    The product is formed from halves of 28 bits, as the whole would not fit into a LONG.
    """
    low = (1 << 28) - 1

    def step(h: Column, b: Column) -> Column:
        x = h.bitwiseXOR(b).bitwiseAND(F.lit((1 << 56) - 1))
        lo = x.bitwiseAND(F.lit(low)) * 16777619
        hi = (F.shiftright(x, 28) * 16777619).bitwiseAND(F.lit(low))
        return (lo + F.shiftleft(hi, 28)).bitwiseAND(F.lit((1 << 56) - 1))

    return F.aggregate(_signed_bytes(term), F.lit(0).cast("long"), step)


def _signed_32(x: Column) -> Column:
    """The lowest 32 bits of a LONG as a signed number."""
    low = x.bitwiseAND(F.lit((1 << 32) - 1))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def fnv1a_32(term: Column) -> Column:
    """FNV-1a over signed bytes, start 0, prime 16777619, in 32 bits."""
    low = F.lit((1 << 32) - 1)
    step = lambda h, b: (h.bitwiseXOR(b).bitwiseAND(low) * 16777619).bitwiseAND(low)
    return _signed_32(F.aggregate(_signed_bytes(term), F.lit(0).cast("long"), step))


def times33_32(term: Column) -> Column:
    """The times-33 hash (see :func:`polynomial_hash`) in 32 bits."""
    return _signed_32(polynomial_hash(term, modulus=1 << 32))


def hash_array(values: Column) -> Column:
    """One 64-bit number of an array of LONGs, dependent on their order: ``h ^= v + 0x9e3779b9 + (h << 6) + (h >> 2)`` from 0, without sign.

    The sum is formed from halves of 32 bits, as the whole would not fit into a LONG. A null array or element gives null.
    """
    low = F.lit((1 << 32) - 1)
    high = lambda x: F.shiftrightunsigned(x, 32)

    def step(h: Column, v: Column) -> Column:
        parts = (v, F.shiftleft(h, 6), F.shiftrightunsigned(h, 2))
        lo = sum((x.bitwiseAND(low) for x in parts), F.lit(0x9E3779B9).cast("long"))
        hi = sum((high(x) for x in parts), high(lo))
        return h.bitwiseXOR(F.shiftleft(hi.bitwiseAND(low), 32).bitwiseOR(lo.bitwiseAND(low)))

    return F.aggregate(values, F.lit(0).cast("long"), step)


def bucket(term: Column, n: int) -> Column:
    """Hash partition 0..n-1 of a text, reproducible in SQL."""
    return F.pmod(md5_56(term), F.lit(n)).cast("int")
