"""Integer codecs: of single numbers in Python, and of columns as JVM expressions.

Parquet encodes the engine's own tables; these are for exchange with other programs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.strings import varint_bytes, vlong_bytes


def encode_fixed(x: int, size: int, *, little: bool = False) -> bytes:
    """A number of 0 or more in ``size`` bytes."""
    return x.to_bytes(size, "little" if little else "big")


def decode_fixed(data: bytes, *, little: bool = False) -> int:
    return int.from_bytes(data, "little" if little else "big")


def encode_varint(x: int, *, big: bool = False) -> bytes:
    """Seven bits a byte, the high bit set on all but the last; the lowest seven bits first, or last with ``big``."""
    if x < 0:
        raise ValueError("a varint is 0 or more")
    groups = [x & 127]
    while x := x >> 7:
        groups.append(x & 127)
    groups = groups[::-1] if big else groups
    return bytes([g | 128 for g in groups[:-1]] + [groups[-1]])


def decode_varint(data: bytes, *, big: bool = False) -> int:
    groups = [b & 127 for b in data]
    return sum(g << 7 * i for i, g in enumerate(groups[::-1] if big else groups))


def encode_sized(x: int) -> bytes:
    """The number of further bytes in the top three bits of the first byte, the value in all others (below 2^61)."""
    if not 0 <= x < 1 << 61:
        raise ValueError("the value doesn't fit")
    more = 0 if x < 32 else -(-(x.bit_length() - 5) // 8)
    return (x | more << (5 + 8 * more)).to_bytes(1 + more, "big")


def decode_sized(data: bytes) -> int:
    return int.from_bytes(data, "big") & (1 << (5 + 8 * (len(data) - 1))) - 1


def encode_headed(x: int, header: int, size: int = 8) -> bytes:
    """A number in ``size`` bytes of which the first bit is a header of 0 or 1."""
    if not 0 <= x < 1 << (8 * size - 1):
        raise ValueError("the value doesn't fit")
    return (x | header << (8 * size - 1)).to_bytes(size, "big")


def decode_headed(data: bytes) -> tuple[int, int]:
    """(value, header)."""
    x = int.from_bytes(data, "big")
    return x & (1 << (8 * len(data) - 1)) - 1, x >> (8 * len(data) - 1)


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, by.cast("int"))


def _from_bytes(items: Column) -> Column:
    """A binary of an array of numbers from 0 to 255."""
    return F.unhex(F.array_join(F.transform(items, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def _to_bytes(data: Column) -> Column:
    """The bytes of a binary as an array of numbers."""
    digits, n = F.hex(data), F.octet_length(data)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).when(n == 0, F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))


def _natural(x: Column, value: Column, bits: int = 63) -> Column:
    """``value`` where x is from 0 to 2^bits - 1, else null."""
    ok = x >= 0 if bits >= 63 else (x >= 0) & (x < 1 << bits)
    return F.when(ok, value)


def varint_column(x: Column, *, big: bool = False) -> Column:
    """:func:`encode_varint` as an expression; null and negative numbers give null."""
    n = varint_bytes(x)
    place = (lambda i: n - 1 - i) if big else (lambda i: i)
    group = lambda i: _shift(x, place(i) * 7).bitwiseAND(F.lit(127)) + F.when(i < n - 1, 128).otherwise(0)
    return _natural(x, _from_bytes(F.transform(F.sequence(F.lit(0), n - 1), group)))


def varint_value(data: Column, *, big: bool = False) -> Column:
    """:func:`decode_varint` as an expression."""
    order = _to_bytes(data) if big else F.reverse(_to_bytes(data))
    return F.aggregate(order, F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 7).bitwiseOR(b.bitwiseAND(F.lit(127))))


def fixed_column(x: Column, size: int, *, little: bool = False) -> Column:
    """:func:`encode_fixed` as an expression; null, negative and too large numbers give null."""
    place = lambda i: i if little else F.lit(size - 1) - i
    digit = lambda i: F.when(place(i) < 8, _shift(x, place(i) * 8).bitwiseAND(F.lit(255))).otherwise(0)
    return _natural(x, _from_bytes(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), digit)), 8 * size)


def fixed_value(data: Column, *, little: bool = False) -> Column:
    """:func:`decode_fixed` as an expression, for up to eight bytes."""
    order = F.reverse(_to_bytes(data)) if little else _to_bytes(data)
    return F.aggregate(order, F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 8).bitwiseOR(b))


def sized_column(x: Column) -> Column:
    """:func:`encode_sized` as an expression; what doesn't fit gives null."""
    more = vlong_bytes(x) - 1
    digit = lambda i: _shift(x, (more - i) * 8).bitwiseAND(F.lit(255)) + F.when(i == 0, more * 32).otherwise(0)
    return _natural(x, _from_bytes(F.transform(F.sequence(F.lit(0), more), digit)), 61)


def sized_value(data: Column) -> Column:
    """:func:`decode_sized` as an expression."""
    first = lambda b, i: F.when(i == 0, b.bitwiseAND(F.lit(31))).otherwise(b)
    return F.aggregate(F.transform(_to_bytes(data), first), F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 8).bitwiseOR(b))


def headed_column(x: Column, header: Column, size: int = 8) -> Column:
    """:func:`encode_headed` as an expression; what doesn't fit gives null."""
    top = lambda b, i: b + F.when(i == 0, header * 128).otherwise(0)
    return _natural(x, _from_bytes(F.transform(_to_bytes(fixed_column(x, size)), top)), 8 * size - 1)


def headed_value(data: Column) -> tuple[Column, Column]:
    """:func:`decode_headed` as expressions: (value, header)."""
    first = lambda b, i: F.when(i == 0, b.bitwiseAND(F.lit(127))).otherwise(b)
    value = F.aggregate(F.transform(_to_bytes(data), first), F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 8).bitwiseOR(b))
    return value, (F.get(_to_bytes(data), F.lit(0)) >= 128).cast("int")
