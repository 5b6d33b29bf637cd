"""MurmurHash3 (public domain algorithm), 32 and 128 bits, over the UTF-8 bytes of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_M64 = (1 << 64) - 1
_M32 = (1 << 32) - 1
# The constants of the algorithm.
_C64 = (0x87C37B91114253D5, 0x4CF5AD432745937F)
_C32 = (0xCC9E2D51, 0x1B873593)


def _rotate(x: int, r: int, bits: int) -> int:
    return (x << r | x >> (bits - r)) & (1 << bits) - 1


def _mix(x: int, shifts: tuple[int, ...], factors: tuple[int, ...], mask: int) -> int:
    """Alternating shifts and products, so that every bit reaches every other."""
    for i, s in enumerate(shifts):
        x ^= x >> s
        if i < len(factors):
            x = x * factors[i] & mask
    return x


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    """The x64 variant: two numbers of 64 bits."""
    halves = [seed, seed]
    step = ((31, 27, 0x52DCE729), (33, 31, 0x38495AB5))
    whole = len(data) // 16 * 16

    def lane(k: int, i: int) -> int:
        first, second = _C64 if i == 0 else _C64[::-1]
        return _rotate(k * first & _M64, step[i][0], 64) * second & _M64

    for at in range(0, whole, 16):
        for i in (0, 1):
            halves[i] ^= lane(int.from_bytes(data[at + 8 * i : at + 8 * i + 8], "little"), i)
            halves[i] = (_rotate(halves[i], step[i][1], 64) + halves[1 - i]) & _M64
            halves[i] = (halves[i] * 5 + step[i][2]) & _M64
    rest = data[whole:]
    for i in (0, 1):
        if rest[8 * i : 8 * i + 8]:
            halves[i] ^= lane(int.from_bytes(rest[8 * i : 8 * i + 8], "little"), i)
    halves = [h ^ len(data) for h in halves]

    def cross() -> None:
        halves[0] = (halves[0] + halves[1]) & _M64
        halves[1] = (halves[1] + halves[0]) & _M64

    cross()
    halves[:] = [_mix(h, (33, 33, 33), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53), _M64) for h in halves]
    cross()
    return halves[0], halves[1]


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The x86 variant of 32 bits."""
    h = seed
    for at in range(0, len(data), 4):
        k = int.from_bytes(data[at : at + 4], "little") * _C32[0] & _M32
        h ^= _rotate(k, 15, 32) * _C32[1] & _M32
        if at + 4 <= len(data):
            h = (_rotate(h, 13, 32) * 5 + 0xE6546B64) & _M32
    return _mix(h ^ len(data), (16, 13, 16), (0x85EBCA6B, 0xC2B2AE35), _M32)


def murmur3_56(data: bytes) -> int:
    """56 bits: bytes 0 to 3 and 8 to 10 of the 128-bit hash as signed numbers, added up from the lowest, modulo 2^56."""
    first, second = (h.to_bytes(8, "little") for h in murmur3_128(data))
    picked = first[:4] + second[:3]
    return sum((b - 256 if b > 127 else b) << 8 * i for i, b in enumerate(picked)) & (1 << 56) - 1


#: Texts of more bytes are hashed one by one: few are so long, and a step over all texts would do little.
LONG = 1024


def _words(data: np.ndarray, at: np.ndarray, left: np.ndarray, size: int, kind: type) -> np.ndarray:
    """The next ``size`` bytes of each text from ``at`` as numbers in columns; bytes beyond the ``left`` ones are 0."""
    k = np.arange(size)
    on = k < left[:, None]
    got = np.where(on, data[np.where(on, at[:, None] + k, 0)], 0).astype(np.uint8)
    return got.view(kind)


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and how long it is; nulls are empty."""
    plain = values.cast(pa.large_binary()).fill_null(b"")
    data = np.frombuffer(plain.buffers()[2] or b"\0", np.uint8)
    offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    return (data if len(data) else np.zeros(1, np.uint8)), offsets[:-1], np.diff(offsets)


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    bits = x.dtype.itemsize * 8
    return (x << x.dtype.type(r)) | (x >> x.dtype.type(bits - r))


def murmur3_128_all(values: pa.Array, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """:func:`murmur3_128` of many texts at once."""
    data, start, size = _bytes_of(values)
    halves = [np.full(len(size), seed, np.uint64) for _ in (0, 1)]
    step = ((31, 27, 0x52DCE729), (33, 31, 0x38495AB5))
    lane = lambda k, i: _rot(k * np.uint64(_C64[i]), step[i][0]) * np.uint64(_C64[1 - i])
    short = size <= LONG
    for i in range(int(size[short].max(initial=0)) // 16):
        on = np.flatnonzero(short & (size >= 16 * (i + 1)))
        k = _words(data, start[on] + 16 * i, np.full(len(on), 16), 16, np.uint64)
        h = [x[on] for x in halves]
        for j in (0, 1):
            h[j] = (_rot(h[j] ^ lane(k[:, j], j), step[j][1]) + h[1 - j]) * np.uint64(5) + np.uint64(step[j][2])
        for x, new in zip(halves, h):
            x[on] = new
    rest = _words(data, start + size // 16 * 16, size % 16, 16, np.uint64)
    halves = [x ^ lane(rest[:, i], i) ^ size.astype(np.uint64) for i, x in enumerate(halves)]
    halves[0] = halves[0] + halves[1]
    halves[1] = halves[1] + halves[0]
    for i, x in enumerate(halves):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(c)
        halves[i] = x ^ (x >> np.uint64(33))
    halves[0] = halves[0] + halves[1]
    halves[1] = halves[1] + halves[0]
    for i in np.flatnonzero(~short).tolist():
        halves[0][i], halves[1][i] = murmur3_128(data[start[i] : start[i] + size[i]].tobytes(), seed)
    return halves[0], halves[1]


def murmur3_32_all(values: pa.Array, seed: int = 0) -> np.ndarray:
    """:func:`murmur3_32` of many texts at once."""
    data, start, size = _bytes_of(values)
    h = np.full(len(size), seed, np.uint32)
    mix = lambda k: _rot(k * np.uint32(_C32[0]), 15) * np.uint32(_C32[1])
    short = size <= LONG
    for i in range(int(size[short].max(initial=0)) // 4):
        on = np.flatnonzero(short & (size >= 4 * (i + 1)))
        k = _words(data, start[on] + 4 * i, np.full(len(on), 4), 4, np.uint32)[:, 0]
        h[on] = _rot(h[on] ^ mix(k), 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= mix(_words(data, start + size // 4 * 4, size % 4, 4, np.uint32)[:, 0]) ^ size.astype(np.uint32)
    for s, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(s))) * np.uint32(c)
    h ^= h >> np.uint32(16)
    for i in np.flatnonzero(~short).tolist():
        h[i] = murmur3_32(data[start[i] : start[i] + size[i]].tobytes(), seed)
    return h


def murmur3_56_all(values: pa.Array) -> np.ndarray:
    """:func:`murmur3_56` of many texts at once."""
    picked = np.stack(murmur3_128_all(values), 1).view(np.int8).reshape(-1, 16)[:, [0, 1, 2, 3, 8, 9, 10]]
    return (picked.astype(np.int64) << (8 * np.arange(7))).sum(axis=1) & ((1 << 56) - 1)


def _nulled(numbers: np.ndarray, values: pa.Array) -> pa.Array:
    return pc.if_else(values.is_valid(), pa.array(numbers), None)


def murmur3_56_column(term: Column) -> Column:
    """:func:`murmur3_56` of a text, by Arrow batches; null gives null."""
    return F.arrow_udf(lambda x: _nulled(murmur3_56_all(x), x), "long")(term)


def murmur3_32_column(term: Column) -> Column:
    """:func:`murmur3_32` of a text as a signed number."""
    return F.arrow_udf(lambda x: _nulled(murmur3_32_all(x).view(np.int32), x), "int")(term)


def murmur3_128_column(term: Column) -> Column:
    """:func:`murmur3_128` of a text, as (low, high) of signed numbers."""

    def run(x: pa.Array) -> pa.Array:
        low, high = (pa.array(h.view(np.int64)) for h in murmur3_128_all(x))
        return pa.StructArray.from_arrays([low, high], ["low", "high"], mask=x.is_null())

    return F.arrow_udf(run, "low long, high long")(term)
