"""The most frequent items among billions: hierarchical count-sketch, descended by heavy prefixes, verified by a second scan.

A term is its 64-bit hash. For each prefix length there is one count-sketch: ROWS rows of ``width`` counters, to one of
which a row's hash maps each prefix, adding +1 or -1. The median over the rows of the signed counter estimates how
many rows have that prefix; its error is about sqrt(F2 of the other prefixes / width). Prefixes of which there are no more
than counters have one each, without any error. Memory is the same for any input. Prefixes whose estimate reaches half of
what is sought are extended by STEP bits; what is left at the last level are the candidates, which the second scan counts exactly.

Before the descent the error is estimated from the counters themselves. If what is sought doesn't exceed it clearly, the
sketch is made again, wider, and if even the widest is too coarse, terms are counted exactly by a shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits by which a prefix grows from level to level, and the number of levels (their product is the last prefix).
STEP = 8
LEVELS = 5
ROWS = 5
#: Counters of a row at first, and at most (LEVELS * ROWS of them of 8 bytes: 3 MB and 52 MB).
WIDTH = 1 << 14
MAX_WIDTH = 1 << 18
#: Part of the sought number of rows at which a prefix is still followed.
SLACK = 0.5
#: The number followed is at least so many times the error. A row of a sketch is off by more with a probability of 1/CLEAR^2 at
#: most, and three of five rows, which make a miss, with one of 10/CLEAR^6 (1/410; about 1e-12 if the errors are normal).
CLEAR = 4
#: Part of a row's counters taken to be those of heavy prefixes; meeting one of them by chance counts apart from the error.
HEAVY_PART = 64

# Odd multipliers, two for each row of a sketch (the first places, the second signs).
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165],
    np.uint64,
)


def _places(prefix: np.ndarray, level: int, row: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counter and sign of prefixes in a row of a level's sketch; a counter for each if there are no more prefixes than counters."""
    if 1 << (STEP * (level + 1)) <= width:
        return prefix.astype(np.int64), np.ones(len(prefix), np.int64)
    x = (prefix + np.uint64(level + 1)) * _MULTIPLIERS[2 * row]
    x ^= x >> np.uint64(29)
    x *= _MULTIPLIERS[2 * row + 1]
    x ^= x >> np.uint64(32)
    return (x & np.uint64(width - 1)).astype(np.int64), np.where((x >> np.uint64(40)) & np.uint64(1), 1, -1)


def _cells(batches, width: int):
    """The counters of all sketches over a part of the rows, as (cell, value) where they aren't 0; cell -1 counts rows."""
    sketch = np.zeros((LEVELS, ROWS, width), np.int64)
    rows = 0
    held, n = [], 0

    def add(parts: list[np.ndarray]) -> None:
        hashes, times = np.unique(np.concatenate(parts), return_counts=True)
        for level in range(LEVELS):
            prefix = hashes >> np.uint64(64 - STEP * (level + 1))
            for row in range(ROWS):
                at, sign = _places(prefix, level, row, width)
                sketch[level, row] += np.bincount(at, weights=sign * times, minlength=width).astype(np.int64)

    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        n += b.num_rows
        rows += b.num_rows
        if n >= 500_000:
            add(held)
            held, n = [], 0
    if n:
        add(held)
    flat = sketch.ravel()
    on = np.flatnonzero(flat)
    cell, value = np.r_[-1, on], np.r_[rows, flat[on]]
    for a in range(0, len(cell), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(cell[a : a + 65_536], pa.int32()), pa.array(value[a : a + 65_536], pa.int64())], names=["cell", "value"])


def sketch(df: DataFrame, term: Column, width: int = WIDTH) -> DataFrame:
    """(cell, value): the counters over all rows; sketches of several inputs of the same width are merged by adding up the cells."""
    hashes = df.where(term.isNotNull()).select(F.xxhash64(term).alias("h"))
    return hashes.mapInArrow(lambda b: _cells(b, width), "cell int, value long").groupBy("cell").agg(F.sum("value").alias("value"))


def collect_sketch(cells: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, int]:
    """The counters (LEVELS * ROWS * width of them, whatever the input) and the number of rows, on the driver."""
    t = cells.toArrow()
    cell, value = t.column("cell").to_numpy(), t.column("value").to_numpy()
    flat = np.zeros(LEVELS * ROWS * width, np.int64)
    flat[cell[cell >= 0]] = value[cell >= 0]
    return flat.reshape(LEVELS, ROWS, width), int(value[cell < 0].sum())


def estimate(counters: np.ndarray, level: int, prefix: np.ndarray) -> np.ndarray:
    per_row = []
    for row in range(ROWS):
        at, sign = _places(prefix, level, row, counters.shape[2])
        per_row.append(counters[level, row, at] * sign)
    return np.median(per_row, axis=0)


def light_f2(counters: np.ndarray) -> float:
    """Sum of the squared frequencies of all but the heaviest prefixes, at the level where it is largest.

    A row's squared counters add up to F2; the largest 1/HEAVY_PART of them are left out, as few prefixes meet one of these:
    three of five rows do with a probability of 10/HEAVY_PART^3 (1/26000).
    """
    width = counters.shape[2]
    keep = width - width // HEAVY_PART
    hashed = [level for level in range(LEVELS) if 1 << (STEP * (level + 1)) > width]
    return max(float(np.median((np.sort(np.abs(counters[level]), axis=1)[:, :keep].astype(float) ** 2).sum(axis=1))) for level in hashed)


def heavy_prefixes(counters: np.ndarray, least: float, most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Prefixes of the last level whose estimates, and those of all their shorter prefixes, reach ``least``; None if there are more than ``most``."""
    live = np.zeros(1, np.uint64)
    guess = np.zeros(1)
    for level in range(LEVELS):
        live = ((live[:, None] << np.uint64(STEP)) | np.arange(1 << STEP, dtype=np.uint64)[None, :]).ravel()
        guess = estimate(counters, level, live)
        live, guess = live[guess >= least], guess[guess >= least]
        if len(live) > most:
            return None
    return live, guess


def _descend(df: DataFrame, term: str, share: int, width: int, max_width: int):
    """(prefixes, estimates, rows, standard error) by a sketch that is fine enough, or None for the first two if none is."""
    while True:
        counters, total = collect_sketch(sketch(df, F.col(term), width), width)
        least = max(1.0, SLACK * total / share)
        error = float(np.median((counters[-1].astype(float) ** 2).sum(axis=1)) / width) ** 0.5
        wanted = CLEAR**2 * light_f2(counters) / least**2
        if wanted <= width:
            found = heavy_prefixes(counters, least, int(4 * share / SLACK) + 16)
            return (*(found or (None, None)), total, error)
        if wanted > max_width or width >= max_width:
            return None, None, total, error
        width = 1 << math.ceil(math.log2(wanted))


def frequent_terms(df: DataFrame, term: str, share: int) -> DataFrame:
    """Terms that hold at least 1/``share`` of the non-null rows: (term, estimate, n_rows, total_rows, error).

    ``n_rows`` is exact, counted in a second scan of the candidates' rows only; ``estimate`` is the sketch's, and
    ``error`` its standard error sqrt(F2 / width), F2 estimated from the sketch's own counters. A term is missed only if
    the estimates of one of its prefixes are too low by half in three of five rows (see CLEAR and HEAVY_PART); at most
    ``share`` terms are heavy, and the candidates are a small multiple of that. Where ``share`` is so large that a sketch of
    MAX_WIDTH can't tell such terms from the rest, all terms are counted by a shuffle, so none is missed; ``estimate`` is
    ``n_rows`` then and ``error`` 0.

    Nulls are no rows, repeated rows count each, texts are hashed whole, the empty text is a term, an empty table gives
    no terms, ties at the limit are all in.
    """
    prefixes, guess, total, error = _descend(df, term, share, WIDTH, MAX_WIDTH)
    hits = df.select(F.col(term).alias("term")).where(F.col("term").isNotNull())
    if prefixes is None:
        exact = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("estimate", F.col("n_rows").cast("double"))
        error = 0.0
    else:
        rows = [(int(np.int64(np.uint64(p))), float(g)) for p, g in zip(prefixes, guess)]
        candidates = df.sparkSession.createDataFrame(rows, "prefix long, estimate double")
        hits = hits.withColumn("prefix", F.shiftrightunsigned(F.xxhash64("term"), 64 - STEP * LEVELS)).join(F.broadcast(candidates), "prefix")
        exact = hits.groupBy("term", "estimate").agg(F.count(F.lit(1)).alias("n_rows"))
    return exact.where(F.col("n_rows") * share >= total).select("term", "estimate", "n_rows", F.lit(total).cast("long").alias("total_rows"), F.lit(error).alias("error"))


def top_terms(df: DataFrame, term: str, k: int, share: int) -> DataFrame:
    """The ``k`` most frequent terms among those with at least 1/``share`` of the rows; ties by the term."""
    return frequent_terms(df, term, share).orderBy(F.col("n_rows").desc(), "term").limit(k)
