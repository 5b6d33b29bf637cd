"""Explicit range partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.dictionary import dense_ids


def boundaries(df: DataFrame, column: str, n: int) -> DataFrame:
    """(part, bound): n - 1 values that cut the distinct values of ``column`` into n parts of equal numbers, exactly.

    Part k ends with its bound (inclusive). The values are numbered by a distributed sort; no task sees them all.
    """
    ranked = dense_ids(df.select(F.col(column).alias("bound")).where(F.col("bound").isNotNull()).distinct(), ["bound"], "_at")
    size = ranked.count()
    ends = {at: k for k in range(n - 1) if (at := size * (k + 1) // n - 1) >= 0}
    part = F.create_map(*[x for at, k in ends.items() for x in (F.lit(at).cast("long"), F.lit(k))]) if ends else F.create_map(F.lit(-1).cast("long"), F.lit(0))
    return ranked.where(F.col("_at").isin(list(ends))).select(part[F.col("_at")].alias("part"), "bound")


#: Bounds that are sent to all tasks at most.
MAX_PARTS = 10_000


def assign(df: DataFrame, column: str, bounds: DataFrame) -> DataFrame:
    """Add ``part``: the number of bounds below the value (0 for null); there is one bound less than there are parts.

    The sorted bounds, at most MAX_PARTS, are cut into groups of about their square root; a value is held against the last bound of each group and
    then against the bounds of one group, so of n bounds it meets about twice the root.
    """
    cuts = [r[0] for r in bounds.select("bound").where(F.col("bound").isNotNull()).limit(MAX_PARTS + 1).collect()]
    if len(cuts) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} bounds")
    cuts.sort(key=lambda x: x.encode() if isinstance(x, str) else x)
    if not cuts:
        return df.withColumn("part", F.lit(0))
    size = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    value = F.col(column)
    group = F.size(F.filter(F.array(*[F.lit(g[-1]) for g in groups]), lambda x: x < value))
    inner = F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), group)
    below = F.when(group < len(groups), group * size + F.size(F.filter(inner, lambda x: x < value))).otherwise(len(cuts))
    return df.withColumn("part", F.when(value.isNull(), 0).otherwise(below).cast("int"))


def spread(df: DataFrame, column: str, bounds: DataFrame) -> DataFrame:
    """The rows moved so that each part of :func:`assign` lies in partitions of its own, in the order of the parts, sorted within."""
    placed = assign(df, column, bounds)
    return placed.repartitionByRange("part", column).sortWithinPartitions("part", column)
