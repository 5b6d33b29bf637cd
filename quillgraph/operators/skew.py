"""Per-key results although a few keys hold most rows: a tree of partial states."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import materialize

#: Rows that one local combine takes in.
CHUNK_ROWS = 65_536
#: States of one key that a task of a merge round takes in.
FAN_IN = 16


def _combine_chunks(batches, chunk_rows: int, heavy_rows: int):
    """Fold pair rows into one state per key and fixed-size chunk."""

    def fold(rows: list[pa.RecordBatch], chunk: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        g = t.group_by(["pos", "term"]).aggregate([("n_rows", "sum"), ("n_s", "sum"), ("first_seen", "min"), ("last_seen", "max"), ("n_rows", "count")])
        light = pc.less(g["n_rows_count"], heavy_rows)
        node = pc.if_else(light, pa.scalar(-1, pa.int64()), pa.scalar(chunk, pa.int64()))
        out = pa.table({"pos": g["pos"], "term": g["term"], "node": node, "n_rows": g["n_rows_sum"], "n_s": g["n_s_sum"], "first_seen": g["first_seen_min"], "last_seen": g["last_seen_max"]})
        return out.combine_chunks().to_batches()


    held: list[pa.RecordBatch] = []
    n, k, base = 0, 0, TaskContext.get().partitionId() << 24
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= chunk_rows:
            yield from fold(held, base + k)
            held, n, k = [], 0, k + 1
    if n:
        yield from fold(held, base + k)


_STATE = "pos string, term string, node long, n_rows long, n_s long, first_seen timestamp_ntz, last_seen timestamp_ntz"


def _merge(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_s").alias("n_s"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def tree_aggregate(
    df: DataFrame, keys: list[str], member: str, time: str, *, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, heavy_share: float = 1 / 64
) -> DataFrame:
    """For each value of each column in ``keys``: rows, distinct ``member``, first and last ``time``.

    Result: (pos, term, n_rows, n_s, first_seen, last_seen); ``pos`` names the column, one row per non-null value.

    1. Rows become (pos, term, member) pairs, combined on the map side and spread by *all three* columns, so that a
       key's rows lie in all partitions, however many it has, and each distinct member of it in one.
    2. Fixed-size chunks of pairs are folded locally into one state per key. As no member is in two chunks, the
       counts of distinct members add up.
    3. States of keys that fill at least ``heavy_share`` of their chunk (at most 1/heavy_share of them per chunk) go
       through rounds of ``fan_in`` until no more than ``fan_in`` are left of any key; a key that is light in all its
       chunks skips the rounds. The last round joins both, by key alone.

    Nulls: rows without the key count nowhere, a null member counts as a row only, null times are ignored; a key all
    of whose times are null has null for both. Repeated rows count as rows. An empty input gives an empty result. Only
    the columns named are read, so others may clash with the names used here.
    """
    spark = df.sparkSession
    entries = F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.col(k).cast("string").alias("term")) for k in keys]))
    pairs = (
        df.select(entries.alias("e"), F.col(member).alias("s"), F.col(time).cast("timestamp_ntz").alias("t"))
        .where(F.col("e.term").isNotNull())
        .groupBy(F.col("e.pos").alias("pos"), F.col("e.term").alias("term"), F.col("s").alias("s"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))
    )
    pairs = pairs.select("pos", "term", F.col("s").isNotNull().cast("long").alias("n_s"), "n_rows", "first_seen", "last_seen")
    heavy_rows = max(2, int(chunk_rows * heavy_share))
    states = materialize(pairs.mapInArrow(lambda it: _combine_chunks(it, chunk_rows, heavy_rows), _STATE))
    heavy = states.where(F.col("node") >= 0)
    left = heavy.groupBy("pos", "term").count().agg(F.max("count")).first()[0] or 0
    while left > fan_in:
        left = math.ceil(left / fan_in)
        heavy = _merge(heavy.withColumn("node", F.pmod(F.xxhash64("node", F.lit(left)), F.lit(left))), "pos", "term", "node")
    return _merge(states.where(F.col("node") < 0).unionByName(heavy), "pos", "term")


def heavy_keys(states: DataFrame, totals: dict[str, int], share: int) -> DataFrame:
    """Of a result of :func:`tree_aggregate`, the keys with at least 1/``share`` of all rows of the input."""
    limit = F.create_map(*[x for k, n in totals.items() for x in (F.lit(k), F.lit(n))])
    return states.where(F.col("n_rows") * share >= limit[F.col("pos")])
