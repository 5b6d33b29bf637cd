"""Items that appear together: an external sort of packed 64-bit pair codes, counted by run length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.dictionary import dense_ids
from quillgraph.operators.hierarchy import lookup
from quillgraph.session import materialize, parallelism

#: Pairs that are sorted in memory at once.
RUN_PAIRS = 2_000_000
#: Most items whose keys are sent to all tasks (8 bytes each); beyond that the ids are joined to the baskets.
BROADCAST_ITEMS = 1_000_000


def baskets(df: DataFrame, basket: str, items: str, weight: str) -> DataFrame:
    """(items, weight) of the baskets with a positive weight, each basket id once; rows without id count each."""
    rows = df.select(F.col(basket).alias("b"), F.struct(F.col(weight).cast("long").alias("weight"), F.col(items).alias("items")).alias("x"))
    once = rows.where(F.col("b").isNotNull()).groupBy("b").agg(F.max("x").alias("x"))
    return once.unionByName(rows.where(F.col("b").isNull())).select("x.items", "x.weight").where(F.col("weight") > 0)


def item_counts(data: DataFrame) -> DataFrame:
    """(item, n, n_baskets): the weight of the baskets with each item, nulls left out, repeats in a basket once."""
    one = data.select(F.explode(F.array_distinct("items")).alias("item"), "weight").where(F.col("item").isNotNull())
    return one.groupBy("item").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("n_baskets"))


def _basket_codes(batch: pa.RecordBatch, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in baskets, sorted and distinct within each: (basket number, id), and the weights of the baskets."""
    lists, weights = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.array([], np.int64)
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), size, 0)
    owner = np.repeat(np.arange(len(lists)), size)
    valid = flat.is_valid().to_numpy(zero_copy_only=False)
    value = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[valid]
    owner = owner[valid]
    if known is not None:
        at = np.searchsorted(known, value)
        hit = known[np.minimum(at, len(known) - 1)] == value if len(known) else np.zeros(len(value), bool)
        owner, value = owner[hit], at[hit]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])] if len(value) else np.array([], bool)
    return owner[fresh], value[fresh], weights


def _pairs(owner: np.ndarray, ids: np.ndarray, weights: np.ndarray):
    """(codes, weights) of the pairs in baskets, in pieces of about RUN_PAIRS, though a basket may have more."""
    end = np.searchsorted(owner, owner, side="right")
    after = end - np.arange(len(ids)) - 1
    edges = np.r_[0, np.searchsorted(np.cumsum(after), np.arange(RUN_PAIRS, int(after.sum()) + RUN_PAIRS, RUN_PAIRS), side="right")]
    edges = np.unique(np.r_[edges, len(ids)])
    for a, z in zip(edges[:-1], edges[1:]):
        n = after[a:z]
        left = np.repeat(np.arange(a, z), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        yield (ids[left] << np.int64(32)) | ids[right], weights[owner[left]]


def _sorted_run(codes: list[np.ndarray], weights: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """One sorted run: equal codes become one, with their number and weight."""
    code, w, n = np.concatenate(codes), np.concatenate(weights), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.array([], np.int64)
    if not len(code):
        return code, w, n
    return code[first], np.add.reduceat(w[order], first), np.add.reduceat(n[order], first)


def _batch(run: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in run], names=["code", "n_ab", "n_baskets"])


_CODES = "code long, n_ab long, n_baskets long"


def _make_runs(data: DataFrame, known: np.ndarray | None) -> DataFrame:
    shared = data.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches):
        codes, weights, held = [], [], 0
        for b in batches:
            for c, w in _pairs(*_basket_codes(b, shared.value if shared else None)):
                codes.append(c)
                weights.append(w)
                held += len(c)
                if held >= RUN_PAIRS:
                    yield _batch(_sorted_run(codes, weights, [np.ones(len(x), np.int64) for x in codes]))
                    codes, weights, held = [], [], 0
        if held:
            yield _batch(_sorted_run(codes, weights, [np.ones(len(x), np.int64) for x in codes]))

    return data.select("items", "weight").mapInArrow(run, _CODES)


def _count_runs(batches):
    """Run-length count of codes that come sorted; the last code of a batch may go on in the next."""
    rest: tuple[np.ndarray, ...] | None = None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if rest is not None:
            cols = [np.r_[r, c] for r, c in zip(rest, cols)]
        run = _sorted_run([cols[0]], [cols[1]], [cols[2]])
        yield _batch(tuple(x[:-1] for x in run))
        rest = tuple(x[-1:] for x in run)
    if rest is not None:
        yield _batch(rest)


def cooccurrence(
    df: DataFrame, basket: str, items: str, weight: str, *, min_item_weight: int = 0, min_item_baskets: int = 0, broadcast_items: int = BROADCAST_ITEMS
) -> tuple[DataFrame, int]:
    """Pairs of items with how often they occur together and how far that exceeds chance; and the number of baskets N.

    Result: (item_a, item_b, n_a, n_b, n_ab, n_baskets, lift, odds_ratio, log_odds_error) with item_a < item_b. ``n_...``
    are weights, ``n_baskets`` the distinct baskets with both. The odds ratio has 1/2 added to each of the four
    cells (continuity correction), so it is defined where a cell is 0; ``log_odds_error`` is the standard error of its logarithm.

    Items get dense ids in the order of their keys, pairs are packed into 64 bits (32 for each id), sorted runs
    of packed pairs are combined before the shuffle and written by it; the reducers' merge of sorted runs is counted
    by run length. A hot item or pair is one row per run, and its reducer gets one row per run of it.

    ``min_item_...`` leave out items below that weight or number of baskets (pairs of others can't reach it either).
    Nulls in baskets are ignored and repeats count once; a null or empty basket counts in N only, and one without a
    positive weight nowhere. A basket id counts once. An empty table gives no pair. More than 2^32 items raise an error.
    """
    spark = df.sparkSession
    data = materialize(baskets(df, basket, items, weight))
    total = data.agg(F.sum("weight")).first()[0] or 0
    kept = materialize(item_counts(data).where((F.col("n") >= min_item_weight) & (F.col("n_baskets") >= min_item_baskets)))
    n_items = kept.count()
    if n_items >= 1 << 32:
        raise ValueError("more than 2^32 items")
    if n_items <= broadcast_items:
        sized = kept.select("item", "n").toArrow()  # 16 bytes an item
        key, n_key = (sized.column(c).to_numpy() for c in ("item", "n"))
        order = np.argsort(key)
        known = key[order]
        codes = _make_runs(data, known)
    else:
        ids = materialize(dense_ids(kept.select("item"), ["item"], "id"))
        keyed = materialize(data.withColumn("row", F.monotonically_increasing_id()))
        long = keyed.select("row", "weight", F.explode("items").alias("item"))
        named = lookup(long, ids, "item").where(F.col("id").isNotNull())
        codes = _make_runs(named.groupBy("row", "weight").agg(F.collect_set("id").alias("items")), None)
        kept = kept.join(ids, "item")
    merged = codes.repartition(parallelism(spark), "code").sortWithinPartitions("code").mapInArrow(_count_runs, _CODES)
    if n_items <= broadcast_items:
        shared = spark.sparkContext.broadcast((known, n_key[order]))

        def name(batches):
            key, n = shared.value
            for b in batches:
                code = b.column(0).to_numpy(zero_copy_only=False)
                a, z = code >> np.int64(32), code & np.int64(0xFFFFFFFF)
                cols = [key[a], key[z], n[a], n[z]] if len(code) else [code] * 4
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in cols], b.column(1), b.column(2)], names=["item_a", "item_b", "n_a", "n_b", "n_ab", "n_baskets"])

        out = merged.mapInArrow(name, "item_a long, item_b long, n_a long, n_b long, n_ab long, n_baskets long")
    else:
        both = merged.select(F.shiftrightunsigned("code", 32).alias("id_a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("id_b"), "n_ab", "n_baskets")
        for side in "ab":
            both = lookup(both, kept.select(F.col("id").alias(f"id_{side}"), F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}")), f"id_{side}")
        out = both.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n_baskets")
    one, a, b, ab = F.lit(float(total)), F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.col("n_ab").cast("double")
    cells = [ab + 0.5, a - ab + 0.5, b - ab + 0.5, one - a - b + ab + 0.5]
    return (
        out.withColumn("lift", ab * one / (a * b))
        .withColumn("odds_ratio", cells[0] * cells[3] / (cells[1] * cells[2]))
        .withColumn("log_odds_error", F.sqrt(sum((F.lit(1.0) / c for c in cells[1:]), F.lit(1.0) / cells[0]))),
        int(total),
    )
