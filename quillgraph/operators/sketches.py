"""Approximate counts: count-min counters, top-k sketches, distinct counts, samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.hashes import md5_56

CM_ROWS = 3


def _cell(term: Column, row: int, width: int) -> Column:
    return F.pmod(md5_56(F.concat(F.lit(f"{row}:"), term)), F.lit(width)).cast("int")


def count_min(occurrences: DataFrame, width: int) -> DataFrame:
    """(row, cell, n): CM_ROWS x ``width`` counters as a table; tables of parts add up by cell."""
    cells = F.array(*[F.struct(F.lit(r).alias("row"), _cell(F.col("term"), r, width).alias("cell")) for r in range(CM_ROWS)])
    return occurrences.where(F.col("term").isNotNull()).select(F.inline(cells)).groupBy("row", "cell").agg(F.count(F.lit(1)).alias("n"))


def count_min_estimate(terms: DataFrame, counters: DataFrame, width: int) -> DataFrame:
    """(term, estimate): the least of a term's counters; never too low. ``counters`` has at most CM_ROWS * width rows."""
    out = terms.select("term")
    for r in range(CM_ROWS):
        own = F.broadcast(counters.where(F.col("row") == r).select(F.col("cell").alias(f"_c{r}"), F.col("n").alias(f"_n{r}"))) if width <= 1 << 20 else counters.where(
            F.col("row") == r
        ).select(F.col("cell").alias(f"_c{r}"), F.col("n").alias(f"_n{r}"))
        out = out.join(own, _cell(F.col("term"), r, width) == F.col(f"_c{r}"), "left")
    return out.select("term", F.least(*[F.coalesce(f"_n{r}", F.lit(0)) for r in range(CM_ROWS)]).alias("estimate"))


def counters_for_input(n_bytes: int, k: int, *, compressed: bool = False, memory: int = 512 << 20, tasks: int = 8) -> int:
    """Counters of a row for an input of so many bytes: one for 1000 of them (100 if compressed), at least ``k``, and never more than
    0.7 of the memory holds in three rows of 8 bytes for each task, though a million always fit."""
    return min(max(k, n_bytes // (100 if compressed else 1000)), max(1_000_000, int(0.7 * memory / (3 * tasks) / 8)))


def count_min_top(occurrences: DataFrame, counters: DataFrame, width: int, k: int, threshold: int = 1) -> DataFrame:
    """(term, estimate): the ``k`` terms with the greatest estimates of at least ``threshold``, ties by the term, in bounded memory.

    The counters (CM_ROWS * ``width``) are sent to all tasks; each task keeps the k best terms it sees, by batches, so no more than k rows of a
    task are shuffled, however many distinct terms there are.
    """
    t = counters.toArrow()
    table = np.zeros((CM_ROWS, width), np.int64)
    table[t.column("row").to_numpy(), t.column("cell").to_numpy()] = t.column("n").to_numpy()
    shared = occurrences.sparkSession.sparkContext.broadcast(table)
    cells = occurrences.where(F.col("term").isNotNull()).select("term", *[_cell(F.col("term"), r, width).alias(f"c{r}") for r in range(CM_ROWS)])

    def best(batches):
        held = pa.table({"term": pa.array([], pa.string()), "estimate": pa.array([], pa.int64())})
        for b in batches:
            estimate = np.min([shared.value[r, b.column(r + 1).to_numpy()] for r in range(CM_ROWS)], axis=0) if b.num_rows else np.array([], np.int64)
            new = pa.table({"term": b.column(0).cast(pa.string()), "estimate": pa.array(estimate, pa.int64())}).filter(pc.greater_equal(pc.field("estimate"), threshold))
            held = pa.concat_tables([held, new]).group_by("term").aggregate([("estimate", "max")]).rename_columns(["term", "estimate"])
            held = held.take(pc.select_k_unstable(held, k, [("estimate", "descending"), ("term", "ascending")])) if held.num_rows > k else held
        yield from held.combine_chunks().to_batches()

    found = cells.mapInArrow(best, "term string, estimate long").groupBy("term").agg(F.max("estimate").alias("estimate"))
    return found.orderBy(F.col("estimate").desc(), "term").limit(k)


def popular_threshold(n_terms: int, size: int, counters: DataFrame, k: int) -> DataFrame:
    """(threshold): 4 * max(1, n_terms // size), or the least k-th largest counter of the rows if that is more."""
    kth = None
    for r in range(CM_ROWS):
        top = counters.where(F.col("row") == r).orderBy(F.col("n").desc()).limit(k).agg(F.greatest(F.lit(1), F.min("n")).alias("v"), F.count(F.lit(1)).alias("c"))
        top = top.select(F.when(F.col("c") == k, F.col("v")).otherwise(1).alias("v"))
        kth = top if kth is None else kth.unionByName(top)
    return kth.agg(F.greatest(F.lit(4 * max(1, n_terms // size)), F.min("v")).cast("long").alias("threshold"))


def top_k_sketch(occurrences: DataFrame, k: int, max_items: int = 10_000) -> DataFrame:
    """(term, estimate): the k most frequent terms by a bounded sketch that merges by partial aggregation."""
    got = occurrences.where(F.col("term").isNotNull()).agg(F.expr(f"approx_top_k(term, {int(k)}, {int(max_items)})").alias("t"))
    return got.select(F.explode("t").alias("t")).select(F.col("t.item").alias("term"), F.col("t.count").alias("estimate"))


def top_k_state(occurrences: DataFrame, by: str | None = None, max_items: int = 10_000) -> DataFrame:
    """([by,] state): bounded sketches of the frequent terms, to be stored and united later."""
    rows = occurrences.where(F.col("term").isNotNull())
    agg = F.expr(f"approx_top_k_accumulate(term, {int(max_items)})").alias("state")
    return rows.groupBy(by).agg(agg) if by else rows.agg(agg)


def united_top_k(states: DataFrame, k: int, max_items: int = 10_000) -> DataFrame:
    """(term, estimate): the k most frequent terms over all stored sketches."""
    one = states.agg(F.expr(f"approx_top_k_combine(state, {int(max_items)})").alias("state"))
    got = one.select(F.explode(F.expr(f"approx_top_k_estimate(state, {int(k)})")).alias("t"))
    return got.select(F.col("t.item").alias("term"), F.col("t.count").alias("estimate"))


def rescored_candidates(occurrences: DataFrame, k: int, width: int, threshold: int) -> DataFrame:
    """(term, estimate): candidates of the top-k sketch with count-min estimates of at least ``threshold``, ties by term desc."""
    cand = top_k_sketch(occurrences, 2 * k)
    scored = count_min_estimate(cand, count_min(occurrences, width), width)
    return scored.where(F.col("estimate") >= threshold).orderBy(F.col("estimate").desc(), F.col("term").desc()).limit(k)


def approx_distinct(df: DataFrame, column: str, by: str | None = None, error: float = 0.02) -> DataFrame:
    """([by,] n_approx): distinct values by HyperLogLog, per group or in all."""
    agg = F.approx_count_distinct(column, error).alias("n_approx")
    return df.groupBy(by).agg(agg) if by else df.agg(agg)


def distinct_sketch(df: DataFrame, column: str, by: str) -> DataFrame:
    """(by, sketch): HLL sketches to be stored and united later."""
    return df.groupBy(by).agg(F.hll_sketch_agg(column).alias("sketch"))


def united_distinct(sketches: DataFrame) -> DataFrame:
    """(n_approx): distinct values over all stored sketches."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_approx"))


def sample_occurrences(occurrences: DataFrame, per_10000: int) -> DataFrame:
    """A reproducible Bernoulli sample of the occurrences, by a hash of term, triple and position."""
    key = F.concat_ws("|", F.col("term"), F.col("triple_id").cast("string"), F.col("pos").cast("string"))
    return occurrences.where(F.pmod(md5_56(key), F.lit(10000)) < per_10000)
