"""Frequent class patterns and the order of siblings they suggest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.hierarchy import lookup


def transactions(term_class: DataFrame, frequency: DataFrame, max_length: int) -> DataFrame:
    """(term, items): the classes of a term, the most frequent first, cut to ``max_length``."""
    ranked = lookup(term_class, frequency.select("class", "freq"), "class")
    item = F.struct((-F.col("freq")).alias("f"), F.col("class").alias("c"))
    best = F.slice(F.array_sort(F.collect_set(item)), 1, max_length)
    return ranked.groupBy("term").agg(F.transform(best, lambda x: x["c"]).alias("items"))


def item_supports(trans: DataFrame) -> DataFrame:
    """(item, freq)."""
    return trans.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("freq"))


def frequent_patterns(trans: DataFrame, threshold: int, max_length: int) -> DataFrame:
    """(items, freq): sets of at most ``max_length`` classes in more than ``threshold`` transactions; items sorted.

    Parallel FP-growth: the conditional trees of groups of items are mined independently.
    """
    from pyspark.ml.fpm import FPGrowth

    n = trans.count()
    if n == 0:
        return trans.sparkSession.createDataFrame([], "items array<string>, freq long")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (threshold + 1) / n)).fit(trans)
    found = model.freqItemsets.where((F.col("freq") > threshold) & (F.size("items") <= max_length))
    return found.select(F.array_sort("items").alias("items"), "freq")


def frequent_pairs(trans: DataFrame, threshold: int) -> DataFrame:
    """(item_a, item_b, freq) with item_a < item_b, in more than ``threshold`` transactions.

    Transactions are cut to a length, so each has few pairs; they are counted on the map side first.
    """
    items = F.array_sort(F.array_distinct("items"))
    pairs = F.flatten(F.transform(items, lambda a: F.transform(F.filter(items, lambda b: b > a), lambda b: F.struct(a.alias("item_a"), b.alias("item_b")))))
    return trans.select(F.inline(pairs)).groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") > threshold)


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """Siblings of one parent: start with the first, then always the free neighbour of the strongest bond, else the next."""
    left = list(rows["class"].drop_duplicates().sort_values())
    bond: dict[str, list[tuple[int, str]]] = {}
    for a, b, n in rows[["class", "other", "freq"]].dropna().itertuples(index=False):
        bond.setdefault(a, []).append((-int(n), b))
    free, order = set(left), []
    todo = iter(left)
    while free:
        near = [x for x in sorted(bond.get(order[-1], [])) if x[1] in free] if order else []
        pick = near[0][1] if near else next(x for x in todo if x in free)
        free.remove(pick)
        order.append(pick)
    return pd.DataFrame({"parent": rows["parent"].iloc[0], "class": order, "position": range(len(order))})


def sibling_order(tree: DataFrame, pairs: DataFrame) -> DataFrame:
    """(parent, class, position): siblings chained by the support of the pairs they form, only those with any bond.

    The chain is greedy, so one parent's siblings are ordered in one task; there are as many as the parent has children
    in frequent pairs, which the threshold of the pairs bounds.
    """
    a = pairs.select(F.col("item_a").alias("class"), F.col("item_b").alias("other"), "freq")
    both = a.unionByName(a.select(F.col("other").alias("class"), F.col("class").alias("other"), "freq"))
    own = tree.where(F.col("parent").isNotNull()).select("class", "parent")
    near = both.join(own, "class").join(own.select(F.col("class").alias("other"), F.col("parent").alias("parent2")), "other")
    near = near.where(F.col("parent") == F.col("parent2")).select("parent", "class", "other", "freq")
    return near.groupBy("parent").applyInPandas(_chain, "parent string, class string, position int")
