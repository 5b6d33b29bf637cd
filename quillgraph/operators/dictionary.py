"""Dictionaries: terms and their ids under several policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.hashes import md5_56
from quillgraph.session import materialize, parallelism

_LOW_33 = (1 << 33) - 1


def dense_ids(df: DataFrame, order: list[str | Column], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: consecutive ids from ``start`` in the order given, which must be total on the rows.

    No task sees all rows: they are sorted by ranges, written once (so the ranges are fixed), numbered within their
    range, and shifted by the number of rows in the ranges before. What is broadcast is one row per range.
    """
    spark = df.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = parallelism(spark)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    fixed = materialize(ranged)
    counts = fixed.groupBy(F.shiftrightunsigned("_at", 33).alias("_range")).count()
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    out = fixed.join(F.broadcast(offsets), F.shiftrightunsigned("_at", 33) == F.col("_range"))
    return out.select(*df.columns, (F.col("_at").bitwiseAND(F.lit(_LOW_33)) + F.col("_offset") + F.lit(start)).alias(name))


def explode_terms(triples: DataFrame, *, ignore_predicates: bool = False) -> DataFrame:
    """(triple_id, pos, term): one row per position; pos 0 is s, 1 is p, 2 is o. Null terms give no row."""
    kept = [(0, "s"), (2, "o")] if ignore_predicates else [(0, "s"), (1, "p"), (2, "o")]
    items = F.array(*[F.struct(F.lit(i).cast("byte").alias("pos"), F.col(c).alias("term")) for i, c in kept])
    return triples.select("triple_id", F.inline(items)).where(F.col("term").isNotNull())


def origin_tag(triple_id: Column, pos: Column) -> Column:
    """Triple and position in one number."""
    return F.shiftleft(triple_id, 2) + pos.cast("long")


def tail_occurrences(triples: DataFrame, popular: DataFrame, code=md5_56) -> DataFrame:
    """(triple_id, pos, term, hash_1, hash_2): occurrences of terms that aren't popular, with the hashes of the two other terms of their triple."""
    others = {"s": "po", "p": "so", "o": "sp"}
    coded = triples.select("triple_id", "s", "p", "o", *[code(F.col(c)).alias(f"h{c}") for c in "spo"])
    items = [F.struct(F.lit(i).alias("pos"), F.col(c).alias("term"), F.col(f"h{a}").alias("hash_1"), F.col(f"h{b}").alias("hash_2")) for i, (c, (a, b)) in enumerate(others.items())]
    rows = coded.select("triple_id", F.inline(F.array(*items))).where(F.col("term").isNotNull())
    return rows.join(F.broadcast(popular.select("term")), "term", "left_anti").select("triple_id", "pos", "term", "hash_1", "hash_2")


def dictionary_stats(freq: DataFrame, popular: DataFrame) -> DataFrame:
    """(n_terms, n_occurrences, n_popular, n_triples): how many terms and occurrences there are, and how many of these the popular terms cover."""
    top = F.broadcast(popular.select("term", F.lit(1).alias("hot")))
    return freq.join(top, "term", "left").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("freq").alias("n_occurrences"), F.sum(F.when(F.col("hot") == 1, F.col("freq")).otherwise(0)).alias("n_popular"), (F.sum("freq") / 3).cast("long").alias("n_triples")
    )


def term_frequency(occurrences: DataFrame) -> DataFrame:
    """(term, freq)."""
    return occurrences.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))


def top_terms(freq: DataFrame, k: int, *, ties_descending: bool = False, min_freq: int = 1) -> DataFrame:
    """The ``k`` most frequent terms; ties by the term, ascending or descending (bytewise). A partial top-k per task."""
    tie = F.col("term").desc() if ties_descending else F.col("term").asc()
    return freq.where(F.col("freq") >= min_freq).orderBy(F.col("freq").desc(), tie).limit(k)


def tail_terms(freq: DataFrame, popular: DataFrame) -> DataFrame:
    """Terms that aren't popular. ``popular`` has at most k rows, a parameter, so it is broadcast."""
    return freq.join(F.broadcast(popular.select("term")), "term", "left_anti")


def popular_ids(popular: DataFrame, start: int = 0, *, ties_descending: bool = False) -> DataFrame:
    """(id, term) of at most k popular terms, by frequency; one small window."""
    tie = F.col("term").desc() if ties_descending else F.col("term").asc()
    w = Window.orderBy(F.col("freq").desc(), tie)
    return popular.select((F.row_number().over(w) - 1 + F.lit(start)).cast("long").alias("id"), "term")


def lexicographic(terms: DataFrame, start: int = 0, *, unique: bool = False) -> DataFrame:
    """(id, term): the distinct terms in bytewise order; ``unique`` says that each stands there once."""
    own = terms.select("term") if unique else terms.select("term").distinct()
    return dense_ids(own, ["term"], "id", start).select("id", "term")


def popular_first(freq: DataFrame, k: int, start: int = 0, *, ties_descending: bool = True) -> DataFrame:
    """(id, term): the k most frequent terms by frequency, then all others in bytewise order."""
    head = materialize(popular_ids(top_terms(freq, k, ties_descending=ties_descending), start, ties_descending=ties_descending))
    n = head.count()
    return head.unionByName(lexicographic(tail_terms(freq, head), start + n, unique=True))


def class_clustered(freq: DataFrame, term_class: DataFrame, k: int, start: int = 0) -> DataFrame:
    """(id, term, class_id): popular terms by frequency, then the others by class (none last) and text.

    ``term_class`` is (term, class_id) with one row per term at most.
    """
    head = materialize(popular_ids(top_terms(freq, k), start))
    n = head.count()
    tail = tail_terms(freq, head).select("term").join(term_class, "term", "left")
    rest = dense_ids(tail, [F.col("class_id").asc_nulls_last(), F.col("term")], "id", start + n)
    return head.withColumn("class_id", F.lit(None).cast("long")).unionByName(rest.select("id", "term", "class_id"))


def hashed(terms: DataFrame, code=md5_56) -> DataFrame:
    """(id, term): the id is a 56-bit hash of the text, by ``code`` (a function of a column). Two terms may share an id; see :func:`conflicts`."""
    return terms.select("term").distinct().select(code(F.col("term")).alias("id"), "term")


def conflicts(dictionary: DataFrame) -> DataFrame:
    """(id, n_terms, term) of ids with more than one term; ``term`` is the least of them."""
    per = dictionary.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), F.min("term").alias("term"))
    return per.where(F.col("n_terms") > 1)


def extend(dictionary: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, term) for the terms not in the dictionary, in bytewise order after its greatest id."""
    new = terms.select("term").distinct().join(dictionary.select("term"), "term", "left_anti")
    start = dictionary.agg(F.max("id")).first()[0]
    return dense_ids(new, ["term"], "id", 0 if start is None else start + 1).select("id", "term")
