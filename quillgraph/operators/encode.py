"""Triples of texts to triples of ids, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.hashes import md5_56
from quillgraph.operators.dictionary import explode_terms, hashed
from quillgraph.operators.hierarchy import HOT, lookup

# The orders of the six permutations; the position is the bit in a signature.
PERMUTATIONS = ("spo", "ops", "pos", "sop", "osp", "pso")


def _by_triple(coded: DataFrame) -> DataFrame:
    at = lambda i: F.max(F.when(F.col("pos") == i, F.col("id")))
    return coded.groupBy("triple_id").agg(at(0).alias("s"), at(1).alias("p"), at(2).alias("o"))


def encode(triples: DataFrame, dictionary: DataFrame, *, ignore_predicates: bool = False, freq: DataFrame | None = None) -> DataFrame:
    """(triple_id, s, p, o) with ids from ``dictionary`` (id, term); a term not in it gives null.

    The terms of all positions go through one join. Terms that hold at least HOT of the occurrences meet broadcast rows of
    the dictionary; all others are joined by a shuffle. Which these are is read from ``freq`` (term, freq), a table, or else
    counted. With ``ignore_predicates`` p is 0.
    """
    if freq is not None:
        n = freq.agg(F.sum("freq")).first()[0] or 0
        hot = freq.where(F.col("freq") >= max(1, int(n * HOT))).select("term")  # at most 1/HOT rows
        out = encode_hybrid(triples, dictionary.join(F.broadcast(hot), "term", "left_semi"), dictionary, ignore_predicates=ignore_predicates)
    else:
        out = _by_triple(lookup(explode_terms(triples, ignore_predicates=ignore_predicates), dictionary.select("term", "id"), "term"))
    return out.withColumn("p", F.lit(0).cast("long")) if ignore_predicates else out


def encode_hybrid(triples: DataFrame, popular: DataFrame, tail: DataFrame, *, ignore_predicates: bool = False) -> DataFrame:
    """The same with a given set of popular terms (at most k rows, a parameter), which is broadcast; ``tail`` has all others."""
    occ = explode_terms(triples, ignore_predicates=ignore_predicates)
    hot = popular.select(F.col("term").alias("_h"), F.col("id").alias("_hid"))
    out = occ.join(F.broadcast(hot), F.col("term") == F.col("_h"), "left")
    # Popular rows get keys that match nothing and are spread evenly, so the shuffle join never sees a hot term.
    salt = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("triple_id"), F.lit(4096)).cast("string"))
    out = out.withColumn("_j", F.when(F.col("_hid").isNull(), F.col("term")).otherwise(salt))
    rest = tail.select(F.col("term").alias("_t"), F.col("id").alias("_tid"))
    return _by_triple(out.join(rest, F.col("_j") == F.col("_t"), "left").withColumn("id", F.coalesce("_hid", "_tid")))


def decode(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(triple_id, s, p, o) with texts; an id not in the dictionary gives null."""
    long = encoded.select("triple_id", F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.col(c).alias("id")) for i, c in enumerate("spo")])))
    named = lookup(long, dictionary.select("id", "term"), "id")
    at = lambda i: F.max(F.when(F.col("pos") == i, F.col("term")))
    return named.groupBy("triple_id").agg(at(0).alias("s"), at(1).alias("p"), at(2).alias("o"))


def distinct_spo(encoded: DataFrame) -> DataFrame:
    return encoded.select("s", "p", "o").distinct()


def parse_signature(signature: int) -> list[int]:
    """Numbers of the permutations whose bits are set, ascending."""
    return [i for i in range(len(PERMUTATIONS)) if signature >> i & 1]


def add_permutation(signature: int, number: int) -> int:
    return signature | 1 << number


def has_permutation(signature: Column, number: Column | int) -> Column:
    n = F.lit(number) if isinstance(number, int) else number
    return F.bit_get(signature, n) == 1


def permutations(encoded: DataFrame, signature: int = 63) -> DataFrame:
    """(perm, c0, c1, c2): each triple once in every order of the signature; one pass over the input."""
    rows = [F.struct(F.lit(PERMUTATIONS[i]).alias("perm"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(PERMUTATIONS[i])]) for i in parse_signature(signature)]
    return encoded.select(F.inline(F.array(*rows)))


def hash_encode(triples: DataFrame, signature: int = 63, code=md5_56) -> tuple[DataFrame, DataFrame]:
    """(permutations, dictionary) with hash ids by ``code``: one projection and no join; duplicates are kept."""
    coded = triples.select(*[code(F.col(c)).alias(c) for c in "spo"])
    return permutations(coded, signature), hashed(triples.select(F.explode(F.array("s", "p", "o")).alias("term")).where(F.col("term").isNotNull()), code)
