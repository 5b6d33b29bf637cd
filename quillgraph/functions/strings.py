"""Functions on texts, bytes and numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def common_prefix(a: Column, b: Column) -> Column:
    """Number of bytes the two texts have in common at their start.

    Compared by hex digits, so that it is bytes that count; 0 if either is empty, null if either is null.
    """
    x, y = F.hex(F.encode(a, "UTF-8")), F.hex(F.encode(b, "UTF-8"))
    n = F.least(F.octet_length(a), F.octet_length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = F.aggregate(
        at,
        F.struct(F.lit(True).alias("on"), F.lit(0).alias("k")),
        lambda acc, i: F.when(
            acc["on"] & (F.substring(x, i * 2 - 1, F.lit(2)) == F.substring(y, i * 2 - 1, F.lit(2))), F.struct(F.lit(True).alias("on"), (acc["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.lit(False).alias("on"), acc["k"].alias("k"))),
        lambda acc: acc["k"],
    )
    return F.when(a.isNotNull() & b.isNotNull(), same)


def prefix_split(term: Column) -> tuple[Column, Column]:
    """(prefix, local name) of an IRI that starts ``<http://`` and has more than 10 bytes.

    The prefix ends with the first ``#`` or, without one, with the first ``/`` behind the scheme; it is empty, and the
    local name the whole term, for all other terms.
    """
    fits = term.startswith("<http://") & (F.octet_length(term) > 10)
    rest = F.substring(term, F.lit(9), F.length(term))
    cut = F.when(F.instr(rest, "#") > 0, F.instr(rest, "#")).otherwise(F.instr(rest, "/"))
    prefix = F.when(fits & (cut > 0), F.substring(term, F.lit(1), cut + 8)).otherwise(F.when(term.isNotNull(), F.lit("")))
    return prefix, F.substring(term, F.length(prefix) + 1, F.length(term))


def leading_zeros(x: Column, bits: int = 64) -> Column:
    """Number of leading zeros of a LONG (or of its lowest 32 bits)."""
    y = x.cast("long") if bits == 64 else x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(y == 0, F.lit(bits)).otherwise(F.lit(bits) - F.length(F.bin(y)))


def least_set_bit(x: Column) -> Column:
    """Position of the lowest bit that is set; null for 0."""
    return F.when(x != 0, F.bit_count(x.bitwiseAND(-x) - 1))


def first_zero_bit(x: Column) -> Column:
    """Position of the lowest bit that is not set; 64 if all are."""
    return F.coalesce(least_set_bit(F.bitwise_not(x)), F.lit(64))


def varint_bytes(x: Column) -> Column:
    """Bytes of a number of 0 or more, seven bits a byte."""
    return F.greatest(F.lit(1), F.ceil((F.lit(64) - leading_zeros(x)) / 7)).cast("int")


def fixed_bytes(x: Column) -> Column:
    """Bytes of a number of 0 or more at full width."""
    return F.greatest(F.lit(1), F.ceil((F.lit(64) - leading_zeros(x)) / 8)).cast("int")


def vlong_bytes(x: Column) -> Column:
    """Bytes of a number of 0 or more with five bits and a three-bit size in the first byte, eight in each other."""
    return F.when(x < 32, 1).otherwise(F.lit(1) + F.ceil((F.lit(64) - leading_zeros(x) - 5) / 8)).cast("int")


def path_parts(path: Column) -> dict[str, Column]:
    """file_name, parent, extension, stem (up to the first dot) and base (up to the last dot) of a path."""
    name = F.substring_index(path, "/", -1)
    return {
        "file_name": name,
        "parent": F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("")),
        "extension": F.when(F.instr(name, ".") > 0, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(F.lit("")),
        "stem": F.substring_index(name, ".", 1),
        "base": F.when(F.instr(name, ".") > 0, F.regexp_replace(name, "\\.[^.]*$", "")).otherwise(name),
    }


# What the beginnings of terms are shortened to.
SHORT_NAMES = {
    "http://www.w3.org/2002/07/owl#": "owl_",
    "http://www.lehigh.edu/~zhp2/2004/0401/univ-bench.owl#": "lubm_",
    "http://www.w3.org/2000/01/rdf-schema#": "rdfs_",
    "_:": "blanknode_",
}


def short_iri(term: Column) -> Column:
    """An IRI without brackets, well-known namespaces (and the sign of blank nodes) shortened; other terms as they are."""
    bare = F.when(term.startswith("<"), F.regexp_replace(term, "^<|>$", "")).otherwise(term)
    out = bare
    for start, short in SHORT_NAMES.items():
        out = F.when(bare.startswith(start), F.concat(F.lit(short), F.substring(bare, F.lit(len(start) + 1), F.length(bare)))).otherwise(out)
    return out
