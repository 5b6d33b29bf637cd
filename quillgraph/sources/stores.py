"""Sinks and their readers: dictionary, triples and taxonomy as text in gzip; everything as parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.encode import permutations


def write_dictionary_text(dictionary: DataFrame, path: str) -> None:
    """Lines ``id bytes term``; many files in a folder, each in gzip."""
    line = F.concat_ws(" ", F.col("id").cast("string"), F.octet_length("term").cast("string"), "term")
    dictionary.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def read_dictionary_text(spark: SparkSession, path: str) -> DataFrame:
    """(id, term); lines whose stated length isn't that of the term are left out."""
    part = F.split("value", " ", 3)
    rows = spark.read.text(path).select(part[0].cast("long").alias("id"), part[1].cast("int").alias("n"), part[2].alias("term"))
    return rows.where(F.octet_length("term") == F.col("n")).select("id", "term")


def write_triples_text(encoded: DataFrame, path: str) -> None:
    """Lines ``s p o``, distinct, sorted over all files: file k holds smaller triples than file k + 1."""
    rows = encoded.select("s", "p", "o").distinct().orderBy("s", "p", "o")
    rows.select(F.concat_ws(" ", "s", "p", "o").alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


def read_triples_text(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", " ", 3)
    return spark.read.text(path).select(*[part[i].cast("long").alias(c) for i, c in enumerate("spo")])


def write_taxonomy_text(lines: DataFrame, path: str) -> None:
    """The sections of :func:`quillgraph.operators.schema.taxonomy_lines`, each in a folder of its own, as its name says."""
    lines.select("section", F.col("line").alias("value")).write.mode("overwrite").partitionBy("section").option("compression", "gzip").text(path)


def read_taxonomy_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((class, assigned_id), (class, parent)) from the written sections."""
    rows = spark.read.text(path)
    part = F.split("value", "\t")
    ids = rows.where(F.col("section") == "Ranges").select(part[0].alias("class"), part[1].cast("long").alias("assigned_id"))
    parents = rows.where(F.col("section") == "Taxonomy").select(part[0].alias("class"), F.when(part[1] != "NULL", part[1]).alias("parent"))
    return ids, parents


def write_permutations(encoded: DataFrame, path: str, signature: int = 63, rows_per_file: int = 50_000_000) -> None:
    """Each order of the signature in a folder ``perm=...``, its files sorted within and of disjoint ranges: also a pair that holds most triples is spread."""
    rows = permutations(encoded, signature).repartitionByRange("perm", "c0", "c1", "c2")
    sorted_rows = rows.sortWithinPartitions("perm", "c0", "c1", "c2")
    sorted_rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("perm").parquet(path)


def read_permutation(spark: SparkSession, path: str, perm: str) -> DataFrame:
    """One order; only its folder is read."""
    return spark.read.parquet(path).where(F.col("perm") == perm).select("c0", "c1", "c2")


def write_sorted_runs(rows: DataFrame, path: str, keys: list[str], rows_per_file: int) -> None:
    """Files of at most ``rows_per_file`` rows, each sorted by ``keys``, of disjoint ranges of them."""
    rows.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_graph_dot(tree: DataFrame, path: str) -> None:
    """The class tree as lines of a DOT graph."""
    edge = F.concat(F.lit('"'), F.col("class"), F.lit('" -> "'), F.coalesce("parent", F.lit("")), F.lit('";'))
    tree.where(F.col("parent").isNotNull()).select(edge.alias("value")).write.mode("overwrite").text(path)
