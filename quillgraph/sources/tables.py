"""Reading the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statements(spark: SparkSession, sf_dir: str, predicates: tuple[str, ...] | None = None) -> DataFrame:
    """``triples`` as (triple_id, s, p, o): each id once, only rows with all three terms, and with ``predicates`` only those of them.

    A triple_id is delivered again with the same terms, so one row of each group is the same as any other; so predicates are chosen where the rows are read.
    """
    rows = table(spark, sf_dir, "triples").select("triple_id", "s", "p", "o")
    if predicates is not None:
        rows = rows.where(F.col("p").isin(*predicates))
    return (
        rows.where(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull())
        .groupBy("triple_id")
        .agg(F.min("s").alias("s"), F.min("p").alias("p"), F.min("o").alias("o"))
    )
