"""Running sums within groups, of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import materialize, parallelism


def prefix_sums(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same ``group`` before the row in ``order``.

    ``order`` must be total in a group; a null group is a group. Groups are cut into ranges of (group, order), written once, and
    summed within each range; the totals of the ranges a group spans are summed before it. What is broadcast are the
    totals of groups that go on from one range to the next: fewer rows than ranges.
    """
    n = parallelism(df.sparkSession)
    cut = df.repartitionByRange(n, F.col(group).asc_nulls_first(), *order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(cut)
    own = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.sum(value).alias("_t"))
    base = totals.withColumn("_base", F.sum("_t").over(before)).where(F.col("_base").isNotNull()).drop("_t")
    local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(own), F.lit(0)))
    out = local.join(F.broadcast(base), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")), "left")
    return out.select(*df.columns, (F.col("_local") + F.coalesce("_base", F.lit(0))).alias(name))
