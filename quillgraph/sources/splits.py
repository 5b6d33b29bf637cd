"""Listing inputs and cutting them into byte ranges of about equal work."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what can't be read from the middle.
UNSPLITTABLE = (".gz", ".bz2")


@dataclass(frozen=True)
class Split:
    """A byte range of a file."""

    path: str
    start: int
    size: int
    splittable: bool


def is_splittable(path: str) -> bool:
    return not path.lower().endswith(UNSPLITTABLE)


def list_files(spark: SparkSession, path: str, prefix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a flat directory whose names start with ``prefix``; hidden ones are left out; the largest first.

    Any file system that Spark reads is listed: the driver sees names and sizes only.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    files = [(f.getPath(), f.getLen()) for f in found if f.isFile()]
    own = [(str(p), n) for p, n in files if (p.getName().startswith(prefix) and not p.getName().startswith((".", "_"))) or str(p) == str(at)]
    return sorted(own, key=lambda f: (-f[1], f[0]))


def list_inputs(path: str, prefix: str = "") -> list[Path]:
    """The same for a local path, without a session."""
    root = Path(path)
    files = [root] if root.is_file() else [f for f in root.iterdir() if f.is_file() and f.name.startswith(prefix) and not f.name.startswith(".")]
    return sorted(files, key=lambda f: (-f.stat().st_size, f.name))


def plan_splits(files: list[tuple[str, int]], n: int) -> list[list[Split]]:
    """``n`` lists of ranges of about total/n bytes of files (path, bytes); each range goes to the list with the least so far.

    Spark's own readers do this for every query; the plan is for tools that read ranges themselves.
    """
    each = max(1, -(-sum(size for _, size in files) // n))
    out: list[list[Split]] = [[] for _ in range(n)]
    load = [0] * n
    for path, size in files:
        can = is_splittable(path)
        step = each if can else max(size, 1)
        for start in range(0, max(size, 1), step):
            k = load.index(min(load))
            part = Split(path, start, min(step, size - start), can)
            out[k].append(part)
            load[k] += part.size
    return out


def cut_ranges(files: DataFrame, n: int) -> DataFrame:
    """(path, start, size) of files (path, size, splittable) that are a table: ranges of total/n bytes, whole files where they can't be split.

    A row without a path or size gives no range, an empty file an empty one.
    """
    known = files.where(F.col("path").isNotNull() & F.col("size").isNotNull()).select("path", "size", "splittable").distinct()
    each = max(1, -(-(known.agg(F.sum("size")).first()[0] or 0) // n))
    one = known.withColumn("step", F.when(F.coalesce("splittable", F.lit(False)), F.lit(each).cast("long")).otherwise(F.greatest("size", F.lit(1))))
    starts = one.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.col("step"))))
    return starts.select("path", "start", F.least("step", F.col("size") - F.col("start")).alias("size"))


def input_stats(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, compressed) of the input files."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    return files.withColumn("compressed", F.lower("path").endswith(".gz") | F.lower("path").endswith(".bz2"))
