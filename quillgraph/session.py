"""Sessions and the shared folder through which long lineages are cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def get_session(master: str = "local[*]", partitions: int = 8, name: str = "quillgraph") -> SparkSession:
    """A session for local use; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or where that is unset, and all tasks run in this process, one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    own = getattr(spark, "_quillgraph_shared", None)
    if own is None:
        path = tempfile.mkdtemp(prefix="quillgraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        own = spark._quillgraph_shared = f"file://{path}"
    return own


def materialize(df: DataFrame, *, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage, fixes what is not deterministic (partition numbers), and survives lost executors,
    as the files don't live on them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    if not hasattr(spark, "_quillgraph_tables"):
        spark._quillgraph_tables = []
    spark._quillgraph_tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """The same, with the number of rows that fulfil ``condition``, counted while writing."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count_if(condition).alias("n")))
    return out, seen.get["n"]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that nothing will read again."""
    tables = getattr(df.sparkSession, "_quillgraph_tables", [])
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        own = next((t for t in tables if t.rsplit("/", 1)[1] == path.rsplit("/", 1)[1]), None)
        if own:
            tables.remove(own)
            _delete(df.sparkSession, own)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables of :func:`materialize` of this session: call it when the results that read them are written."""
    tables = getattr(spark, "_quillgraph_tables", [])
    while tables:
        _delete(spark, tables.pop())


@contextmanager
def intermediates(spark: SparkSession):
    """Deletes the tables of :func:`materialize` that are written inside: write or collect results before leaving."""
    kept = set(getattr(spark, "_quillgraph_tables", []))
    try:
        yield
    finally:
        tables = getattr(spark, "_quillgraph_tables", [])
        for path in [t for t in tables if t not in kept]:
            tables.remove(path)
            _delete(spark, path)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
