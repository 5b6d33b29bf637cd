"""A dictionary and encoded triples kept up to date by a stream of triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillgraph.operators.dictionary import explode_terms, extend
from quillgraph.operators.encode import encode
from quillgraph.session import materialize

DICTIONARY = StructType([StructField("id", LongType()), StructField("term", StringType())])


def read_dictionary(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All terms so far, or those of batches before ``before``; empty if nothing is written yet."""
    try:
        out = spark.read.schema("id long, term string, batch long").parquet(path)
        return (out if before is None else out.where(out["batch"] < before)).select("id", "term")
    except Exception as e:  # the folder doesn't exist before the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], DICTIONARY)


def encode_batch(triples: DataFrame, batch: int, dictionary_path: str, triples_path: str) -> None:
    """Give ids to the batch's new terms, after all ids so far, and append its encoded triples.

    Each batch overwrites its own folders only, so a batch that is run again after a failure leaves the same files.
    """
    spark = triples.sparkSession
    rows = materialize(triples.select("triple_id", "s", "p", "o"))
    known = read_dictionary(spark, dictionary_path, batch)
    new = materialize(extend(known, explode_terms(rows)))
    new.write.mode("overwrite").parquet(f"{dictionary_path}/batch={batch}")
    encode(rows, known.unionByName(new)).write.mode("overwrite").parquet(f"{triples_path}/batch={batch}")


def run(triples: DataFrame, dictionary_path: str, triples_path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Start the stream; ``triples`` is a streaming DataFrame with triple_id, s, p, o."""
    writer = triples.writeStream.foreachBatch(lambda df, n: encode_batch(df, n, dictionary_path, triples_path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
