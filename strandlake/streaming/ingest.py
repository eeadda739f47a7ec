"""Incremental ingestion: append-only growth of a table, each id once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_unseen(batch: DataFrame, path: str, key: str) -> None:
    """Append a batch's rows whose key the table lacks; a replayed batch changes nothing. A null key is a key like others.

    Only the key column of the table is read.
    """
    spark = batch.sparkSession
    new = batch.dropDuplicates([key])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        stored = spark.read.parquet(path).select(F.col(key).alias("_stored"))
        new = new.join(stored, F.col(key).eqNullSafe(F.col("_stored")), "left_anti")
    new.write.mode("append").parquet(path)


def ingest(stream: DataFrame, path: str, key: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run append_unseen() on every micro-batch of a stream."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: append_unseen(batch, path, key)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
