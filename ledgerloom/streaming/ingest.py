"""Incremental ingestion by Structured Streaming: what the output has already isn't computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.tables import unfinished


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, keys: list[str], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append transform(rows) of a stream to the Parquet table at `out`, rows with keys that it has left out.

    Rows that repeat a key within a batch are kept once. A batch that is run again after a failure adds nothing, as its
    keys are there already.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        if _exists(spark, out):
            new = unfinished(new, spark.read.parquet(out), keys)
        transform(new).write.mode("append").parquet(out)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
