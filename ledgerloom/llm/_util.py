"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.joins import BROADCAST_ROWS, checked_join

#: Bytes of an Arrow batch that goes to a Python worker, so that long texts don't pile up there.
BATCH_BYTES = "4m"
#: Rows for which a table takes another file.
FILE_ROWS = 50_000
#: Keys with lists for which a join takes another task.
LISTED_ROWS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir.

    Only where that setting is missing in local mode (tests) a local temporary folder takes its place; on a cluster it has to be set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="ledgerloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage, survives lost executors. See `forget`.

    rows: what the last step goes through at most, if known; small tables then take a task and a file for each FILE_ROWS
    of them at most, instead of one for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/ledgerloom/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that `materialize` has written, once all that is read from them has been written itself."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at.getParent(), True)


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a large table with one that is usually small, without one hot key landing in one task; see `checked_join`."""
    return checked_join(big, small, keys, how)


def join_listed(rows: DataFrame, listed: DataFrame, key: str, inner: bool = False, limit: int = BROADCAST_ROWS) -> DataFrame:
    """rows with the columns of listed, which has one row of any size for some keys; without inner, rows of other keys stay.

    Up to `limit` keys, they alone are broadcast, and only the rows that have one are shuffled, into a task for each
    LISTED_ROWS keys at most; beyond, all rows are.
    """
    n = listed.limit(limit + 1).count()
    if n > limit:
        return rows.join(listed, key, "inner" if inner else "left")
    keys = F.broadcast(listed.select(key))
    found = rows.join(keys, key, "left_semi").join(listed.hint("merge"), key).coalesce(n // LISTED_ROWS + 1)
    if inner:
        return found
    return found.unionByName(rows.join(keys, key, "left_anti"), allowMissingColumns=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES; sets the session's limit, which Spark reads when the plan runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(run, schema)
