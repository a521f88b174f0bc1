"""Joins whose small side is checked before it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000
#: Copies of each row of the smaller side when a join is salted.
SALTS = 16


def checked_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large table with one that is usually small, without one hot key landing in one task.

    The small side is counted. Up to `limit` rows it is broadcast; beyond that every row of it is copied once for each salt
    and the large side is salted at random by row, so a hot key is spread over SALTS tasks.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), keys, how)
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for a broadcast if it has at most `limit` rows; else df as it is, and Spark chooses the join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
