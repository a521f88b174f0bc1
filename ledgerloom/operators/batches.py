"""Arrow passes over rows in batches of bounded bytes, and what they count."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Bytes of an Arrow batch that goes to a Python worker, so that long texts don't pile up there.
BATCH_BYTES = "4m"


def in_arrow(df: DataFrame, work: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES; sets the session's limit, which Spark reads when the plan runs."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(work, schema)


def are_unique(df: DataFrame, keys: list[str]) -> bool:
    """Whether no two rows have the same keys, nulls alike; reads the keys only."""
    return df.select(*keys).groupBy(*keys).count().filter("count > 1").isEmpty()


def term_counts(lists: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of lists: row, term and count of every term that a row has, by row; and the rows' sizes."""
    length = np.diff(lists.offsets.to_numpy())
    found = pc.index_in(lists.flatten(), value_set=terms)
    known = found.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), length)[known]
    code, tf = np.unique(row * max(1, len(terms)) + found.drop_null().to_numpy(), return_counts=True)
    return code // max(1, len(terms)), code % max(1, len(terms)), tf, length


def counted(df: DataFrame, keys: list[str], *lists: Column) -> DataFrame:
    """(keys, tokens, counts of each list): row by row the distinct tokens of all lists of strings, each with its count in every list.

    Rows are counted where they lie, nothing is shuffled; null lists are empty.
    """
    names = [f"n{i}" for i in range(len(lists))]

    def work(batches):
        for b in batches:
            own = [b.column(len(keys) + i) for i in range(len(names))]
            rows = np.concatenate([np.repeat(np.arange(b.num_rows), np.diff(x.offsets.to_numpy())) for x in own])
            which = np.concatenate([np.full(len(x.flatten()), i) for i, x in enumerate(own)])
            words = pa.concat_arrays([x.flatten() for x in own]).dictionary_encode()
            size = max(1, len(words.dictionary))
            cell, at = np.unique(rows * size + words.indices.to_numpy(), return_inverse=True)
            starts = pa.array(np.searchsorted(cell, np.arange(b.num_rows + 1) * size), pa.int32())
            tokens = pa.ListArray.from_arrays(starts, words.dictionary.take(pa.array(cell % size)))
            counts = [pa.ListArray.from_arrays(starts, pa.array(np.bincount(at[which == i], minlength=len(cell)), pa.int64())) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], tokens, *counts], [*keys, "tokens", *names])

    rows = df.select(*keys, *[F.coalesce(x, F.array().cast("array<string>")).alias(n) for x, n in zip(lists, names, strict=True)])
    kinds = [*rows.schema.fields[: len(keys)], StructField("tokens", ArrayType(StringType())), *[StructField(n, ArrayType(LongType())) for n in names]]
    return in_arrow(rows, work, StructType(kinds))


def exploded(rows: DataFrame, keys: list[str], **names: str) -> DataFrame:
    """(keys, token, names): a row for each token of `counted`, with its counts by new names."""
    cells = F.arrays_zip("tokens", *names.values())
    return rows.select(*keys, F.explode(cells).alias("_c")).select(*keys, F.col("_c.tokens").alias("token"), *[F.col(f"_c.{old}").alias(new) for new, old in names.items()])
