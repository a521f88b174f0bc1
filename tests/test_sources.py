"""Caches, stores and clean pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import tables
from ledgerloom.sources import tables as store


def test_half_floats_and_back(spark):
    rows = [(1, [0.5, -2.25, 3.140625]), (2, None), (3, []), (4, [1e-9, 70000.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    got = {r.id: r.embedding for r in store.restored(store.halved(df)).collect()}
    assert (got[1], got[2], got[3]) == (rows[0][1], None, []) and got[4][0] == 0.0 and np.isinf(got[4][1])


def test_only_what_the_cache_lacks_is_encoded(spark, tmp_path):
    log = str(tmp_path / "asked")

    def encoder(texts):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in texts))
        return [[float(len(t)), 1.0] for t in texts]

    cache = spark.createDataFrame([("m::old", [1.0, 0.0]), ("other::new", [0.0, 1.0]), ("m::old", [1.0, 0.0])], "key string, embedding array<float>")
    texts = spark.createDataFrame([("old",), ("new",), ("new",), (None,)], "text string")
    vectors, new = store.encode_cached(texts, cache, "m", encoder)
    assert sorted(r.text for r in vectors.collect()) == ["new", "old"]
    assert set(open(log).read().split()) == {"new"}
    assert [r.key for r in new.collect()] == ["m::new"]


def test_shared_and_single_stores(spark, tmp_path):
    points = spark.createDataFrame([("1", "a", "x"), ("1", "b", "y"), ("d2", "c", "z")], "document_id string, chunk_id string, content string")
    store.write_store(points, str(tmp_path / "s"))
    assert store.read_store(spark, str(tmp_path / "s")).count() == 3
    one = store.read_store(spark, str(tmp_path / "s"), "1")
    assert sorted(r.chunk_id for r in one.collect()) == ["a", "b"] and "PartitionFilters: [isnotnull" in one._jdf.queryExecution().toString()


TABLE = "| Item | 2024 |\n| --- | --- |\n| Cash | 1 |"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ""),
        ("```markdown\n# A\r\n\r\n\r\n\r\ntext&nbsp;here\n```", "# A\n\ntext here"),
        ("é &#160;", "é"),
        (TABLE, TABLE),
        ("x\n| a | b |\n| --- | --- |\n| T | T |\n| c | d |\ny", "x\n| a | b |\n| --- | --- |\n| T |  |\n| c | d |\ny"),
        ("| Sales | 2024 - $5 | 2023 - $4 |\n| --- | --- | --- |\n| Cost | 1 | 2 |", "|  | 2024 | 2023 |\n| --- | --- | --- |\n| Sales | $5 | $4 |\n| Cost | 1 | 2 |"),
        ("| a | FY - 2024 |\n| --- | --- |", "| a | FY - 2024 |\n| --- | --- |"),
    ],
)
def test_clean_pages(raw, want):
    assert tables.plain_markdown(raw) == want


def test_clean_pages_column(spark):
    df = spark.createDataFrame([("a\r\nb",), (None,)], "m string")
    assert [r.m for r in df.select(tables.sanitized(F.col("m")).alias("m")).collect()] == ["a\nb", ""]
