from pyspark.sql import functions as F

from ledgerloom.operators import search


def test_more_queries_than_a_block_holds(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), float(-i)]) for i in range(20)]
    chunks = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = chunks.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    want = sorted(map(tuple, search.dense_topk(chunks, queries, 3).collect()))
    monkeypatch.setattr(search, "QUERIES", 8)
    assert len(want) == 60
    assert sorted(map(tuple, search.dense_topk(chunks, queries, 3).collect())) == want
