"""Texts that hold fixed strings; gold mapping and search over small tables."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import patterns, relevance, search


@pytest.mark.parametrize("block", [2, 50_000])
def test_holding_against_all_pairs(spark, block):
    texts = [(1, "abcabc"), (2, "bc"), (3, None), (4, ""), (None, "ab")]
    needles = [(1, "bc"), (2, "abc"), (3, ""), (4, None), (5, "cab"), (6, "bc")]
    got = patterns.holding(spark.createDataFrame(texts, "t int, s string"), "t", F.col("s"), spark.createDataFrame(needles, "n int, p string"), "n", F.col("p"), block)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((t, n)) for t, s in texts for n, p in needles if p and s and p in s)


def test_gold_mapping(spark):
    schema = "q int, difficulty string, keywords array<string>, expected int, evidence string"
    asked = [(1, "L1", ["1,200"], 1, "one two three four"), (2, "L2", None, 2, "five six"), (3, "L5", ["one"], 0, "one"), (4, "L1", ["absent"], 1, "zzz")]
    chunks = spark.createDataFrame([(10, "one two x"), (11, "paid 1200 now"), (12, "five"), (13, None)], "c int, t string")
    got = {r.q: r for r in relevance.map_gold(spark.createDataFrame(asked, schema), chunks, "q", "c", F.col("evidence"), F.col("t")).collect()}
    assert [(list(got[i].chunk_ids), got[i].best, got[i].coverage) for i in (1, 2, 3, 4)] == [([10, 11], 0.5, "full"), ([12], 0.5, "partial"), ([], 0.0, "none"), ([], 0.0, "none")]


def test_search_modes(spark):
    rows = [(i, "red car" if i % 2 else "blue boat", [float(i), 1.0], "A" if i < 5 else "B", 2020 + i % 2, "s") for i in range(10)]
    chunks = spark.createDataFrame([*rows, (None, "red", [1.0, 1.0], "A", 2020, "s"), (20, None, [1.0], "A", 2020, "s"), (21, "red", None, "B", 2021, "s")], "chunk_id long, text string, embedding array<double>, ticker string, fiscal_year int, statement_type string")
    chunks = chunks.withColumn("period_years", F.array(F.col("fiscal_year")))
    queries = spark.createDataFrame([(1, "red", [1.0, 0.0]), (2, "nothing", [0.0, 1.0]), (3, None, None)], "query_id long, text string, vector array<double>")
    ids = lambda **w: {q: [r.chunk_id for r in sorted(search.search(chunks, queries, 2, **w).collect(), key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2)}
    assert ids(mode="dense") == {1: [9, 8], 2: [0, 1]}
    assert ids(mode="sparse")[1] == [21, 1] and ids(mode="sparse")[2] == []
    assert ids(mode="dense", ticker="a") == {1: [4, 3], 2: [0, 1]}
    assert ids(mode="dense", strategy="pre_filter", ticker="a", fiscal_year=2021) == {1: [3, 1], 2: [1, 3]}
    assert ids(mode="hybrid", ticker="b")[1][0] == 9
    with pytest.raises(ValueError):
        search.search(chunks, queries, 2, mode="other")


def test_a_question_without_keywords_has_no_signal(spark):
    schema = "answerable boolean, difficulty string, gold_ids array<string>, chunk_id string, keywords array<string>, numbers array<string>, content string, gold_ticker string, ticker string, gold_years array<int>, period_years array<int>, gold_document string, document_id string, gold_pages array<int>, source_pages array<int>"
    row = lambda kws, nums, content: (True, "L1", ["a_1"], "a 1", kws, nums, content, "X", "Y", None, None, None, None, None, None)
    rows = [row([], [], "text"), (row(None, None, "text")), row(["Text"], [], "a text"), row([], ["1,234"], "paid 1,234"), row([], ["$-5"], "paid 5")]
    got = [r.relevant for r in relevance.is_relevant(spark.createDataFrame(rows, schema)).collect()]
    assert got == [False, False, True, True, True]
