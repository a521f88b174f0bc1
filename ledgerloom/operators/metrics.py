"""Retrieval metrics per question and their reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (5, 10, 20, 50)


def ndcg(rank: Column, relevant: Column, k: int) -> Column:
    """An aggregate: discounted gain of the first k hits over that of as many relevant ones as were retrieved at all."""
    gain = F.sum(F.when(relevant & (rank <= k), 1.0 / F.log2(rank + 1.0)).otherwise(0.0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(k), F.sum(relevant.cast("int")).cast("int")))), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    return F.when(F.sum(relevant.cast("int")) > 0, gain / ideal).otherwise(F.lit(0.0))


def per_question(hits: DataFrame, keys: list[str], cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row per keys (question, method): first relevant rank, hit@1 and hit@k, reciprocal rank, nDCG@k.

    hits(keys, rank, relevant) in any order; a single aggregation.
    """
    rank, relevant = F.col("rank"), F.coalesce(F.col("relevant"), F.lit(False))
    first = F.min(F.when(relevant, rank))
    out = [first.alias("first_rank"), F.coalesce((first == 1).cast("double"), F.lit(0.0)).alias("hit_1"), F.coalesce(1.0 / first, F.lit(0.0)).alias("rr")]
    for k in cuts:
        out.append(F.max((relevant & (rank <= k)).cast("double")).alias(f"hit_{k}"))
        out.append(ndcg(rank, relevant, k).alias(f"ndcg_{k}"))
    return hits.groupBy(*keys).agg(*out)


def recall_at(hits: DataFrame, keys: list[str], gold: Column, k: int) -> DataFrame:
    """(keys, recall): matched gold ids among the first k over all gold ids; without any match the relevant hits over the gold ids; without gold ids hit@k."""
    inside = F.col("rank") <= k
    matched = F.size(F.array_intersect(F.array_distinct(gold), F.collect_set(F.when(inside, F.col("chunk_id")))))
    n = F.size(F.array_distinct(gold))
    hit = F.coalesce(F.max((F.col("relevant") & inside).cast("double")), F.lit(0.0))
    some = F.sum((F.col("relevant") & inside).cast("int"))
    return hits.groupBy(*keys, gold.alias("_gold")).agg(F.when(n == 0, hit).when(matched > 0, matched / n).otherwise(F.least(F.lit(1.0), some / n)).alias("recall")).drop("_gold")


def report(evals: DataFrame, questions: DataFrame, key: str, groups: list[str], metrics: list[str]) -> DataFrame:
    """Means over all questions: those without a row count as 0 and stay in the denominator."""
    joined = questions.join(evals, key, "left")
    return joined.groupBy(*groups).agg(F.count("*").alias("questions"), *[F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(m) for m in metrics])


def two_tiers(evals: DataFrame, questions: DataFrame, key: str, covered: Column, metrics: list[str]) -> DataFrame:
    """The report over all questions and over those that `covered` holds for, side by side."""
    tier = questions.withColumn("tier", F.explode(F.when(covered, F.array(F.lit("all"), F.lit("covered"))).otherwise(F.array(F.lit("all")))))
    return report(evals, tier, key, ["tier"], metrics)


def breakdown(evals: DataFrame, questions: DataFrame, key: str, dimensions: list[str], metrics: list[str]) -> DataFrame:
    """(dimension, value, questions, metrics): the report by each dimension alone, from one pass over the joined rows."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    wide = questions.withColumn("_d", F.explode(pairs)).select(key, "_d.dimension", "_d.value")
    return report(evals, wide, key, ["dimension", "value"], metrics)


def abstention(predictions: DataFrame, questions: DataFrame, key: str, answer: Column, loose: list[str], strict: list[str]) -> DataFrame:
    """Share of questions without an answer that were declined, by a wide and by a narrow list of phrases; none given counts as not declined."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    says = lambda words: reduce(lambda a, w: a | F.contains(low, F.lit(w)), words, F.lit(False))
    marked = questions.join(predictions, key, "left")
    return marked.agg(F.count("*").alias("questions"), F.avg(says(loose).cast("double")).alias("loose"), F.avg(says(strict).cast("double")).alias("strict"))


def shares(df: DataFrame, label: str) -> DataFrame:
    """(label, n, percent) of a column's values; the total is taken over one row for each value."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("whole"))
    return n.join(F.broadcast(whole)).select(label, "n", F.round(100.0 * F.col("n") / F.col("whole"), 2).alias("percent"))


def upper_median(values: Column) -> Column:
    """An aggregate: the element at n div 2 of the sorted values."""
    ordered = F.sort_array(F.collect_list(values))
    return F.try_element_at(ordered, (F.size(ordered) / 2).cast("int") + 1)


def size_statistics(chunks: DataFrame, keys: list[str], size: str = "token_count", fragmented: str | None = None) -> DataFrame:
    """n, min, max, mean (2 digits), upper median, and the number and share of fragmented chunks, per keys.

    The median comes from counts per size, so no group's values are gathered in one row.
    """
    counted = chunks.groupBy(*keys, F.col(size).alias("_size")).agg(F.count("*").alias("_n"), F.sum(F.col(fragmented).cast("int") if fragmented else F.lit(0)).alias("_bad"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    below = F.sum("_n").over(w.orderBy("_size").rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("_upto", below).withColumn("_total", F.sum("_n").over(w))
    median = F.min(F.when(F.col("_upto") > F.floor(F.col("_total") / 2), F.col("_size")))
    n = F.sum("_n")
    return counted.groupBy(*keys).agg(
        n.alias("n"),
        F.min("_size").cast("long").alias("smallest"),
        F.max("_size").cast("long").alias("largest"),
        F.round(F.sum(F.col("_size") * F.col("_n")) / n, 2).alias("mean"),
        median.cast("long").alias("upper_median"),
        F.sum("_bad").alias("fragmented"),
        F.round(F.sum("_bad") / n, 4).alias("fragmented_share"),
    )
