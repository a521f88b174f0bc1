"""Reports over pages, chunks and runs, and lookups between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATIOS = ("text_recall", "text_precision", "numeric_recall", "numeric_precision")


def counts(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, column, n): engines, classes or states of pages."""
    return df.groupBy(*keys, column).agg(F.count("*").alias("n"))


def quality_report(results: DataFrame, keys: list[str]) -> DataFrame:
    """Pages and mean ratios per keys; pages without a ratio don't count for it, 0 where none has it."""
    return results.groupBy(*keys).agg(F.count("*").alias("pages"), *[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("pass", "warning", "fail")], *[F.round(F.coalesce(F.avg(r), F.lit(0.0)), 6).alias(r) for r in RATIOS])


def quality_comparison(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Mean ratios of two runs side by side and their difference, per keys of either run."""
    a, b = quality_report(old, keys), quality_report(new, keys)
    joined = a.select(*keys, *[F.col(r).alias(f"old_{r}") for r in RATIOS]).join(b.select(*keys, *[F.col(r).alias(f"new_{r}") for r in RATIOS]), keys, "full")
    return joined.select("*", *[F.round(F.col(f"new_{r}") - F.col(f"old_{r}"), 6).alias(f"{r}_change") for r in RATIOS])


def page_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, method, page, chunks, tokens, fragmented): which chunks have a page, by method."""
    paged = chunks.select(*keys, "method", "token_count", "fragmented", F.explode("source_pages").alias("page"))
    return paged.groupBy(*keys, "method", "page").agg(F.count("*").alias("chunks"), F.sum("token_count").cast("long").alias("tokens"), F.max("fragmented").alias("fragmented"))


def chunks_on_page(chunks: DataFrame, document: str, page: int) -> DataFrame:
    """The chunks of one page of a document."""
    return chunks.filter((F.col("document_id") == document) & F.array_contains("source_pages", page))


def notes_directory(headings: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, code, title): each note's number with its first title."""
    code = F.regexp_extract("text", r"(?i)^(?:note|thuyết\s+minh)\s*(\d+[a-z]?)", 1)
    return headings.withColumn("code", code).filter("code <> ''").groupBy(*keys, "code").agg(F.min_by("text", position).alias("title"))


def contents(headings: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, place, text): distinct headings in the order of their first place."""
    first = headings.groupBy(*keys, "text").agg(F.min(position).alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "text"))).drop("_at")


def hit_rates(hits: DataFrame, questions: DataFrame, key: str, cuts: tuple[int, ...] = (1, 2, 4, 8), mrr: int = 4) -> DataFrame:
    """Hit@k, MRR and the rate of right documents over all questions; hits(key, rank, relevant, same_document, latency).

    Questions without hits count as misses. The mean latency is that of the questions that have one.
    """
    per = hits.groupBy(key).agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.max(F.col("same_document").cast("int")).alias("document"), F.max("latency").alias("latency"))
    all_ = questions.select(key).distinct().join(per, key, "left")
    rate = lambda c: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 6)
    first: Column = F.col("first")
    return all_.agg(F.count("*").alias("questions"), *[rate(first <= k).alias(f"hit_{k}") for k in cuts], rate(F.when(first <= mrr, 1.0 / first)).alias(f"mrr_{mrr}"), rate(F.col("document")).alias("document_hit"), F.round(F.avg("latency"), 6).alias("latency"))


def benchmark(methods: dict[str, DataFrame], judge, questions: DataFrame, key: str, metrics_of, report_of) -> DataFrame:
    """One report for all methods: their hits united under a `method` column, judged, measured and reported in one job.

    judge(hits) adds `relevant`; metrics_of(hits, keys) gives a row per question and method; report_of(evals, questions)
    the means by method, over all questions.
    """
    union = None
    for name, hits in methods.items():
        part = hits.withColumn("method", F.lit(name))
        union = part if union is None else union.unionByName(part, allowMissingColumns=True)
    evals = metrics_of(judge(union), [key, "method"])
    asked = questions.select(key).crossJoin(F.broadcast(evals.sparkSession.createDataFrame([(m,) for m in methods], "method string")))
    return report_of(asked.join(evals, [key, "method"], "left"))
