"""Whether a hit answers a question, whether an answer is right, and what is shown to a model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text, vocab
from ledgerloom.operators import multisets, patterns
from ledgerloom.operators.joins import checked_join


def _share(needles: Column, haystack: Column) -> Column:
    """Share of the strings that a text holds, case aside; 1 for none."""
    low = F.lower(F.coalesce(haystack, F.lit("")))
    n = F.size(F.coalesce(needles, F.array().cast("array<string>")))
    found = F.size(F.filter(needles, lambda k: F.contains(low, F.lower(k))))
    return F.when(n > 0, found / n).otherwise(F.lit(1.0))


def _some(needles: Column, haystack: Column) -> Column:
    """Whether a text holds one of the strings, case aside; false for none."""
    low = F.lower(F.coalesce(haystack, F.lit("")))
    return F.coalesce(F.exists(needles, lambda k: (F.length(k) > 0) & F.contains(low, F.lower(k))), F.lit(False))


def level_threshold(level: Column, which: int) -> Column:
    """Of a level, the share of numbers (0) or keywords (1) that is asked for, or the least containment (2)."""
    out = F.lit(vocab.LEVELS["L1"][which])
    for name, values in vocab.LEVELS.items():
        out = F.when(level == name, F.lit(values[which])).otherwise(out)
    return out


def ticker_agrees(gold: Column, own: Column) -> Column:
    """Tickers are equal in upper case; a question without one asks nothing."""
    return gold.isNull() | (F.upper(gold) == F.upper(own))


def years_agree(level: Column, gold_years: Column, own_years: Column, gold_document: Column, own_document: Column) -> Column:
    """L4 and hits of the same document pass, and where either side has no years; else some year is common."""
    none = lambda y: y.isNull() | (F.size(y) == 0)
    a, b = F.lower(F.coalesce(gold_document, F.lit(""))), F.lower(F.coalesce(own_document, F.lit("")))
    same = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    return (level == "L4") | same | none(gold_years) | none(own_years) | F.coalesce(F.arrays_overlap(gold_years, own_years), F.lit(False))


def pages_agree(gold_pages: Column, own_pages: Column) -> Column:
    """Some page is common; a question without pages asks nothing."""
    return gold_pages.isNull() | (F.size(gold_pages) == 0) | F.coalesce(F.arrays_overlap(gold_pages, own_pages), F.lit(False))


def is_relevant(hits: DataFrame) -> DataFrame:
    """hits with `relevant`.

    hits(answerable, difficulty, gold_ids, chunk_id, keywords, numbers, content, gold_ticker, ticker, gold_years,
    period_years, gold_document, document_id, gold_pages, source_pages). Never for questions without an answer; by id
    if at least one keyword or number of the question is in the text; else by ticker, year, keywords and page together.
    """
    ids = F.transform("gold_ids", text.chunk_key)
    plain = F.transform("numbers", lambda x: F.regexp_replace(text.normalize_number(x), "^-", ""))
    some = _some(F.col("keywords"), F.col("content")) | _some(plain, text.drop_thousands(F.col("content")))
    by_id = F.coalesce(F.array_contains(ids, text.chunk_key(F.col("chunk_id"))), F.lit(False)) & some
    enough = _share(F.col("keywords"), F.col("content")) >= level_threshold(F.col("difficulty"), 1)
    by_fields = (
        ticker_agrees(F.col("gold_ticker"), F.col("ticker"))
        & years_agree(F.col("difficulty"), F.col("gold_years"), F.col("period_years"), F.col("gold_document"), F.col("document_id"))
        & enough
        & pages_agree(F.col("gold_pages"), F.col("source_pages"))
    )
    asked = F.coalesce("answerable", F.lit(True)) & (F.coalesce("difficulty", F.lit("L1")) != "L5")
    return hits.withColumn("relevant", asked & F.coalesce(by_id | by_fields, F.lit(False)))


def pool_satisfies(level: Column, numbers: Column, keywords: Column, pooled: Column) -> Column:
    """Whether the pooled text of the first hits has the level's shares of a question's numbers and keywords."""
    return (_share(numbers, text.drop_thousands(pooled)) >= level_threshold(level, 0)) & (_share(keywords, pooled) >= level_threshold(level, 1))


def map_gold(questions: DataFrame, chunks: DataFrame, query: str, item: str, evidence: Column, content: Column) -> DataFrame:
    """questions with `chunk_ids`, `best` and `coverage`: the chunks that answer each of them.

    questions(query, difficulty, keywords, expected; evidence over them), chunks(item; content over them). A chunk answers
    if it has the level's least containment of the evidence's tokens, numbers without thousands commas, or else all of the
    keywords, case aside; a match by keywords alone raises the best containment to the level's least. Coverage is full from
    the expected number of chunks on, partial below. L5 asks for nothing: no chunks, none, 0.
    """
    least = level_threshold(F.col("difficulty"), 2)
    asked = questions.filter("difficulty <> 'L5'")
    tokens = lambda c: text.tokens(text.drop_thousands(F.coalesce(c, F.lit(""))))
    found = multisets.containment(asked.withColumn("least", least), query, chunks, item, tokens(evidence), tokens(content), best=1, least="least")
    words = asked.select(query, F.explode(F.array_distinct(F.transform("keywords", lambda k: F.lower(text.drop_thousands(k))))).alias("word")).filter("word <> ''")
    held = patterns.holding(chunks, item, F.lower(text.drop_thousands(F.coalesce(content, F.lit("")))), words.select("word").distinct(), "word", F.col("word"))
    wanted = words.groupBy(query).agg(F.count("*").alias("wanted"))
    worded = checked_join(checked_join(held, words, ["word"]).groupBy(query, item).agg(F.count("*").alias("got")), wanted, [query]).filter("got = wanted").select(query, item, F.lit(True).alias("worded"))
    both = found.join(worded, [query, item], "full_outer").withColumn("containment", F.coalesce("containment", F.lit(0.0)))
    both = checked_join(both, asked.select(query, least.alias("least")), [query])
    by_words = F.coalesce("worded", F.lit(False))
    figures = both.groupBy(query).agg(
        F.array_sort(F.collect_list(F.when((F.col("containment") >= F.col("least")) | by_words, F.col(item)))).alias("chunk_ids"),
        F.max(F.when(by_words, F.greatest("containment", "least")).otherwise(F.col("containment"))).alias("best"),
    )
    ids = F.coalesce("chunk_ids", F.array().cast(figures.schema["chunk_ids"].dataType))
    n = F.size(ids)
    coverage = F.when(F.col("difficulty") == "L5", "none").when(n >= F.col("expected"), "full").when(n > 0, "partial").otherwise("none")
    return questions.join(figures, query, "left").select(*questions.columns, ids.alias("chunk_ids"), F.coalesce("best", F.lit(0.0)).alias("best"), coverage.alias("coverage"))


def _near(v: Column, g: Column) -> Column:
    """Values alike as they are, or as one is the percentage of the other."""
    close = lambda a, least: (F.abs(a - g) < least) | ((g != 0) & (F.abs(a - g) / F.abs(g) < 0.025))
    return close(v, 0.015) | close(v / 100, 0.005) | close(v * 100, 0.5)


def _content_words(c: Column) -> Column:
    return F.array_distinct(F.filter(text.tokens(c), lambda w: (F.length(w) > 2) & ~w.isin(*vocab.STOPWORDS_EN)))


def answer_class(answer: Column, gold: Column) -> Column:
    """Correct, Refusal or Incorrect.

    Correct by a number alike, by the gold answer within the answer if it has more than three characters, or by two or
    more content words of which enough are common (0.55, or 0.35 where both say yes or both no); then refusals.
    """
    low, want = F.lower(F.trim(F.coalesce(answer, F.lit("")))), F.lower(F.trim(F.coalesce(gold, F.lit(""))))
    # a number ends where its text does: unit words and marks aside
    values = lambda c: F.filter(F.transform(F.regexp_extract_all(F.regexp_replace(c, r"(?<=\d),(?=\d{3}\b)", ""), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    number = F.try_element_at(values(want), F.lit(1))
    numeric = number.isNotNull() & F.exists(values(low), lambda v: _near(v, number))
    within = (F.length(want) > 3) & F.contains(low, want)
    mine, theirs = _content_words(low), _content_words(want)
    overlap = F.size(F.array_intersect(mine, theirs)) / F.greatest(F.lit(1), F.size(theirs))
    says = lambda c, w: c.rlike(rf"^\W*{w}\b")
    agree = (says(low, "yes") & says(want, "yes")) | (says(low, "no") & says(want, "no"))
    worded = (F.size(theirs) >= 2) & ((overlap >= 0.55) | (agree & (overlap >= 0.35)))
    declines = reduce(lambda a, w: a | F.contains(low, F.lit(w)), vocab.REFUSALS, F.lit(False))
    return F.when(F.coalesce(numeric | within | worded, F.lit(False)), "Correct").when(declines, "Refusal").otherwise("Incorrect")


def is_refusal(answer: Column, words: int = 35) -> Column:
    """A short answer that begins by declining; it needs no judge."""
    low = F.lower(F.trim(F.coalesce(answer, F.lit(""))))
    short = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != "")) < words
    return short & low.rlike(r"^\W*(i\s+(cannot|can't|am unable)|unable to|the (context|documents?|excerpts?) (do|does)(es)? not|not enough information|no information|insufficient|cannot)")


def judge_label(raw: Column) -> Column:
    """A judge's label in its normal form; Incorrect for anything else."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(F.contains(low, F.lit("refus")), "Refusal").when(low.rlike(r"\bincorrect\b|\bwrong\b"), "Incorrect").when(low.rlike(r"\bcorrect\b"), "Correct").otherwise("Incorrect")


def context_of(hits: DataFrame, query: str, most: int = 5, cut: int | None = 2000) -> DataFrame:
    """(query, context): the first hits in order, each under a line with its document and page, texts cut at `cut` characters."""
    body = F.substring("content", 1, cut) if cut else F.col("content")
    part = F.concat(F.lit("[Document: "), F.coalesce("document_id", F.lit("?")), F.lit(" | Page: "), F.coalesce(F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ", "), F.lit("?")), F.lit("]\n"), body)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("rank"), part.alias("part"))))
    return hits.filter(F.col("rank") <= most).groupBy(query).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("context"))
