"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

The documents of a source, in hash order, are one stream of tokens that is cut into blocks of equal token counts. A source
weighs as many slots as its target takes blocks. Slot i of the schedule is the i-th van der Corput point in base 2, mapped
through the cumulative weights of the sources: with 2**m slots the points are the whole numbers below 2**m with their bits
reversed, so the slots of a source follow from its own interval, without a search. Slots are ranked per source, and the
r-th slot of a source takes its block r modulo the number of blocks. A source ends with the slot that fills its target,
the last block cut to the token. Any stretch of the schedule has each source's share of the slots up to a logarithm.

Nothing is gathered by source: prefix sums run over hash buckets of about BUCKET_DOCS documents and over chunks of
CHUNK slots first, then over one row for each bucket or chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm._util import forget, join_small, materialize, shuffle_partitions

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix over words of the corpus, and most repeats of a source.
TOTAL, MOST = 1.5, 2
#: Tokens of a block; a source has MIN_BLOCKS blocks at least, if it has so many tokens.
BLOCK_TOKENS, MIN_BLOCKS = 4096, 64
BUCKET_DOCS, CHUNK = 1024, 4096

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size): words of every row; null texts have none."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: key, source_size, n_docs, target, words (target in whole words) and the shape of its blocks and slots.

    The windows below run over one row for each source, summed up before.
    """
    per = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("asked", F.sum("source_size").over(everything) * F.lit(TOTAL)).withColumn("weights", F.sum("weight").over(everything))
    left = F.col("asked") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("full", left * F.col("weight") >= F.col("cap") * heavy)
    rest = F.col("asked") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    share = rest * F.col("weight") / F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(everything)
    per = per.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share))
    per = per.withColumn("words", F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("cap")))
    per = per.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_TOKENS), F.ceil(F.col("source_size") / MIN_BLOCKS))).cast("long"))
    per = per.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    whole = F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0))
    per = per.withColumn("passes", whole.cast("long")).withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    per = per.withColumn("slots", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / F.col("block")).cast("long"))
    end = F.sum("slots").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumn("end", end).withColumn("begin", F.col("end") - F.col("slots"))
    return per.drop("asked", "weights", "full", "cap")


def schedule(sources: DataFrame) -> DataFrame:
    """(slot, key, rank, block_no, lo, hi): which tokens of its source's block each slot of the mix takes, in order of `slot`."""
    total = sources.agg(F.coalesce(F.max("end"), F.lit(0))).first()[0]
    bits = max(1, int(total - 1).bit_length())
    points = sources.filter("end > begin").withColumn("part", F.explode(F.expr(f"sequence(begin div {CHUNK}, (end - 1) div {CHUNK})"))).repartition(F.col("part"))
    points = points.withColumn("point", F.explode(F.expr(f"sequence(greatest(begin, part * {CHUNK}), least(end, (part + 1) * {CHUNK}) - 1)")))
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    owned = points.withColumn("slot", slot).withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    owned = materialize(owned.select("slot", "chunk", "key", "slots", "block", "n_blocks", "passes", "rest", "source_size"), "slots", int(total))
    counts = owned.groupBy("key", "chunk").count()
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = owned.join(counts.withColumn("earlier", earlier).drop("count"), ["key", "chunk"])
    ranked = ranked.withColumn("rank", F.col("earlier") + F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1)
    ranked = ranked.withColumn("block_no", F.col("rank") % F.col("n_blocks"))
    last = F.when(F.expr("rank div n_blocks = passes"), F.least("source_size", "rest")).otherwise(F.col("source_size"))
    lo = F.col("block_no") * F.col("block")
    return ranked.select("slot", "key", "rank", "block_no", lo.alias("lo"), F.least(lo + F.col("block"), last).alias("hi")).filter("hi > lo")


def streams(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with `start`, the place of each document's first token in its source's shuffled stream, and the source's figures."""
    rows = join_small(rows, sources.select("key", "source_size", "n_docs", "target", "block"), ["key"])
    spot = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("size").cast("string"))), 1, 13), 16, 10).cast("long")
    rows = rows.withColumn("spot", spot).withColumn("bucket", F.floor(F.col("spot") / F.lit(float(1 << 52)) * F.ceil(F.col("n_docs") / BUCKET_DOCS)).cast("long"))
    rows = materialize(rows, "rows")
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    earlier = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("key", "bucket").orderBy("spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sums.withColumn("earlier", earlier).drop("words"), ["key", "bucket"])
    return placed.withColumn("start", F.col("earlier") + within).select("doc_id", "key", "size", "source_size", "target", "block", "start")


def _placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's place in its source's stream, and the schedule."""
    rows = materialize(sizes(docs), "sizes")
    size = rows.count()
    sources = materialize(targets(rows), "sources", size)
    placed, plan = materialize(streams(rows, sources), "placed", size), materialize(schedule(sources), "schedule", size)
    forget(rows, sources)
    return placed, plan


def _taken(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) by the blocks of the schedule that overlap with each document."""
    visits = plan.select("key", "block_no", "lo", "hi")
    parts = placed.filter("size > 0").withColumn("block_no", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")))
    overlap = F.greatest(F.lit(0).cast("long"), F.least(F.col("start") + F.col("size"), F.col("hi")) - F.greatest("start", "lo"))
    taken = parts.join(visits.hint("merge"), ["key", "block_no"], "left").groupBy("key", "start", "doc_id", "size", "source_size", "target").agg(F.sum(F.when(F.col("hi").isNull(), F.lit(0)).otherwise(overlap)).alias("taken"))
    empty = placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long"))
    names = ["key", "start", "doc_id", "size", "source_size", "target", "taken"]
    return taken.select(*names).unionByName(empty.select(*names))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs(doc_id, text, source); other columns are ignored.

    `taken` is the number of words of the document in the mix, repeats counted: at most twice `size`. All taken words of
    a source together are its target to the nearest word. A null source is a source, the last one; null and wordless
    texts have size 0 and take nothing; rows that repeat are documents of their own, and rows alike in doc_id and size
    are interchangeable. Reruns give the same rows.
    """
    return _taken(*_placed(docs)).drop("key", "start")


def mixed_documents(docs: DataFrame, with_slot: bool = False) -> DataFrame:
    """The mix itself, in the order of the schedule: each row of docs as often as it is taken whole, and once more cut to
    the words left over, if any.

    A document stands at the slot of the block in which its pass through the source's stream reaches its first word; rows
    are range-partitioned and sorted by that slot (and the place in the stream), so any prefix of the mix has each source
    near its share; `slot` is returned if asked for. The cut row has its first words, joined by single spaces; it occurs
    where a source's target ends. Rows alike in doc_id and size take the same places in turn. All columns stay; n_chars,
    if there, fits the cut text.
    """
    placed, plan = _placed(docs)
    taken = _taken(placed, plan).filter("taken > 0").select("key", "start", "doc_id", "size", "taken")
    # rows alike in doc_id and size share what they take evenly, rounded down, and stand where the first of them stands
    alike = taken.groupBy("key", "doc_id", "size").agg(F.expr("sum(taken) div count(*)").alias("taken"), F.min("start").alias("start")).filter("taken > 0")
    alike = join_small(alike, placed.select("key", "block", "source_size").distinct(), ["key"], "inner")
    alike = alike.withColumn("_pass", F.explode(F.expr("sequence(1, (taken + size - 1) div size)")))
    rank = (F.col("_pass") - 1) * F.ceil(F.col("source_size") / F.col("block")) + F.expr("start div block")
    alike = alike.withColumn("rank", rank.cast("long")).join(plan.select("key", "rank", "slot"), ["key", "rank"])
    alike = alike.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "start", "slot", (F.col("taken") - (F.col("_pass") - 1) * F.col("size")).alias("_left"))
    alike = materialize(alike.withColumnRenamed("start", "_start").withColumnRenamed("slot", "_slot"), "order", 2 * docs.count())
    forget(placed, plan)
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null"))
    both = docs.withColumn("_words", size).join(alike.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_words") == F.col("_size")) & (key == F.col("_key")))
    both = both.repartitionByRange(shuffle_partitions(docs.sparkSession), "_slot", "_start").sortWithinPartitions("_slot", "_start", "doc_id")
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_left").cast("int")), " ")
    short = F.col("_left") < F.col("_size")
    both = both.withColumn("text", F.when(short, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(short, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return both.select(*docs.columns, *([F.col("_slot").alias("slot")] if with_slot else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: what the mix takes of every document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same result in closed form: passes over a source's stream and what is left of its target at the stream's start.
SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS n, 2 * sum(size) AS cap, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source
), o AS (
  SELECT *, sum(n) OVER () * 1.5 AS asked, sum(w) OVER () AS heavy,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    coalesce(sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lighter FROM s
), f AS (
  SELECT *, (asked - before) * w >= cap * (heavy - lighter) AS at_cap FROM o
), t AS (
  SELECT source, n, CAST(CASE WHEN at_cap THEN cap ELSE (asked - sum(CASE WHEN at_cap THEN cap ELSE 0 END) OVER ()) * w / sum(CASE WHEN at_cap THEN 0 ELSE w END) OVER () END AS DOUBLE) AS target FROM f
), p AS (
  SELECT d.*, CAST(t.n AS BIGINT) AS source_size, t.target, least(CAST(floor(t.target + 0.5) AS BIGINT), 2 * CAST(t.n AS BIGINT)) AS words,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(md5(concat_ws('-', doc_id, size)), 1, 13), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(start + size, words % source_size) - start) END AS BIGINT) AS taken
FROM p
"""
