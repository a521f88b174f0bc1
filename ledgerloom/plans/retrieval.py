"""Registered queries over search and metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import metrics, multisets, patterns, relevance, search
from ledgerloom.operators.joins import small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"

# --- lexical -------------------------------------------------------------------------------------------------------


def lexical_topk(spark, sf_dir, k=10):
    """Every benchmark passage against all documents by BM25."""
    return search.lexical_topk(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k)


BM25 = f"""
d AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
n AS (SELECT count(*) AS n, avg(len({TOKENS})) AS mean FROM documents),
size AS (SELECT doc_id, len({TOKENS}) AS size FROM documents),
q AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark),
tf AS (SELECT d.term, d.doc_id, count(*) AS tf FROM d WHERE d.term IN (SELECT term FROM q) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scored AS (
  SELECT q.item_id, tf.doc_id,
    round(sum(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * size.size / n.mean))), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN size USING (doc_id), n GROUP BY 1, 2),
hits AS (
  SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10)
"""
LEXICAL_TOPK = f"WITH {BM25} SELECT item_id, doc_id, score, rank FROM hits"


def _judged(spark, sf_dir):
    """Lexical hits with `relevant`: the document has the passage verbatim."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = lexical_topk(spark, sf_dir)
    marked = hits.join(docs.select("doc_id", "text"), "doc_id").join(small(items.select("item_id", F.col("text").alias("passage"))), "item_id")
    return marked.select("item_id", F.col("doc_id").cast("string").alias("chunk_id"), "rank", F.contains("text", "passage").alias("relevant"))


JUDGED = f"""{BM25},
judged AS (SELECT h.item_id, h.doc_id, h.rank, contains(d.text, b.text) AS relevant FROM hits h JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))
"""


def lexical_hit_metrics(spark, sf_dir):
    """Hit@1, hit@5, hit@10, reciprocal rank and nDCG@10 of each passage."""
    found = metrics.per_question(_judged(spark, sf_dir), ["item_id"], (5, 10))
    return found.select("item_id", "first_rank", "hit_1", "hit_5", "hit_10", F.round("rr", 6).alias("rr"), F.round("ndcg_10", 6).alias("ndcg_10"))


PER_QUESTION = f"""{JUDGED},
g AS (SELECT item_id, min(rank) FILTER (relevant) AS first_rank, count(*) FILTER (relevant) AS n,
        sum(CASE WHEN relevant THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM judged GROUP BY 1),
ideal AS (SELECT k, sum(1 / log2(i + 1.0)) AS idcg FROM range(1, 11) a(k), range(1, 11) b(i) WHERE i <= k GROUP BY 1),
per AS (
  SELECT item_id, first_rank, CAST(coalesce(first_rank = 1, false) AS DOUBLE) AS hit_1, CAST(coalesce(first_rank <= 5, false) AS DOUBLE) AS hit_5,
    CAST(coalesce(first_rank <= 10, false) AS DOUBLE) AS hit_10, round(coalesce(1.0 / first_rank, 0), 6) AS rr, round(coalesce(dcg / idcg, 0), 6) AS ndcg_10
  FROM g LEFT JOIN ideal ON ideal.k = least(g.n, 10))
"""


def two_tier_report(spark, sf_dir):
    """Means over all passages and over those that some document has."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    held = patterns.holding(docs, "doc_id", F.col("text"), items, "item_id", F.col("text")).select("item_id").distinct().withColumn("held", F.lit(True))
    questions = items.join(held, "item_id", "left").select("item_id", F.coalesce("held", F.lit(False)).alias("held"))
    out = metrics.two_tiers(lexical_hit_metrics(spark, sf_dir), questions, "item_id", F.col("held"), ["hit_1", "hit_5", "hit_10", "rr", "ndcg_10"])
    return out.select("tier", "questions", *[F.round(m, 5).alias(m) for m in ("hit_1", "hit_5", "hit_10", "rr", "ndcg_10")])


_MEANS = ", ".join(f"round(avg(coalesce({m}, 0)), 5) AS {m}" for m in ("hit_1", "hit_5", "hit_10", "rr", "ndcg_10"))
TWO_TIERS = f"""WITH {PER_QUESTION},
held AS (SELECT DISTINCT b.item_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
asked AS (SELECT item_id, 'all' AS tier FROM benchmark UNION ALL SELECT item_id, 'covered' FROM held)
SELECT tier, count(*) AS questions, {_MEANS} FROM asked LEFT JOIN per USING (item_id) GROUP BY tier"""


def _graded(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    return items.select("item_id", F.concat(F.lit("L"), (F.col("item_id") % 5 + 1).cast("string")).alias("difficulty"), F.when(F.length("text") > 200, "long").otherwise("short").alias("kind"))


def metric_breakdown(spark, sf_dir):
    """Means by difficulty and by kind of question, from one pass."""
    out = metrics.breakdown(lexical_hit_metrics(spark, sf_dir), _graded(spark, sf_dir), "item_id", ["difficulty", "kind"], ["hit_10", "rr"])
    return out.select("dimension", "value", "questions", F.round("hit_10", 5).alias("hit_10"), F.round("rr", 5).alias("rr"))


BREAKDOWN = f"""WITH {PER_QUESTION},
asked AS (SELECT item_id, 'difficulty' AS dimension, 'L' || (item_id % 5 + 1) AS value FROM benchmark
      UNION ALL SELECT item_id, 'kind', CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END FROM benchmark)
SELECT dimension, value, count(*) AS questions, round(avg(coalesce(hit_10, 0)), 5) AS hit_10, round(avg(coalesce(rr, 0)), 5) AS rr
FROM asked LEFT JOIN per USING (item_id) GROUP BY 1, 2"""


def pooled_text(spark, sf_dir):
    """The texts of the three best hits of each passage, joined in order, by their length and digest."""
    docs = table(spark, sf_dir, "documents")
    from ledgerloom.operators import windows

    hits = lexical_topk(spark, sf_dir).filter("rank <= 3").join(docs.select("doc_id", "text"), "doc_id")
    pooled = windows.joined_in_order(hits, ["item_id"], "rank", "text", "\n")
    return pooled.select("item_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


POOLED = f"""WITH {BM25} SELECT item_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM (
  SELECT item_id, string_agg(d.text, chr(10) ORDER BY rank) AS t FROM hits JOIN documents d USING (doc_id) WHERE rank <= 3 GROUP BY 1)"""

# --- containment ---------------------------------------------------------------------------------------------------


def containment_topk(spark, sf_dir, k=3):
    """The documents that hold most of each passage's tokens."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = multisets.containment(items, "item_id", docs, "doc_id", text.tokens(F.col("text")), text.tokens(F.col("text")), best=k)
    return search.ranked(found.withColumn("containment", F.round("containment", 6)), "item_id", "doc_id", k, "containment")


CONTAINMENT = f"""WITH
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({TOKENS}) AS t FROM benchmark) GROUP BY 1, 2),
d AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest({TOKENS}) AS t FROM documents) GROUP BY 1, 2),
size AS (SELECT item_id, sum(c) AS n FROM q GROUP BY 1),
m AS (SELECT q.item_id, d.doc_id, round(sum(least(q.c, d.c)) / any_value(size.n), 6) AS containment FROM q JOIN d USING (t) JOIN size USING (item_id) GROUP BY 1, 2)
SELECT item_id, doc_id, containment, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY containment DESC, doc_id) AS rank FROM m) WHERE rank <= 3"""


def gold_mapping(spark, sf_dir):
    """Documents that answer a passage, by its level's containment or by all of its keywords, and how well it is covered."""
    words = F.filter(F.array_distinct(text.tokens(F.col("text"))), lambda w: F.length(w) >= 9)
    items = _graded(spark, sf_dir).join(table(spark, sf_dir, "benchmark"), "item_id").withColumn("keywords", F.slice(words, 1, 4))
    items = items.withColumn("expected", text.expected_chunks(F.col("difficulty")))
    found = relevance.map_gold(items, table(spark, sf_dir, "documents"), "item_id", "doc_id", F.col("text"), F.col("text"))
    return found.select("item_id", "difficulty", F.col("expected").cast("long").alias("expected"), F.size("chunk_ids").cast("long").alias("matches"), F.round("best", 6).alias("best"), "coverage")


_PLAIN = r"regexp_replace(regexp_replace(coalesce(text, ''), '(\d),(\d{3})\b', '\1\2', 'g'), '(\d),(\d{3})\b', '\1\2', 'g')"
_PLAIN_TOKENS = TOKENS.replace("coalesce(text, '')", _PLAIN)
GOLD = rf"""WITH
b AS (SELECT item_id, text, 'L' || (item_id % 5 + 1) AS difficulty FROM benchmark),
e AS (SELECT *, CAST(CASE difficulty WHEN 'L5' THEN 0 WHEN 'L4' THEN 3 WHEN 'L3' THEN 2 ELSE 1 END AS BIGINT) AS expected,
  CASE difficulty WHEN 'L1' THEN 0.4 WHEN 'L2' THEN 0.5 WHEN 'L3' THEN 0.45 ELSE 0.35 END AS least FROM b),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_PLAIN_TOKENS}) AS t FROM e WHERE difficulty <> 'L5') GROUP BY 1, 2),
d AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest({_PLAIN_TOKENS}) AS t FROM documents) GROUP BY 1, 2),
size AS (SELECT item_id, sum(c) AS n FROM q GROUP BY 1),
m AS (SELECT q.item_id, d.doc_id, sum(least(q.c, d.c)) / any_value(size.n) AS containment FROM q JOIN d USING (t) JOIN size USING (item_id) GROUP BY 1, 2),
k0 AS (SELECT item_id, unnest(range(1, len(ts) + 1)) AS p, ts FROM (SELECT item_id, {TOKENS} AS ts FROM e WHERE difficulty <> 'L5')),
k1 AS (SELECT item_id, ts[p] AS word, min(p) AS p FROM k0 WHERE length(ts[p]) >= 9 GROUP BY 1, 2),
k AS (SELECT item_id, word FROM k1 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY p) <= 4),
n AS (SELECT item_id, count(*) AS n FROM k GROUP BY 1),
h AS (SELECT k.item_id, doc_id FROM k JOIN (SELECT doc_id, lower({_PLAIN}) AS t FROM documents) x ON contains(t, word) JOIN n USING (item_id) GROUP BY 1, 2 HAVING count(*) = any_value(n.n)),
j AS (SELECT coalesce(m.item_id, h.item_id) AS item_id, coalesce(m.doc_id, h.doc_id) AS doc_id, coalesce(containment, 0) AS containment, h.item_id IS NOT NULL AS worded FROM m FULL JOIN h ON m.item_id = h.item_id AND m.doc_id = h.doc_id),
g AS (SELECT item_id, count(*) FILTER (containment >= least OR worded) AS matches, max(CASE WHEN worded THEN greatest(containment, least) ELSE containment END) AS best FROM j JOIN e USING (item_id) GROUP BY 1)
SELECT e.item_id, difficulty, expected, coalesce(matches, 0) AS matches, round(coalesce(best, 0), 6) AS best,
  CASE WHEN difficulty = 'L5' THEN 'none' WHEN coalesce(matches, 0) >= expected THEN 'full' WHEN coalesce(matches, 0) > 0 THEN 'partial' ELSE 'none' END AS coverage
FROM e LEFT JOIN g USING (item_id)"""

# --- dense and fused -----------------------------------------------------------------------------------------------


def _vectors(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings")
    return chunks, chunks.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


DENSE = """
s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 5) AS score
      FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)
"""


def dense_topk(spark, sf_dir):
    """The ten nearest vectors of every 50th vector."""
    return search.dense_topk(*_vectors(spark, sf_dir), 10)


DENSE_TOPK = f"""WITH {DENSE} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def dense_prefiltered(spark, sf_dir):
    """The nearest of one label, filtered before ranking."""
    return search.dense_filtered(*_vectors(spark, sf_dir), F.col("label") == 3, 5, True)


DENSE_PRE = f"""WITH {DENSE} SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE label = 3) WHERE rank <= 5"""


def dense_postfiltered(spark, sf_dir):
    """The nearest of one label among the 20 best, or among the 100 best where none of these has it."""
    return search.dense_filtered(*_vectors(spark, sf_dir), F.col("label") == 3, 5, False, fetch=20, retry=100)


DENSE_POST = f"""WITH {DENSE},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s),
f AS (SELECT *, max(CASE WHEN place <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS near FROM r WHERE place <= 100 AND label = 3)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f WHERE near = 0 OR place <= 20) WHERE rank <= 5"""


def hybrid_fusion(spark, sf_dir):
    """Reciprocal rank fusion of two legs: nearest vectors, and nearest vectors by their first half."""
    chunks, queries = _vectors(spark, sf_dir)
    half = lambda c: F.slice(c, 1, 32)
    one = search.dense_topk(chunks, queries, 20)
    two = search.dense_topk(chunks.withColumn("embedding", half("embedding")), queries.withColumn("vector", half("vector")), 20)
    return search.fuse([one, two], "query_id", "vec_id", 10)


HYBRID = f"""WITH {DENSE},
h AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(CAST(q.embedding[1:32] AS DOUBLE[]), CAST(c.embedding[1:32] AS DOUBLE[])), 5) AS score
      FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0),
legs AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
         UNION ALL SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM h),
f AS (SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM legs WHERE rank <= 20 GROUP BY 1, 2)
SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM f) WHERE rank <= 10"""


def ndcg_report(spark, sf_dir):
    """nDCG@10 and hit@5 of the dense search, a hit of the query's own label being relevant."""
    chunks, _ = _vectors(spark, sf_dir)
    label = chunks.select("vec_id", "label")
    hits = dense_topk(spark, sf_dir).join(label, "vec_id").join(small(label.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))), "query_id")
    found = metrics.per_question(hits.withColumn("relevant", F.col("label") == F.col("own")), ["query_id"], (5, 10))
    return found.select("query_id", F.round("ndcg_10", 6).alias("ndcg_10"), "hit_5")


NDCG = f"""WITH {DENSE},
r AS (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.vec_id) AS rank FROM s),
j AS (SELECT r.query_id, rank, r.label = q.label AS relevant FROM r JOIN embeddings q ON q.vec_id = r.query_id WHERE rank <= 10),
ideal AS (SELECT k, sum(1 / log2(i + 1.0)) AS idcg FROM range(1, 11) a(k), range(1, 11) b(i) WHERE i <= k GROUP BY 1),
g AS (SELECT query_id, count(*) FILTER (relevant) AS n, sum(CASE WHEN relevant THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg, max(CAST(relevant AND rank <= 5 AS DOUBLE)) AS hit_5 FROM j GROUP BY 1)
SELECT query_id, round(coalesce(dcg / idcg, 0), 6) AS ndcg_10, hit_5 FROM g LEFT JOIN ideal ON ideal.k = least(g.n, 10)"""

# --- answers -------------------------------------------------------------------------------------------------------


def conversation_context(spark, sf_dir):
    """The context of each conversation: its first five turns in order under their headers, texts cut at 2,000 characters."""
    talk = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    hits = talk.select("conv_id", F.row_number().over(order).alias("rank"), F.col("role").alias("document_id"), F.array("turn").alias("source_pages"), F.coalesce("text", F.lit("")).alias("content"))
    context = relevance.context_of(hits, "conv_id")
    return context.select("conv_id", F.md5("context").alias("digest"), F.length("context").cast("long").alias("n_chars"))


CONTEXT = """SELECT conv_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n_chars FROM (
  SELECT conv_id, string_agg(part, chr(10) || chr(10) ORDER BY n) AS t FROM (
    SELECT conv_id, '[Document: ' || coalesce(role, '?') || ' | Page: ' || turn || ']' || chr(10) || substring(coalesce(text, ''), 1, 2000) AS part, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations) WHERE n <= 5 GROUP BY 1)"""


def hit_relevance(spark, sf_dir):
    """Lexical hits held against labelled questions: by id with a signal in the text, or by ticker, years, keywords and pages."""
    i, d = F.col("item_id"), F.col("doc_id")
    tickers = lambda c: F.element_at(F.array(F.lit("aapl"), F.lit("NVDA")), (c % 2 + 1).cast("int"))
    words = F.filter(F.array_distinct(text.tokens(F.col("text"))), lambda w: F.length(w) >= 6)
    items = table(spark, sf_dir, "benchmark").select(
        "item_id",
        (i % 7 != 0).alias("answerable"),
        F.concat(F.lit("L"), (i % 5 + 1).cast("string")).alias("difficulty"),
        F.array(F.concat(F.lit("Doc-"), (i * 3).cast("string")), F.concat(F.lit("doc_"), (i * 5).cast("string"))).alias("gold_ids"),
        F.when(i % 3 == 0, F.array().cast("array<string>")).otherwise(F.slice(words, 1, 5)).alias("keywords"),
        F.array(F.lit("1,234")).alias("numbers"),
        F.when(i % 4 != 0, tickers(i)).alias("gold_ticker"),
        F.when(i % 2 == 0, F.array((2020 + i % 3).cast("int"))).alias("gold_years"),
        F.lit(None).cast("string").alias("gold_document"),
        F.when(i % 6 == 0, F.array((i % 4).cast("int"), F.lit(9))).alias("gold_pages"),
    )
    hits = lexical_topk(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")
    hits = hits.withColumns({"chunk_id": F.concat(F.lit("doc "), d.cast("string")), "ticker": F.upper(tickers(d)), "period_years": F.array((2020 + d % 3).cast("int")), "document_id": F.lit("x"), "source_pages": F.array((d % 4).cast("int"))})
    return relevance.is_relevant(hits.join(small(items), "item_id")).select("item_id", "doc_id", "relevant")


RELEVANCE = rf"""WITH {BM25},
q0 AS (SELECT item_id, ts, unnest(range(1, len(ts) + 1)) AS p FROM (SELECT item_id, {TOKENS} AS ts FROM benchmark)),
q1 AS (SELECT item_id, ts[p] AS word, min(p) AS p FROM q0 WHERE length(ts[p]) >= 6 GROUP BY 1, 2),
k AS (SELECT item_id, word FROM q1 WHERE item_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY p) <= 5),
x AS (SELECT h.item_id, h.doc_id, lower(coalesce(d.text, '')) AS low, regexp_matches(coalesce(d.text, ''), '(^|[^\d])(\d*,)*\d*1,?234') AS number FROM hits h JOIN documents d USING (doc_id)),
s AS (SELECT x.item_id, x.doc_id, any_value(x.number) AS number, count(k.word) AS n, coalesce(sum(CAST(contains(x.low, k.word) AS INT)), 0) AS got FROM x LEFT JOIN k USING (item_id) GROUP BY 1, 2)
SELECT item_id, doc_id, item_id % 7 <> 0 AND item_id % 5 <> 4 AND (
    (doc_id IN (item_id * 3, item_id * 5) AND (got > 0 OR number))
    OR ((item_id % 4 = 0 OR item_id % 2 = doc_id % 2) AND (item_id % 5 = 3 OR item_id % 2 = 1 OR item_id % 3 = doc_id % 3)
      AND (CASE WHEN n = 0 THEN 1 ELSE got / n END) >= 0.6 AND (item_id % 6 <> 0 OR doc_id % 4 IN (item_id % 4, 9)))) AS relevant FROM s"""


def hybrid_search(spark, sf_dir):
    """Passages searched for by words and by vectors at once, each passage with the vector of its own number, in chunks with tables from 2021."""
    chunks = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    chunks = chunks.select("doc_id", "text", "embedding", F.array((2020 + F.col("doc_id") % 3).cast("int")).alias("period_years"), F.lit(None).cast("int").alias("fiscal_year"), (F.col("doc_id") % 4 != 0).alias("contains_table"))
    queries = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), "item_id")
    return search.search(chunks, queries, 5, mode="hybrid", strategy="pre_filter", depth=20, item="doc_id", query="item_id", fiscal_year=2021, contains_table=True)


_CHUNKS = "(SELECT doc_id, text, embedding FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 3 = 1 AND doc_id % 4 <> 0) documents"
_ASKED = "(SELECT item_id, text, embedding FROM benchmark JOIN embeddings ON vec_id = item_id) benchmark"
HYBRID_SEARCH = f"""WITH {BM25.replace("FROM documents", f"FROM {_CHUNKS}").replace("FROM benchmark", f"FROM {_ASKED}").replace("rank <= 10", "rank <= 20")},
v AS (SELECT item_id, doc_id, round(list_inner_product(CAST(benchmark.embedding AS DOUBLE[]), CAST(documents.embedding AS DOUBLE[])), 5) AS score FROM {_ASKED}, {_CHUNKS}),
legs AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM v UNION ALL SELECT item_id, doc_id, rank FROM hits),
f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM legs WHERE rank <= 20 GROUP BY 1, 2)
SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 5"""


def abstention(spark, sf_dir):
    """Share of assistant turns that decline, by a wide and a narrow list of phrases."""
    talk = table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy(F.concat_ws("-", "conv_id", "turn").alias("id")).agg(F.min("text").alias("text"))
    out = metrics.abstention(talk.select("id", "text"), talk.select("id"), "id", F.col("text"), ["th", "an", "cannot"], ["cannot answer", "ntnt"])
    return out.select("questions", F.round("loose", 6).alias("loose"), F.round("strict", 6).alias("strict"))


ABSTENTION = """SELECT count(*) AS questions, round(avg(CAST(t LIKE '%th%' OR t LIKE '%an%' OR t LIKE '%cannot%' AS DOUBLE)), 6) AS loose,
  round(avg(CAST(t LIKE '%cannot answer%' OR t LIKE '%ntnt%' AS DOUBLE)), 6) AS strict
FROM (SELECT lower(coalesce(min(text), '')) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn)"""


def label_shares(spark, sf_dir):
    """Number and percentage of documents by language."""
    return metrics.shares(table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang")), "lang")


SHARES = "SELECT coalesce(lang, 'none') AS lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM documents GROUP BY 1"

QUERIES = {
    "lexical_topk": (lexical_topk, LEXICAL_TOPK),
    "lexical_hit_metrics": (lexical_hit_metrics, f"WITH {PER_QUESTION} SELECT item_id, first_rank, hit_1, hit_5, hit_10, rr, ndcg_10 FROM per"),
    "two_tier_report": (two_tier_report, TWO_TIERS),
    "metric_breakdown": (metric_breakdown, BREAKDOWN),
    "pooled_text": (pooled_text, POOLED),
    "containment_topk": (containment_topk, CONTAINMENT),
    "gold_mapping": (gold_mapping, GOLD),
    "dense_topk": (dense_topk, DENSE_TOPK),
    "dense_topk_filtered_pre": (dense_prefiltered, DENSE_PRE),
    "dense_topk_filtered_post": (dense_postfiltered, DENSE_POST),
    "hybrid_rrf": (hybrid_fusion, HYBRID),
    "ndcg_report": (ndcg_report, NDCG),
    "hit_relevance": (hit_relevance, RELEVANCE),
    "hybrid_search": (hybrid_search, HYBRID_SEARCH),
    "conversation_context": (conversation_context, CONTEXT),
    "abstention": (abstention, ABSTENTION),
    "label_shares": (label_shares, SHARES),
}
