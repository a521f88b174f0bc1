"""Registered queries over the quality gate, routing, stores and incremental work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import quality
from ledgerloom.sources import tables as store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qc_status(spark, sf_dir):
    """The gate over all documents as single pages: unchanged, without long words, with words added, blank, or without a reliable source."""
    way = F.col("doc_id") % 5
    long = F.array_join(F.filter(F.split("text", " "), lambda w: ~w.rlike(r"^\p{L}{6,}$")), " ")
    more = F.concat("text", F.lit(" "), F.array_join(F.array_repeat(F.lit("zzyzx"), F.size(F.split("text", r"\s+"))), " "))
    output = F.when(way == 0, F.col("text")).when(way == 1, long).when(way == 2, more).when(way == 3, F.lit(" ")).otherwise(F.col("text"))
    docs = table(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.when(way == 4, "ocr_layer").otherwise("native_text").alias("page_class"), F.lit("layout").alias("engine"), F.col("text").alias("raw_text"), F.lit(False).alias("likely_tabular"), output.alias("markdown"), F.lit(None).cast("string").alias("prev_content"), F.lit(None).cast("string").alias("next_content"))
    return quality.evaluate(pages, ["doc_id"]).select("doc_id", "status", "text_recall", "text_precision")


QC = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, doc_id % 5 AS way, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda x: NOT regexp_full_match(x, '\p{L}{6,}')), ' ') AS short FROM documents),
t AS (SELECT doc_id, way, len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS a, len(regexp_split_to_array(text, '\s+')) AS added FROM d),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS tok FROM d WHERE way = 1),
o AS (SELECT doc_id, unnest(regexp_extract_all(lower(short), '[\p{L}\p{N}_]+')) AS tok FROM d WHERE way = 1),
wc AS (SELECT doc_id, tok, count(*) AS c FROM w GROUP BY 1, 2), oc AS (SELECT doc_id, tok, count(*) AS c FROM o GROUP BY 1, 2),
m AS (SELECT coalesce(wc.doc_id, oc.doc_id) AS doc_id, sum(least(coalesce(wc.c, 0), coalesce(oc.c, 0))) AS common, sum(coalesce(wc.c, 0)) AS a, sum(coalesce(oc.c, 0)) AS b FROM wc FULL JOIN oc ON wc.doc_id = oc.doc_id AND wc.tok = oc.tok GROUP BY 1),
r AS (SELECT t.doc_id, way, t.a,
  CASE way WHEN 1 THEN coalesce(common / nullif(m.a, 0), 0) WHEN 3 THEN 0.0 ELSE 1.0 END AS recall,
  CASE way WHEN 1 THEN common / nullif(m.b, 0) WHEN 2 THEN t.a / (t.a + added) WHEN 3 THEN 0.0 ELSE 1.0 END AS prec,
  CASE way WHEN 1 THEN m.a - common ELSE 0 END AS missing, CASE way WHEN 1 THEN m.b - common WHEN 2 THEN added ELSE 0 END AS extra FROM t LEFT JOIN m USING (doc_id))
SELECT doc_id,
  CASE WHEN way = 3 THEN 'fail' WHEN a = 0 OR way = 4 THEN 'warning' WHEN (recall < 0.88 AND missing > 3) OR (prec < 0.88 AND extra > 3) THEN 'fail' WHEN recall < 0.88 OR prec < 0.88 THEN 'warning' ELSE 'pass' END AS status,
  CASE WHEN way <> 4 AND a > 0 THEN round(recall, 4) END AS text_recall, CASE WHEN way <> 4 AND a > 0 THEN round(prec, 4) END AS text_precision FROM r"""


def page_classes(spark, sf_dir):
    """Classes of pages whose features are made from line items, and where they are sent first."""
    line = table(spark, sf_dir, "lineitem")
    c = quality.page_class(F.col("l_quantity") * 8, F.col("l_quantity"), F.col("l_discount") * 10, F.col("l_discount") * 12, F.col("l_tax") / 10, F.col("l_linenumber") == 3, F.col("l_linenumber") == 5, F.col("l_linenumber") == 2)
    rows = line.select(c.alias("page_class"))
    return rows.withColumn("route", quality.initial_route(F.col("page_class"))).groupBy("page_class", "route").agg(F.count("*").alias("n"))


CLASSES = """WITH f AS (SELECT l_quantity * 8 AS chars, l_quantity AS words, l_discount * 10 AS mx, l_discount * 12 AS tot, l_tax / 10 > 0.002 AS bad, l_linenumber = 3 AS sus, l_linenumber = 5 AS t3, l_linenumber = 2 AS vec FROM lineitem),
c AS (SELECT CASE WHEN NOT (chars >= 80 AND words >= 8) AND mx < 0.2 THEN 'uncertain' WHEN NOT (chars >= 80 AND words >= 8) THEN 'image_only' WHEN mx >= 0.8 AND (bad OR t3 OR sus) THEN 'ocr_layer' WHEN mx >= 0.8 THEN 'hybrid'
  WHEN bad OR t3 THEN 'uncertain' WHEN mx > 0.35 OR tot > 0.3 THEN 'hybrid' WHEN vec THEN 'hybrid' ELSE 'native_text' END AS page_class FROM f)
SELECT page_class, CASE WHEN page_class IN ('hybrid', 'image_only') THEN 'vision' ELSE 'layout' END AS route, count(*) AS n FROM c GROUP BY 1, 2"""

_RANK = {"layout": 0, "table_model": 1, "vision": 2, "native": 3}


def engine_choice(spark, sf_dir):
    """The engine that is kept for each order's page, of candidates made from its line items."""
    line = table(spark, sf_dir, "lineitem")
    engine = F.element_at(F.array(*[F.lit(x) for x in _RANK]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    status = F.element_at(F.array(F.lit("pass"), F.lit("warning"), F.lit("fail")), (F.col("l_partkey") % 3 + 1).cast("int"))
    rows = line.select("l_orderkey", engine.alias("engine"), status.alias("status"))
    return quality.choose_engine(rows, ["l_orderkey"], _RANK)


ENGINES = """WITH r AS (SELECT l_orderkey, (['layout', 'table_model', 'vision', 'native'])[l_linenumber % 4 + 1] AS engine, l_linenumber % 4 AS e, (['pass', 'warning', 'fail'])[l_partkey % 3 + 1] AS status, l_partkey % 3 AS s FROM lineitem)
SELECT l_orderkey, arg_min(engine, s * 4 + e) AS engine, arg_min(status, s * 4 + e) AS status FROM r GROUP BY 1"""


def left_anti_resume(spark, sf_dir):
    """Orders of which the output has no line item yet that was shipped after 1996."""
    done = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp'1996-01-01'").select(F.col("l_orderkey").alias("o_orderkey"))
    return store.unfinished(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"])


RESUME = "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01')"


def eval_vs_distractor(spark, sf_dir):
    """Documents that have labels against those that don't, by language."""
    inside, outside = store.split_by_membership(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", table(spark, sf_dir, "labels"))
    both = inside.withColumn("part", F.lit("evaluation")).unionByName(outside.withColumn("part", F.lit("distractor")))
    return both.groupBy("part", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))


PARTS = "SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) THEN 'evaluation' ELSE 'distractor' END AS part, coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY 1, 2"


def upserted_points(spark, sf_dir):
    """Vectors with every third one replaced by its label doubled, and some new ones."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = points.filter("vec_id % 3 = 0").withColumn("label", F.col("label") * 2)
    more = points.filter("vec_id < 10").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "label")
    return store.upsert(points, new.unionByName(more), "vec_id").select("vec_id", F.col("label").cast("long").alias("label"))


UPSERT = "SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN label * 2 ELSE label END AS BIGINT) AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id < 10"


def patched_points(spark, sf_dir):
    """Labels filled in from quality labels where these have one."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"), (F.col("quality") + 100).cast("long").alias("label"))
    return store.patch(points, new, "vec_id", ["label"])


PATCH = "SELECT vec_id, CAST(coalesce(l.quality + 100, e.label) AS BIGINT) AS label FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id"


def collection_statistics(spark, sf_dir):
    """Points, vectors and dimension by label."""
    return store.collection_statistics(table(spark, sf_dir, "embeddings"), ["label"])


STATISTICS = "SELECT label, count(*) AS points, count(embedding) AS with_vector, CAST(max(len(embedding)) AS BIGINT) AS dimension FROM embeddings GROUP BY 1"


def payload_fields(spark, sf_dir):
    """Payload fields of chunks made from orders."""
    o = table(spark, sf_dir, "orders")
    ticker = F.element_at(F.array(F.lit("aapl"), F.lit("xyz"), F.lit("NVDA")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = o.select(F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.concat_ws("_", ticker, F.when(F.col("o_orderkey") % 2 == 0, F.lit("2023")), F.lit("10k")).alias("document_id"), F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("int").alias("fiscal_year"), F.concat(F.lit("| a | b |\n| --- | --- |\n| 2019 | "), (2010 + F.col("o_custkey") % 20).cast("string"), F.lit(" |")).alias("content"), F.lit("narrative").alias("chunk_type"))
    p = store.payload(rows, [])
    return p.select("chunk_id", "document_id", "ticker", F.col("fiscal_year").cast("long").alias("fiscal_year"), F.array_join(F.transform("period_years", lambda x: x.cast("string")), ",").alias("years"), "contains_table", "contains_text")


PAYLOAD = """WITH r AS (SELECT 'c' || o_orderkey AS chunk_id, (['aapl', 'xyz', 'nvda'])[o_orderkey % 3 + 1] AS t, o_orderkey % 2 = 0 AS even, 2010 + o_custkey % 20 AS y FROM orders)
SELECT chunk_id, t || CASE WHEN even THEN '_2023' ELSE '' END || '_10k' AS document_id, CASE WHEN t <> 'xyz' THEN upper(t) END AS ticker, CAST(CASE WHEN even THEN 2023 ELSE 2025 END AS BIGINT) AS fiscal_year,
  CASE WHEN y = 2019 THEN '2019' ELSE least(2019, y) || ',' || greatest(2019, y) END AS years, true AS contains_table, false AS contains_text FROM r"""

QUERIES = {
    "qc_status": (qc_status, QC),
    "page_class": (page_classes, CLASSES),
    "engine_choice": (engine_choice, ENGINES),
    "left_anti_resume": (left_anti_resume, RESUME),
    "eval_vs_distractor": (eval_vs_distractor, PARTS),
    "upserted_points": (upserted_points, UPSERT),
    "patched_points": (patched_points, PATCH),
    "collection_statistics": (collection_statistics, STATISTICS),
    "payload_fields": (payload_fields, PAYLOAD),
}
