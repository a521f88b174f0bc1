"""Registered queries over blocks, stitching, chunking and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import chunking, relevance, structure
from ledgerloom.plans.reports import order_reports


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir):
    """Filings of customers: each order's page, in the order of their keys."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    pages = order_reports(spark, sf_dir).join(orders, "o_orderkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return pages.select(F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("document_id"), n.cast("int").alias("pdf_page"), "markdown", "o_orderkey")


def canonical_blocks(spark, sf_dir):
    """Blocks of each order's page by kind."""
    pages = order_reports(spark, sf_dir).select(F.col("o_orderkey").cast("string").alias("document_id"), F.lit(1).alias("pdf_page"), "markdown")
    found = structure.blocks(pages).groupBy("document_id", "kind").agg(F.count("*").alias("n"), F.max("code").alias("code"))
    return found.select(F.col("document_id").cast("long").alias("o_orderkey"), "kind", "n", "code")


BLOCKS = """WITH o AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k AS o_orderkey, 'heading' AS kind, CAST(1 AS BIGINT) AS n, CAST(k AS VARCHAR) AS code FROM o
UNION ALL SELECT k, 'table', 1, CAST(k AS VARCHAR) FROM o WHERE k % 7 <> 4
UNION ALL SELECT k, 'paragraph', 1 + CASE WHEN k % 7 = 5 THEN 0 ELSE 1 END + CASE WHEN k % 7 = 4 THEN n ELSE 0 END, CAST(k AS VARCHAR) FROM o"""


def stitched_tables(spark, sf_dir):
    """Tables of orders cut to pages of two rows each and stitched again: pages and rows."""
    line = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    rows = line.select("l_orderkey", (F.row_number().over(w) - 1).alias("i"), F.concat(F.lit("| Part "), F.col("l_partkey").cast("string"), F.lit(" | "), F.col("l_quantity").cast("int").cast("string"), F.lit(" |")).alias("row"))
    page = rows.groupBy("l_orderkey", F.floor(F.col("i") / 2).alias("p")).agg(F.sort_array(F.collect_list(F.struct("i", "row"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["row"]), "\n")
    head = F.when(F.col("p") == 0, F.concat(F.lit("# Item "), F.col("l_orderkey").cast("string"), F.lit(" Parts\n\n| Part | FY2024 |"))).otherwise(F.lit("| Part | FY2023 |"))
    pages = page.select(F.col("l_orderkey").cast("string").alias("document_id"), (F.col("p") + 1).cast("int").alias("pdf_page"), F.concat(head, F.lit("\n| --- | --- |\n"), body).alias("markdown"))
    found = structure.stitched_tables(pages)
    return found.select(F.col("document_id").cast("long").alias("l_orderkey"), F.col("table_no").cast("long").alias("table_no"), F.size("source_pages").cast("long").alias("n_pages"), F.size("rows").cast("long").alias("n_rows"), "is_multi_page", "heading")


STITCHED = """SELECT l_orderkey, CAST(0 AS BIGINT) AS table_no, CAST(ceil(count(*) / 2) AS BIGINT) AS n_pages, count(*) AS n_rows, count(*) > 2 AS is_multi_page, 'Item ' || l_orderkey || ' Parts' AS heading FROM lineitem GROUP BY 1"""


def fixed_windows(spark, sf_dir):
    """Windows of 512 tokens over the customers' filings."""
    found = chunking.fixed_windows(_pages(spark, sf_dir))
    return found.select("document_id", "chunk_no", "token_count", F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ",").alias("pages"), F.md5("content").alias("digest"))


WINDOWS = r"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS i, l_orderkey % 7 AS w, 'Part ' || l_partkey || ' no ' || l_linenumber AS label, format('{:,}', CAST(round_even(l_extendedprice, 0) AS BIGINT)) AS price, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS n FROM lineitem),
c AS (SELECT k, i, w, '| ' || CASE WHEN w = 1 AND i = 1 THEN label || ' | ' || price WHEN w = 2 THEN label || ' | ' || price || ' | ' || n || ' | ' || n WHEN w = 3 THEN label || ' | ' || price || ' ' || n || ' | ' ELSE label || ' | ' || price || ' | ' || n END || ' |' AS row FROM l),
b AS (SELECT k, any_value(w) AS w, string_agg(row, chr(10) ORDER BY i, row) AS rows FROM c GROUP BY 1),
m AS (SELECT k, '# Note ' || k || ' – Orders' || chr(10) || '(in thousands)' || chr(10) || chr(10) || CASE w WHEN 2 THEN '| Item | FY2024 | FY2023 | FY2025 |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) WHEN 4 THEN '' ELSE '| Item | FY2024 | FY2023 |' || chr(10) || '| --- | --- | --- |' || chr(10) END
  || CASE WHEN w = 6 THEN '| Parts |  |  |' || chr(10) ELSE '' END || rows || CASE WHEN w = 6 THEN chr(10) || '| Total parts | 1 | 2 |' ELSE '' END || CASE WHEN w = 5 THEN '' ELSE chr(10) || chr(10) || 'The order was shipped as agreed.' END AS md FROM b),
p AS (SELECT o_custkey AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS page, md FROM m JOIN orders ON o_orderkey = k),
t AS (SELECT d, page, list_concat(['<page' || page || '>'], regexp_extract_all(md, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS t FROM p),
a AS (SELECT d, flatten(list(t ORDER BY page)) AS t, flatten(list(list_transform(t, lambda x: page) ORDER BY page)) AS g FROM t GROUP BY 1),
w AS (SELECT d, t, g, unnest(range(CAST(ceil(greatest(len(t) - 512, 0) / 412.0) AS BIGINT) + 1)) AS chunk_no FROM a)
SELECT 'cust_' || d AS document_id, chunk_no, len(t[chunk_no * 412 + 1 : chunk_no * 412 + 512]) AS token_count, array_to_string(list_sort(list_distinct(g[chunk_no * 412 + 1 : chunk_no * 412 + 512])), ',') AS pages, md5(array_to_string(t[chunk_no * 412 + 1 : chunk_no * 412 + 512], ' ')) AS digest FROM w"""


def _chunks(method):
    def run(spark, sf_dir):
        found = chunking.chunk(_pages(spark, sf_dir), method)
        return found.select("document_id", "chunk_id", "kind", "level", "parent_id", "token_count", F.size("source_pages").alias("n_pages"), "table_id", F.md5("content").alias("digest"))

    run.__doc__ = f"Chunks of the customers' filings by method {method[1]}."
    return run


def answer_labels(spark, sf_dir):
    """Labels of answers made from line items: amounts alike, off, or as percentages, sentences in common, and refusals."""
    line = table(spark, sf_dir, "lineitem")
    n, v = F.col("l_linenumber"), F.col("l_extendedprice")
    factor = F.when(n == 2, 1.02).when(n == 3, 1.2).when(n == 4, 0.01).when(n == 5, 100.0).otherwise(F.lit(1.0))
    answer = F.when(n == 6, "I am unable to tell from the text.").when(n == 7, "Yes, demand was strong").otherwise(F.concat(F.lit("The total was $"), F.format_number(v, 2), F.lit(" in all")))
    gold = F.when(n == 6, "Net sales of the second quarter").when(n == 7, F.when(F.col("l_partkey") % 2 == 0, "Yes. Demand stayed strong overall").otherwise("No, output fell over the whole of last summer")).otherwise(F.format_string("%.2f", v * factor))
    rows = line.select("l_orderkey", n.alias("l_linenumber"), answer.alias("a"), gold.alias("g"))
    return rows.select("l_orderkey", "l_linenumber", relevance.answer_class(F.col("a"), F.col("g")).alias("label"))


ANSWERS = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(printf('%.2f', l_extendedprice) AS DOUBLE) AS v,
  CAST(printf('%.2f', l_extendedprice * CASE l_linenumber WHEN 2 THEN 1.02 WHEN 3 THEN 1.2 WHEN 4 THEN 0.01 WHEN 5 THEN 100.0 ELSE 1.0 END) AS DOUBLE) AS g FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 6 THEN 'Refusal' WHEN l_linenumber = 7 THEN CASE WHEN l_partkey % 2 = 0 THEN 'Correct' ELSE 'Incorrect' END
  WHEN abs(v - g) < 0.015 OR abs(v / 100 - g) < 0.005 OR abs(v * 100 - g) < 0.5 OR (g <> 0 AND least(abs(v - g), abs(v / 100 - g), abs(v * 100 - g)) / abs(g) < 0.025) THEN 'Correct' ELSE 'Incorrect' END AS label FROM r"""

QUERIES = {
    "canonical_blocks": (canonical_blocks, BLOCKS),
    "stitched_tables": (stitched_tables, STITCHED),
    "m1_chunks": (fixed_windows, WINDOWS),
    "m2_chunks": (_chunks("m2"), None),
    "m3_chunks": (_chunks("m3"), None),
    "m4_chunks": (_chunks("m4"), None),
    "m5_chunks": (_chunks("m5"), None),
    "answer_labels": (answer_labels, ANSWERS),
}
