"""Registered queries over Markdown tables made from orders; the SQL computes what is expected from the orders' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_reports(spark, sf_dir) -> DataFrame:
    """(o_orderkey, markdown): one page for each order, with defects by the key modulo 7.

    A heading, a unit line, a table with one row for each line item (label, price, quantity) and a sentence. 1: the
    first row lacks its last cell; 2: the header's years zigzag; 3: two numbers in one cell beside an empty one; 4: no
    header and separator; 5: cut after the table; 6: a group row on top and a total at the end.
    """
    line = table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey") % 7
    price = F.format_number("l_extendedprice", 0)
    n = F.col("l_quantity").cast("int").cast("string")
    label = F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" no "), F.col("l_linenumber").cast("string"))
    cells = F.when((k == 1) & (F.col("l_linenumber") == 1), F.array(label, price)).when((k == 2), F.array(label, price, n, n)).when((k == 3), F.array(label, F.concat(price, F.lit(" "), n), F.lit(""))).otherwise(F.array(label, price, n))
    row = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = line.withColumnRenamed("l_orderkey", "o_orderkey").groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("rows"))
    body = body.withColumn("rows", F.array_join(F.transform("rows", lambda x: x["row"]), "\n"))
    head = F.when(k == 2, F.lit("| Item | FY2024 | FY2023 | FY2025 |\n| --- | --- | --- | --- |\n")).when(k == 4, F.lit("")).otherwise(F.lit("| Item | FY2024 | FY2023 |\n| --- | --- | --- |\n"))
    top = F.when(k == 6, F.lit("| Parts |  |  |\n")).otherwise(F.lit(""))
    end = F.when(k == 6, F.lit("\n| Total parts | 1 | 2 |")).otherwise(F.lit(""))
    tail = F.when(k == 5, F.lit("")).otherwise(F.lit("\n\nThe order was shipped as agreed."))
    page = F.concat(F.lit("# Note "), F.col("o_orderkey").cast("string"), F.lit(" – Orders\n(in thousands)\n\n"), head, top, F.col("rows"), end, tail)
    return body.select("o_orderkey", page.alias("markdown"))


def table_shape_findings(spark, sf_dir):
    """Findings of the shape check, by order."""
    found = order_reports(spark, sf_dir).select("o_orderkey", tables.page_tables(F.col("markdown")).alias("found"))
    return found.select("o_orderkey", F.explode(tables.page_findings(F.col("found"))).alias("f")).select("o_orderkey", "f.table_no", "f.finding", "f.hard", "f.at")


SHAPES = """SELECT l_orderkey AS o_orderkey, CAST(1 AS BIGINT) AS table_no, 'row_width' AS finding, true AS hard, row_number() OVER (PARTITION BY l_orderkey) AS at FROM lineitem WHERE l_orderkey % 7 = 1 AND l_linenumber = 1
UNION ALL SELECT DISTINCT l_orderkey, 1, 'year_order', false, 0 FROM lineitem WHERE l_orderkey % 7 = 2
UNION ALL SELECT l_orderkey, 1, 'merged_cell', true, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) FROM lineitem WHERE l_orderkey % 7 = 3"""


def linearized_facts(spark, sf_dir):
    """Facts of all tables: item, column label and value; group labels stand before the items they hold for."""
    rows = tables.table_rows(order_reports(spark, sf_dir), ["o_orderkey"], "markdown")
    return tables.linear_facts(rows, ["o_orderkey"]).select("o_orderkey", "item", "label", "value")


FACTS = """WITH r AS (SELECT l_orderkey AS o_orderkey, l_orderkey % 7 AS k, l_linenumber, CASE WHEN l_orderkey % 7 = 6 THEN 'Parts > ' ELSE '' END || 'Part ' || l_partkey || ' no ' || l_linenumber AS item,
  format('{:,}', CAST(round_even(l_extendedprice, 0) AS BIGINT)) AS price, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS n FROM lineitem WHERE l_orderkey % 7 <> 4)
SELECT o_orderkey, item, 'FY2024' AS label, CASE WHEN k = 3 THEN price || ' ' || n ELSE price END AS value FROM r
UNION ALL SELECT o_orderkey, item, 'FY2023', n FROM r WHERE k <> 3 AND NOT (k = 1 AND l_linenumber = 1) UNION ALL SELECT o_orderkey, item, 'FY2025', n FROM r WHERE k = 2
UNION ALL SELECT DISTINCT o_orderkey, 'Total parts', 'FY2024', '1' FROM r WHERE o_orderkey % 7 = 6 UNION ALL SELECT DISTINCT o_orderkey, 'Total parts', 'FY2023', '2' FROM r WHERE o_orderkey % 7 = 6"""


def _fragments(spark, sf_dir, strict):
    found = tables.fragmentation(order_reports(spark, sf_dir), ["o_orderkey"], "markdown", strict)
    return found.select("o_orderkey", "n_headless", "fragmented")


def fragmentation_lenient(spark, sf_dir):
    """Pages whose tables start without a header."""
    return _fragments(spark, sf_dir, False)


def fragmentation_strict(spark, sf_dir):
    """Pages whose tables start without a header or that end inside of one."""
    return _fragments(spark, sf_dir, True)


_FRAGMENTS = "SELECT DISTINCT l_orderkey AS o_orderkey, CAST(CASE WHEN l_orderkey % 7 = 4 THEN 1 ELSE 0 END AS BIGINT) AS n_headless, l_orderkey % 7 IN ({}) AS fragmented FROM lineitem"


def rendered_tables(spark, sf_dir):
    """Tables parsed and rendered again, by their digest: the text between the unit line and the sentence."""
    found = order_reports(spark, sf_dir).select("o_orderkey", F.explode(tables.page_tables(F.col("markdown"))).alias("t"))
    rows = F.col("t.rows")
    return found.select("o_orderkey", F.md5(tables.render(rows[0], F.slice(rows, 2, F.greatest(F.lit(1), F.size(rows) - 1)))).alias("digest"))


RENDERED = """WITH l AS (SELECT l_orderkey AS k, l_linenumber, l_orderkey % 7 AS way, '| Part ' || l_partkey || ' no ' || l_linenumber || ' | ' AS head, format('{:,}', CAST(round_even(l_extendedprice, 0) AS BIGINT)) AS price, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS n
  FROM lineitem WHERE l_orderkey % 7 <> 4),
c AS (SELECT k, l_linenumber, head || CASE WHEN way = 1 AND l_linenumber = 1 THEN price WHEN way = 2 THEN price || ' | ' || n || ' | ' || n WHEN way = 3 THEN price || ' ' || n || ' | ' ELSE price || ' | ' || n END || ' |' AS row FROM l),
r AS (SELECT k, string_agg(row, chr(10) ORDER BY l_linenumber, row) AS t FROM c GROUP BY 1)
SELECT k AS o_orderkey, md5('| Item | FY2024 | FY2023 |' || CASE WHEN k % 7 = 2 THEN ' FY2025 |' ELSE '' END || chr(10) || '| --- | --- | --- |' || CASE WHEN k % 7 = 2 THEN ' --- |' ELSE '' END || chr(10) || CASE WHEN k % 7 = 6 THEN '| Parts |  |  |' || chr(10) ELSE '' END || t || CASE WHEN k % 7 = 6 THEN chr(10) || '| Total parts | 1 | 2 |' ELSE '' END) AS digest FROM r"""


def observed_units(spark, sf_dir):
    """Unit line, scale and dates that the pages show."""
    pages = order_reports(spark, sf_dir).select("o_orderkey", text.observed_unit(F.col("markdown")).alias("u"), F.size(text.observed_dates(F.regexp_replace(F.regexp_extract("markdown", r"\| Item.*", 0), "FY", ""), 2)).cast("long").alias("n_dates"))
    return pages.select("o_orderkey", "u.raw", "u.scale", "n_dates")


OBSERVED = """SELECT DISTINCT l_orderkey AS o_orderkey, '(in thousands)' AS raw, 'thousand' AS scale, CAST(CASE WHEN l_orderkey % 7 = 4 THEN 0 ELSE 2 END AS BIGINT) AS n_dates FROM lineitem"""

QUERIES = {
    "table_shape_findings": (table_shape_findings, SHAPES),
    "linearized_facts": (linearized_facts, FACTS),
    "fragmentation_lenient": (fragmentation_lenient, _FRAGMENTS.format("4")),
    "fragmentation_strict": (fragmentation_strict, _FRAGMENTS.format("4, 5")),
    "rendered_tables": (rendered_tables, RENDERED),
    "observed_units": (observed_units, OBSERVED),
}
