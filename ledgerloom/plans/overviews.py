"""Registered queries over reports, lookups and sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import overview, profile, search, windows
from ledgerloom.plans.retrieval import JUDGED, _judged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def hit_rates(spark, sf_dir):
    """Hit@1, 2, 4, 8, MRR@4 and the rate of right documents of the lexical search, over all passages."""
    hits = _judged(spark, sf_dir).withColumn("same_document", F.col("relevant")).withColumn("latency", F.col("item_id").cast("double"))
    return overview.hit_rates(hits, table(spark, sf_dir, "benchmark"), "item_id")


HIT_RATES = f"""WITH {JUDGED},
f AS (SELECT item_id, min(rank) FILTER (relevant) AS first, max(CAST(relevant AS INT)) AS doc, CAST(item_id AS DOUBLE) AS lat FROM judged GROUP BY 1),
a AS (SELECT b.item_id, first, doc, lat FROM benchmark b LEFT JOIN f USING (item_id))
SELECT count(*) AS questions, {", ".join(f"round(avg(CAST(coalesce(first <= {k}, false) AS DOUBLE)), 6) AS hit_{k}" for k in (1, 2, 4, 8))},
  round(avg(CASE WHEN first <= 4 THEN 1.0 / first ELSE 0 END), 6) AS mrr_4, round(avg(coalesce(doc, 0)), 6) AS document_hit, round(avg(lat), 6) AS latency FROM a"""


def _results(spark, sf_dir, shift):
    line = table(spark, sf_dir, "lineitem")
    status = F.element_at(F.array(F.lit("pass"), F.lit("warning"), F.lit("fail")), (F.col("l_partkey") % 3 + 1).cast("int"))
    return line.select("l_returnflag", status.alias("status"), (1 - F.col("l_discount") - shift).alias("text_recall"), F.when(F.col("l_linenumber") > 2, 1 - F.col("l_tax")).alias("text_precision"), F.lit(None).cast("double").alias("numeric_recall"), (F.col("l_quantity") / 50).alias("numeric_precision"))


def qc_report(spark, sf_dir):
    """States and mean ratios of pages made from line items."""
    return overview.quality_report(_results(spark, sf_dir, 0.0), ["l_returnflag"])


QC_REPORT = """SELECT l_returnflag, count(*) AS pages, count(*) FILTER (l_partkey % 3 = 0) AS pass, count(*) FILTER (l_partkey % 3 = 1) AS warning, count(*) FILTER (l_partkey % 3 = 2) AS fail,
  round(avg(1 - l_discount), 6) AS text_recall, round(avg(CASE WHEN l_linenumber > 2 THEN 1 - l_tax END), 6) AS text_precision, CAST(0 AS DOUBLE) AS numeric_recall, round(avg(l_quantity / 50), 6) AS numeric_precision FROM lineitem GROUP BY 1"""


def qc_comparison(spark, sf_dir):
    """Change of the mean recall between two runs."""
    found = overview.quality_comparison(_results(spark, sf_dir, 0.0), _results(spark, sf_dir, 0.125), ["l_returnflag"])
    return found.select("l_returnflag", "text_recall_change", "text_precision_change")


QC_COMPARISON = "SELECT DISTINCT l_returnflag, CAST(-0.125 AS DOUBLE) AS text_recall_change, CAST(0 AS DOUBLE) AS text_precision_change FROM lineitem"


def page_lookup(spark, sf_dir):
    """Chunks, tokens and damage by page, for windows of documents cut to pages of 40 tokens."""
    t = windows.token_windows(table(spark, sf_dir, "documents"), ["doc_id"], text.tokens(F.col("text")), 64, 16)
    pages = F.sequence((F.col("chunk_no") * 48 / 40).cast("int"), ((F.col("chunk_no") * 48 + F.col("token_count") - 1) / 40).cast("int"))
    chunks = t.select("doc_id", F.lit("window").alias("method"), "token_count", (F.col("token_count") < 64).alias("fragmented"), pages.alias("source_pages"))
    return overview.page_chunks(chunks, ["doc_id"]).select("doc_id", F.col("page").cast("long").alias("page"), "chunks", "tokens", "fragmented")


PAGE_LOOKUP = f"""WITH t AS (SELECT doc_id, len({TOKENS}) AS n FROM documents),
w AS (SELECT doc_id, n, unnest(range(CASE WHEN n = 0 THEN 0 ELSE CAST(ceil(greatest(n - 64, 0) / 48.0) AS BIGINT) + 1 END)) AS i FROM t),
c AS (SELECT doc_id, i, least(64, n - i * 48) AS k FROM w),
p AS (SELECT doc_id, k, unnest(range(i * 48 // 40, (i * 48 + k - 1) // 40 + 1)) AS page FROM c)
SELECT doc_id, page, count(*) AS chunks, CAST(sum(k) AS BIGINT) AS tokens, max(k < 64) AS fragmented FROM p GROUP BY 1, 2"""


def sparse_vectors(spark, sf_dir):
    """Term weights of every document: their number and sum."""
    found = search.sparse_vectors(table(spark, sf_dir, "documents"), "doc_id", text.tokens(F.col("text")))
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    return found.select("doc_id", F.size("indices").cast("long").alias("terms"), F.round(total, 5).alias("weight"))


SPARSE = f"""WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), n AS (SELECT avg(len(t)) AS mean FROM t),
d AS (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM t),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM d GROUP BY 1, 2, 3)
SELECT doc_id, count(*) AS terms, round(sum(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))), 5) AS weight FROM tf, n GROUP BY 1"""


def notes_directory(spark, sf_dir):
    """First title of each note number among headings made from orders."""
    heads = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.when(F.col("o_orderkey") % 4 == 0, F.lit("Item ")).otherwise(F.lit("Note ")), (F.col("o_orderkey") % 5).cast("string"), F.lit(" – order "), F.col("o_orderkey").cast("string")).alias("text"))
    return overview.notes_directory(heads, ["o_custkey"], "o_orderkey")


NOTES = """SELECT o_custkey, CAST(o_orderkey % 5 AS VARCHAR) AS code, 'Note ' || (o_orderkey % 5) || ' – order ' || min(o_orderkey) AS title FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY o_custkey, o_orderkey % 5"""


def page_profiles(spark, sf_dir):
    """Class of documents as pages without images, by their features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"))
    found = profile.profile(docs, ["doc_id"])
    return found.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.col("n_words").cast("long").alias("n_words"), "page_class")


PROFILES = r"""WITH d AS (SELECT doc_id, length(trim(text, ' ')) AS n_chars, len(regexp_extract_all(text, '\S+')) AS n_words FROM documents)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, n_words, CASE WHEN n_chars >= 80 AND n_words >= 8 THEN 'native_text' ELSE 'uncertain' END AS page_class FROM d"""

QUERIES = {
    "hit_rates": (hit_rates, HIT_RATES),
    "qc_report": (qc_report, QC_REPORT),
    "qc_comparison": (qc_comparison, QC_COMPARISON),
    "page_lookup": (page_lookup, PAGE_LOOKUP),
    "sparse_vectors": (sparse_vectors, SPARSE),
    "notes_directory": (notes_directory, NOTES),
    "page_profiles": (page_profiles, PROFILES),
}
