"""Registered queries against their SQL on rows that the tables supplied don't have."""

import duckdb
import pytest

from ledgerloom import plans
from tests.test_oracles import rows


def against_sql(spark, tmp_path, name, **tables):
    """The query's rows and the SQL's over tables given as (schema, rows)."""
    con = duckdb.connect()
    for table, (schema, values) in tables.items():
        path = f"{tmp_path}/{table}.parquet"
        spark.createDataFrame(values, schema).write.parquet(path, mode="overwrite")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    found, want = plans.queries()[name](spark, str(tmp_path)), con.execute(plans.oracle_sql()[name])
    return rows(found.columns, found.collect()), rows([d[0] for d in want.description], want.fetchall())


DOCS = "doc_id long, text string"
# a text of 640 words of which 333 stay: a tie of the sixth digit
TIE = " ".join(["kept"] * 333 + ["longestwords"] * 307)


@pytest.mark.parametrize("texts", [[""], [None], ["?!", "a b"], [TIE], ["Old. 1 line here. 2 go on. 28.6 is it? 3 end", "No. Aa. 2a b. 3"]])
@pytest.mark.parametrize("name", ["character_ratios", "sentences", "text_recall_precision"])
def test_texts(spark, tmp_path, name, texts):
    docs = [(i, t) for i in range(6) for t in texts]
    found, want = against_sql(spark, tmp_path, name, documents=(DOCS, docs))
    assert found == want


def test_lines_of_a_table_are_trimmed_of_blanks_only(spark):
    from pyspark.sql import functions as F

    from ledgerloom.functions import text

    df = spark.createDataFrame([("  | a |\n  | b |",), ("0|a|\n1|b|",)], "t string").select(text.content_flags(F.col("t")).alias("f"))
    assert [r.f.contains_table for r in df.collect()] == [True, False]


ITEMS = [(1, "a a b c"), (2, "a a a zz zz"), (3, ""), (4, "none here")]
CHUNKS = [(1, "a b"), (2, "a a a b c zz"), (3, None), (4, "zz a"), (5, "q")]


@pytest.mark.parametrize("more", [[], [(2, "c zz zz"), (2, "a")]])
def test_containment_of_repeated_ids_and_tokens(spark, tmp_path, more):
    found, want = against_sql(spark, tmp_path, "containment_topk", documents=(DOCS, CHUNKS + more), benchmark=("item_id long, text string", ITEMS))
    assert found == want


def test_containment_joins_nothing(spark, tmp_path):
    against_sql(spark, tmp_path, "containment_topk", documents=(DOCS, CHUNKS), benchmark=("item_id long, text string", ITEMS))
    plan = plans.queries()["containment_topk"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("more", [[], [(2, "c zz zz"), (2, "a")]])
@pytest.mark.parametrize("name", ["doc_token_multiset", "multiset_operations", "text_recall_precision", "sparse_vectors"])
def test_multisets_of_repeated_ids(spark, tmp_path, name, more):
    docs = [(i, t) for i, t in CHUNKS if t] + (more if name != "sparse_vectors" else [])
    found, want = against_sql(spark, tmp_path, name, documents=(DOCS, docs))
    assert found == want


@pytest.mark.parametrize("name", ["doc_token_multiset", "sparse_vectors"])
def test_distinct_documents_are_not_shuffled(spark, tmp_path, name):
    against_sql(spark, tmp_path, name, documents=(DOCS, CHUNKS[:2]))
    plan = plans.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_chunks_of_pages_are_those_of_their_blocks(spark):
    from ledgerloom.operators import chunking, structure

    page = "# Note {0} Leases\n(in millions)\n\n| Item | FY2024 |\n| --- | --- |\n| a\\|b | 1 |\n\n12\nText {0} goes on"
    rows = [(d, p, page.format(p)) for d in ("x", "y", None) for p in (3, 1, 2)] + [("x", 2, "Again. And more."), ("z", 1, None)]
    pages = spark.createDataFrame(rows, "document_id string, pdf_page int, markdown string")
    for method in chunking.METHODS:
        one, two = chunking.chunk(structure.blocks(pages.filter("document_id <> 'x'")), method), chunking.chunk(pages.filter("document_id <> 'x'"), method)
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.collect()))
