"""Profiles, recovery, reports and collections."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import metrics, overview, profile, recovery
from ledgerloom.sources import tables as store

TABLE = "| Item | 2024 | 2023 |\n| --- | --- | --- |\n| Cash | 1 | 2 |\n| Debt | 3 | 4 |"
LONG = "This paragraph of the page tells about the leases that the group has signed in the year."


def block(text, y=300.0):
    return {"y0": y, "y1": y + 20, "text": text}


@pytest.mark.parametrize(
    ("blocks", "markdown", "raw", "before", "after", "action", "has"),
    [
        ([block(LONG)], LONG, LONG, None, None, "untouched", LONG),
        ([block(LONG)], "Other words.", LONG, LONG, None, "untouched", "Other words."),
        ([block(LONG, 100), block("Last words of the page that were lost by the engine here.", 700)], "Middle.", "x", None, None, "appended_orphan_blocks", recovery.NOTE),
        ([block("7", 20), block("short")], "Middle.", "x", None, None, "untouched", "Middle."),
        ([block("Stock\n5\n6", 60), block(LONG)], LONG, LONG, TABLE, None, "reconstructed_table_continuation", "| Stock | 5 | 6 |"),
        ([block("Total\n2024\n2023", 60), block(LONG)], LONG, LONG, TABLE, None, "untouched", LONG),
        ([], "| Stock | 5 | 6 |\n| --- | --- | --- |\n| Land | 7 | 8 |\n| Cars | 9 | 1 |", "x", TABLE, None, "reconstructed_table_continuation", "| Item | 2024 | 2023 |"),
        ([block(LONG)], "| " + LONG + " | a |\n| --- | --- |", LONG, None, None, "reconstructed_false_table", LONG),
    ],
)
def test_recovery(blocks, markdown, raw, before, after, action, has):
    got, did = recovery.recover_page(blocks, 792.0, markdown, raw, before, after)
    assert did == action and has in got


def test_recovery_of_pages(spark):
    schema = "id int, blocks array<struct<y0:double,y1:double,text:string>>, page_height double, markdown string, raw_text string, prev_content string, next_content string"
    df = spark.createDataFrame([(1, [(300.0, 320.0, LONG)], 792.0, "x", LONG, None, None), (2, None, None, None, None, None, None)], schema)
    assert {r.id: r.action for r in recovery.recover(df).collect()} == {1: "appended_orphan_blocks", 2: "untouched"}


def test_body_and_profile(spark):
    rows = [("a", 1, 10.0, 20.0, 800.0, "Table of Contents"), ("a", 2, 100.0, 400.0, 800.0, LONG + " " + LONG), ("a", 3, 780.0, 790.0, 800.0, "12"), ("b", 1, 5.0, 8.0, 800.0, "1")]
    body = profile.body_text(spark.createDataFrame(rows, "page string, block_no int, y0 double, y1 double, height double, text string"), ["page"])
    assert {r.page: r.raw_text for r in body.collect()} == {"a": LONG + " " + LONG, "b": "1"}
    images = spark.createDataFrame([("a", 10.0, 10.0, 100.0)], "page string, width double, height double, page_area double")
    fonts = spark.createDataFrame([("a", "Type1", "GlyphLessFont")], "page string, font_type string, name string")
    got = {r.page: r.page_class for r in profile.profile(body, ["page"], images, fonts).collect()}
    assert got == {"a": "ocr_layer", "b": "uncertain"}
    assert {r.page: r.page_class for r in profile.profile(body, ["page"]).collect()} == {"a": "native_text", "b": "uncertain"}


def test_reports(spark):
    schema = "doc string, status string, text_recall double, text_precision double, numeric_recall double, numeric_precision double"
    old = spark.createDataFrame([("d", "pass", 0.5, None, None, None), ("d", "fail", 1.0, 1.0, None, None)], schema)
    new = spark.createDataFrame([("d", "pass", 1.0, 1.0, 1.0, 1.0)], schema)
    r = overview.quality_report(old, ["doc"]).first()
    assert (r.pages, r["pass"], r.fail, r.text_recall, r.text_precision, r.numeric_recall) == (2, 1, 1, 0.75, 1.0, 0.0)
    assert overview.quality_comparison(old, new, ["doc"]).first().text_recall_change == 0.25
    chunks = spark.createDataFrame([("d", "m", 5, False, [1, 2]), ("d", "m", 7, True, [2])], "doc string, method string, token_count int, fragmented boolean, source_pages array<int>")
    assert {(x.page, x.chunks, x.tokens, x.fragmented) for x in overview.page_chunks(chunks, ["doc"]).collect()} == {(1, 1, 5, False), (2, 2, 12, True)}
    heads = spark.createDataFrame([("d", 1, "Note 1 Cash"), ("d", 2, "Other"), ("d", 3, "Note 1 again"), ("d", 4, "Other")], "doc string, at int, text string")
    assert [(x.code, x.title) for x in overview.notes_directory(heads, ["doc"], "at").collect()] == [("1", "Note 1 Cash")]
    assert [x.text for x in overview.contents(heads, ["doc"], "at").orderBy("place").collect()] == ["Note 1 Cash", "Other", "Note 1 again"]


def test_hit_rates_and_benchmark(spark):
    hits = spark.createDataFrame([(1, 1, False, True, 0.5), (1, 2, True, True, 0.5), (2, 1, False, False, 1.5)], "q int, rank int, relevant boolean, same_document boolean, latency double")
    questions = spark.createDataFrame([(1,), (2,), (3,)], "q int")
    r = overview.hit_rates(hits, questions, "q").first()
    assert (r.questions, r.hit_1, r.hit_2, r.mrr_4, r.document_hit, r.latency) == (3, 0.0, pytest.approx(0.333333), pytest.approx(0.166667), pytest.approx(0.333333), 1.0)
    report = overview.benchmark({"a": hits, "b": hits.filter("q = 2")}, lambda h: h, questions, "q", lambda h, k: metrics.per_question(h, k, (5,)), lambda e: e.groupBy("method").agg(F.avg(F.coalesce("hit_5", F.lit(0.0))).alias("hit_5")))
    assert {x.method: round(x.hit_5, 3) for x in report.collect()} == {"a": 0.333, "b": 0.0}


def test_collections(spark, tmp_path):
    name = f"points_{uuid.uuid4().hex[:8]}"
    store.create_collection(spark, name, 2)
    store.create_collection(spark, name, 2, recreate=True)
    assert spark.table(name).count() == 0 and "method" in spark.table(name).columns
    chunks = spark.createDataFrame([("a", "x"), ("b", None)], "chunk_id string, content string")
    vectors = store.encode_texts(chunks, "content", lambda t: [[len(x), 1.0] for x in t])
    got = {r.chunk_id: [round(v, 3) for v in r.embedding] for r in vectors.collect()}
    assert got == {"a": [0.707, 0.707], "b": [0.0, 1.0]}
    assert store.attach_vectors(chunks, vectors, "chunk_id").count() == 2
    with pytest.raises(ValueError):
        store.attach_vectors(chunks, vectors.filter("chunk_id = 'a'"), "chunk_id")
    pages = spark.createDataFrame([("d", 2, "pass", "layout", "t"), ("d", 1, "fail", "vision", "u")], "document_id string, pdf_page int, status string, engine string, markdown string")
    store.write_pages(pages, str(tmp_path / "p"))
    back = store.read_ordered_pages(spark, str(tmp_path / "p"), "document_id string, pdf_page int, status string, engine string, markdown string")
    assert [(r.pdf_page, r.page_order) for r in back.orderBy("page_order").collect()] == [(1, 1), (2, 2)]
    m = store.manifest(pages).first()
    assert (m.pages, m["pass"], m.fail, m.engines) == (2, 1, 1, ["layout", "vision"]) and store.review_queue(pages).count() == 1
    store.save_gold(spark.createDataFrame([("1", "q?")], "id string, question string"), str(tmp_path / "g"))
    assert store.read_gold(spark, str(tmp_path / "g")).first().question == "q?"
    store.export_review(spark.createDataFrame([(1, 1, 0.5, "text")], "query int, rank int, score double, content string"), str(tmp_path / "r"))
    assert "rank 1" in (spark.read.text(str(tmp_path / "r"), wholetext=True).first().value)
