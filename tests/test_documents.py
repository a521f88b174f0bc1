"""Blocks, stitching and chunking on small documents; stores and streams."""

import json
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import chunking, relevance, search, structure, tables, windows
from ledgerloom.sources import tables as store
from ledgerloom.streaming.ingest import ingest

TABLE = "| Item | FY2024 | FY2023 |\n| --- | --- | --- |\n"


def document(*pages):
    return structure.stitch([b for i, m in enumerate(pages, 1) for b in structure.page_blocks("d", i, m)])


def test_blocks():
    got = structure.page_blocks("d", 3, "# Note 7 Leases (in millions)\n\nText one.\n" + TABLE + "| a | 1 | 2 |\n\n| no | table |\n## Other")
    assert [b["kind"] for b in got] == ["heading", "paragraph", "paragraph", "table", "paragraph", "heading"]
    assert (got[0]["text"], got[0]["code"], got[1]["text"], got[3]["rows"], got[3]["table_id"]) == ("Note 7 Leases", "7", "(in millions)", [["a", "1", "2"]], "p3_t01")
    assert structure.page_blocks(None, None, None) == []


def test_tables_across_pages():
    doc = document("# Item 8 Data\n" + TABLE + "| a | 1 | 2 |", "| Item | FY2023 | FY2022 |\n| --- | --- | --- |\n| b | 3 | 4 |\n(1) restated", "# Item 9 More\n" + TABLE + "| c | 5 | 6 |")
    assert [(t.pages, len(t.rows), t.footnotes) for t in doc.tables] == [([1, 2], 2, ["(1) restated"]), ([3], 1, [])]
    other = document("# Item 8 Data\n" + TABLE + "| a | 1 | 2 |", "| Wholly | different | columns | here | now |\n| --- | --- | --- | --- | --- |\n| b | 3 | 4 | 5 | 6 |")
    assert len(other.tables) == 2


def test_sections_go_on():
    doc = document("# Note 13 Debt\nThe group has loans and", "# Note 18 Debt (continued)\nnotes of banks.", "# Note 14 Tax\nText.")
    assert [(s.code, s.text) for s in doc.sections if s.blocks] == [("13", "The group has loans and\n\nnotes of banks."), ("14", "Text.")]
    assert document("The group has", "loans (two).").sections[0].text == "The group has loans (two)."


def test_stitching_keeps_rows():
    pages = [f"{TABLE}| r{i} | 1 | 2 |" for i in range(5)]
    doc = document(*pages)
    assert sum(len(t.rows) for t in doc.tables) == 5 and len(doc.tables) == 1 and len(doc.trace) == 5


LONG = " ".join(f"Sentence number {chr(97 + i % 26)} says that demand grew in every market." for i in range(200))


@pytest.mark.parametrize("method", chunking.METHODS)
def test_chunkers_lose_nothing(method):
    doc = document("# Note 1 Sales\n" + LONG, TABLE + "\n".join(f"| row{i} | {i} | 2 |" for i in range(60)) + "\n(1) footnote here", "# Note 2 Cost\nShort text stands here.")
    got = chunking.METHODS[method](doc)
    body = "\n".join(p.content for p in got if p.level == "child")
    for s in chunking.split_sentences(LONG)[:5] + ["Short text stands here."]:
        assert s in body
    assert all(f"row{i} " in body for i in range(60))
    assert all(p.pages == sorted(p.pages) and p.content.strip() for p in got)
    if method == "m5":
        parents = {p.name for p in got if p.level == "parent"}
        assert parents and all(p.parent in parents for p in got if p.level == "child")
        assert {"summary", "contents", "notes_index"} == {p.kind for p in got if p.level == "tier0"}


def test_parents_hold_every_unit():
    doc = document("# Note 1 A\n" + LONG, "# Note 2 B\n" + LONG)
    units = chunking.units_of(doc)
    joined = "\n\n".join(p.content for p in chunking.parents_of(units))
    assert joined == "\n\n".join(u.text for u in units)


def test_boundaries_and_headings():
    assert chunking.tag_boundaries([100, 300, 50, 400, 10]) == [2, 4] and chunking.tag_boundaries([1, 1, 1, 1]) == [2] and chunking.tag_boundaries([5]) == []
    assert chunking.parse_boundaries("cut at 3, 1 and 9, 3", 9) == [1, 3]
    path = []
    for h in ("NOTE 3 Restructuring", "2024 Plan", "Operational", "Marketing", "2023 Plan", "Goodwill"):
        path = chunking.push_heading(path, h)
    assert path == ["NOTE 3 Restructuring", "Goodwill"]
    assert [chunking.is_noise(x) for x in ("", "12", "as follows:", "A real sentence.")] == [True, True, True, False]


@given(st.integers(0, 3000), st.integers(2, 600), st.integers(0, 500))
@settings(max_examples=40, deadline=None)
def test_window_count_covers(n, size, overlap):
    overlap = min(overlap, size - 1)
    step = size - overlap
    count = 0 if n == 0 else -(-max(n - size, 0) // step) + 1
    ends = [min(n, i * step + size) for i in range(count)]
    assert (not n and not ends) or (ends[-1] == n and ends[:-1].count(n) == 0)


def test_windows(spark):
    df = spark.createDataFrame([(1, list("abcdefg")), (2, []), (3, None)], "id int, t array<string>")
    got = windows.token_windows(df, ["id"], F.col("t"), 4, 1).collect()
    assert sorted((r.id, r.chunk_no, "".join(r.tokens)) for r in got) == [(1, 0, "abcd"), (1, 1, "defg")]
    words = [("p", 100.0 + (i % 2), 100.0 + 20 * i, f"{i}1.5") for i in range(6)] + [("q", 50.0 * i, 300.0, "12") for i in range(6)]
    got = windows.tabular_words(spark.createDataFrame(words, "page string, x1 double, y0 double, text string"), ["page"], F.lit(1000.0)).collect()
    assert {r.page: r.likely_tabular for r in got} == {"p": True, "q": False}


def test_header_years(spark):
    cases = [(["FY2025", "Q1 2025", "(2024)"], [2025, 2024], True), (["2024-2025", "FY2024–FY2025"], [], True), (["12025"], [], True), (["2024", "2025", "2023"], [2024, 2025, 2023], False), ([], [], True)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, h array<string>")
    got = df.select("i", tables.header_years(F.col("h")).alias("y"), tables.is_monotonic(tables.header_years(F.col("h"))).alias("m")).collect()
    assert {r.i: (list(r.y), r.m) for r in got} == {i: (c[1], c[2]) for i, c in enumerate(cases)}


def test_merged_and_collapsed_cells(spark):
    rows = [(["a", "11,237 28", ""], True), (["a", "11,237 28", "5"], False), (["a", "May 1, 2024", ""], False), (["a", "10 - 20", ""], False), (["1 2", "", "3"], False)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, c array<string>")
    assert {r.i: r.m for r in df.select("i", tables.merged_cell(F.col("c")).alias("m")).collect()} == {i: r[1] for i, r in enumerate(rows)}
    one = spark.createDataFrame([(["Revenue", "2024 - $1,000", "2023 - $900"],), (["Item", "2024", "2023"],)], "c array<string>")
    got = [r.d for r in one.select(tables.decouple_header(F.col("c")).alias("d")).collect()]
    assert (got[0].headers, got[0].first_row, got[1]) == (["", "2024", "2023"], ["Revenue", "$1,000", "$900"], None)
    same = spark.createDataFrame([(["x", "x", "x"],), (["x", "y", "x"],)], "c array<string>").select(tables.dedup_merged(F.col("c")).alias("c")).collect()
    assert [r.c for r in same] == [["x", "", ""], ["x", "y", "x"]]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(text.numbers(F.lit("(1) Paid 1,234.5 and (500) in FY2025, v1.2.3 – 7"))) == ["1234.5", "500", "2025", "7"]
    assert value(text.uuid5(F.lit("chunk é"))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, "chunk é"))
    assert value(text.normalize_text_numbers(F.lit("(1,234) in year (2020) and 5,678,900"))) == "-1234 in year 2020 and 5678900"
    assert value(text.period_dates(F.array(F.lit("2024")), F.lit("January 28, 2024 and Jan 29, 2023"), F.lit("NKE"))) == ["2023-01-29", "2024-01-28", "2024-05-31"]
    assert value(text.fiscal_suffix(F.lit("For the fiscal year ended September 28th, 2024"))) == "-09-28"
    assert value(text.keeps_number(F.lit("12"), F.lit("see Note"), F.lit(""))) is False and value(text.keeps_number(F.lit("12"), F.lit("$"), F.lit(""))) is True
    assert value(text.printed_page(F.lit("x Page 12 y"))) == 12 and value(text.printed_page(F.lit("x"), F.lit("a 3 b 45"))) == 45
    assert value(text.repair_replacement(F.lit("don�t"))) == "don’t"
    assert value(text.nfc(F.lit("é"))) == "é"


def test_relevance(spark):
    schema = "id int, answerable boolean, difficulty string, gold_ids array<string>, chunk_id string, keywords array<string>, numbers array<string>, content string, gold_ticker string, ticker string, gold_years array<int>, period_years array<int>, gold_document string, document_id string, gold_pages array<int>, source_pages array<int>"
    base = (True, "L1", ["A-1"], "a_2", ["net", "sales"], ["500"], "Net sales were 500", "AAPL", "aapl", [2024], [2024], "a", "b", [3], [3])
    change = lambda **k: tuple(k.get(n, v) for n, v in zip([x.split()[0] for x in schema.split(", ")][1:], base, strict=True))
    cases = [(change(), True), (change(answerable=False), False), (change(difficulty="L5"), False), (change(ticker="NVDA"), False), (change(chunk_id="a-1", ticker="NVDA"), True), (change(chunk_id="a-1", content="none", ticker="NVDA"), False), (change(period_years=[2020]), False), (change(period_years=[2020], difficulty="L4"), True), (change(gold_pages=[9]), False), (change(gold_pages=None), True), (change(content="net loss"), False)]
    got = relevance.is_relevant(spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], schema)).collect()
    assert {r.id: r.relevant for r in got} == {i: c[1] for i, c in enumerate(cases)}


def test_filters(spark):
    rows = [(1, "AAPL", "d1", 2024, [2024, 2023], "notes", "FY", "10-K", True, True), (2, "NVDA", "d2", 2023, [2023], "mda", "Q1", "10-Q", False, True)]
    df = spark.createDataFrame(rows, "id int, ticker string, document_id string, fiscal_year int, period_years array<int>, statement_type string, fiscal_period string, form_type string, contains_table boolean, contains_text boolean")
    ids = lambda **k: sorted(r.id for r in df.filter(search.payload_filter(**k)).collect())
    assert (ids(), ids(ticker="aapl"), ids(fiscal_year=2023), ids(period_year=2024), ids(fiscal_period="q1"), ids(contains_table=True, statement_type="mda")) == ([1, 2], [1], [1, 2], [1], [2], [])
    assert search.is_selective(ticker="a", fiscal_year=1) and not search.is_selective(ticker="a", period_year=1)
    with pytest.raises(ValueError):
        search.payload_filter(colour="red")


def test_empty_search(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.lexical_topk(docs, items, 3).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search.dense_topk(vectors, spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "acme_2023_10k.txt").write_text("one\ftwo\fthree")
    (tmp_path / "other.bin").write_bytes(b"\0")
    got = store.read_pages(spark, str(tmp_path), 2, 3)
    assert sorted((r.document_id, r.pdf_page, r.raw_text) for r in got.collect()) == [("acme_2023_10k", 2, "two"), ("acme_2023_10k", 3, "three")]
    assert got.select(store.corpus_fields(F.col("document_id")).alias("f")).first().f == ("ACME", 2023)
    with pytest.raises(ValueError):
        store.read_pages(spark, str(tmp_path), 3, 2)
    gold = tmp_path / "gold.jsonl"
    gold.write_text("# head\n\n" + "\n".join(json.dumps(x) for x in ({"id": "1", "difficulty": "L1"}, {"id": "2", "difficulty": "L5"}, {"id": "3", "answerable": False})))
    ask, decline = store.split_by_level(store.read_gold(spark, str(gold)))
    assert (sorted(r.id for r in ask.collect()), sorted(r.id for r in decline.collect())) == (["1"], ["2", "3"])
    chunks = spark.createDataFrame([("a", "m1", "x"), ("b", "m2", "y")], "chunk_id string, method string, content string")
    store.write_chunks(chunks, str(tmp_path / "c"), ["method"])
    assert store.read_chunks(spark, str(tmp_path / "c"), "chunk_id string, method string, content string").count() == 2


def test_layout_engine_by_runs(spark):
    pages = spark.createDataFrame([("d", n, f"raw{n}") for n in (1, 2, 3, 7, 8)] + [("e", 1, "x")], "document_id string, pdf_page int, raw_text string")
    engine = lambda d, first, last: {p: f"####### {d} {first}-{last}\n# {p}" for p in range(first, last + 2) if p != 8}
    got = {(r.document_id, r.pdf_page): r.markdown for r in store.apply_by_runs(pages, engine).collect()}
    assert got == {("d", p): f"###### d 1-3\n# {p}" for p in (1, 2, 3)} | {("d", 7): "###### d 7-8\n# 7", ("d", 8): None, ("e", 1): "###### e 1-1\n# 1"}


def test_adapters(spark):
    calls = []

    def broken(x):
        calls.append(x)
        raise ConnectionError

    def answers(*given):
        left = list(given)

        def adapter(x):
            calls.append(x)
            got = left.pop(0)
            if isinstance(got, Exception):
                raise got
            return got

        return adapter

    pauses = []
    call = lambda *adapters: store.with_fallback(list(adapters), sleep=pauses.append)("q")
    assert call(broken, lambda x: None, lambda x: x.upper()) == "Q" and len(calls) == 3 and pauses == [2.0, 4.0, 2.0, 4.0]
    calls.clear()
    assert call(answers(store.ServiceError(429), " ", "yes")) == "yes" and len(calls) == 3
    calls.clear()
    assert call(answers(store.ServiceError(401)), answers("b")) == "b" and len(calls) == 2
    assert call(answers(*[store.ServiceError(503)] * 3)) is None
    df = spark.createDataFrame([("a",), (None,)], "q string")
    assert sorted(str(r.answer) for r in store.apply_adapter(df, "q", lambda x: x * 2, "answer").collect()) == ["None", "aa"]


def test_ingest_skips_what_is_there(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for n, rows in enumerate([[(1, "a"), (2, "b"), (2, "b")], [(2, "b"), (3, "c")]]):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"id": i, "v": v}) for i, v in rows))
        stream = spark.readStream.schema("id long, v string").json(str(source))
        ingest(stream, lambda df: df.withColumn("v", F.upper("v")), out, ["id"], str(tmp_path / "state")).awaitTermination()
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [(1, "A"), (2, "B"), (3, "C")]
