"""Canonical blocks of pages, and tables and sections stitched across pages.

Blocks are made page by page without a shuffle. Stitching depends on the order of a document's blocks, so it runs once
per document over blocks sorted by page and number; a document is the largest group.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as text_functions
from ledgerloom.functions import vocab

BLOCK = "document_id string, pdf_page int, block_no int, kind string, block_id string, table_id string, level int, text string, code string, title string, headers array<string>, rows array<array<string>>"
_LIST, _ROWS = pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))
_BLOCK_ARROW = pa.schema(
    [("document_id", pa.string()), ("pdf_page", pa.int32()), ("block_no", pa.int32()), ("kind", pa.string()), ("block_id", pa.string()), ("table_id", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("code", pa.string()), ("title", pa.string()), ("headers", _LIST), ("rows", _ROWS)]
)

_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
_NUMBERED = re.compile(r"^(note|thuyết\s+minh|item|part)\s+([0-9ivx]+[a-z]?(?:\.[0-9a-z]+)*)[.\-:–—) ]*(.*)$|^([0-9ivx]+[a-z]?(?:\.[0-9a-z]+)*)[.\-:–—)]*\s+(.+)$", re.I)
_UNIT_TAIL = re.compile(r"\s*(\((?:amounts?\s+)?in\s+(?:millions?|thousands?|billions?)[^)]*\))\s*$", re.I)
_RULE = re.compile(r"^\|?\s*(?::?-+:?\s*\|\s*)*:?-+:?\s*\|?$")
_TOP = re.compile(r"^(?:(?:NOTE|THUYẾT\s+MINH|ITEM|MỤC)\s*\d|PART\s+[IVX]+|FORM\s+10-[KQ])")
_CONTINUED = re.compile(vocab.CONTINUED_HEADING, re.I)
_FOOTNOTE = re.compile(vocab.FOOTNOTE, re.I)


def fiscal_calendar(blocks: DataFrame, cover_pages: int = 4, pages: int = 15, longest: int = 200) -> DataFrame:
    """(document_id, suffix): the end of each document's fiscal year as -MM-DD, null if it doesn't say.

    blocks(document_id, pdf_page, block_no, text). First the words of the cover on one of the first pages, all of a page's
    blocks read as one text; else those of a statement's heading in a short block of the first 15 pages. The first in order.
    """
    place = F.dense_rank().over(Window.partitionBy("document_id").orderBy("pdf_page"))
    rows = blocks.withColumn("place", place).filter(F.col("place") <= pages)
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda b: F.coalesce(b["text"], F.lit(""))), " ")
    cover = rows.filter(F.col("place") <= cover_pages).groupBy("document_id", "place").agg(ordered.alias("text")).select("document_id", F.lit(1).alias("tier"), "place", F.lit(0).alias("block_no"), text_functions.fiscal_suffix(F.col("text")).alias("suffix"))
    heads = rows.filter(F.length("text") <= longest).select("document_id", F.lit(2).alias("tier"), "place", "block_no", text_functions.fiscal_suffix(F.col("text"), cover=False).alias("suffix"))
    found = cover.unionByName(heads).filter("suffix is not null").groupBy("document_id").agg(F.min_by("suffix", F.struct("tier", "place", "block_no")).alias("suffix"))
    return blocks.select("document_id").distinct().join(found, "document_id", "left")


def split_cells(line: str) -> list[str]:
    """Trimmed cells of a pipe row; escaped pipes stay."""
    body = line.strip()
    if "\\" not in body:
        return [c.strip() for c in body.removeprefix("|").removesuffix("|").split("|")]
    body = body[1:] if body.startswith("|") else body
    body = body[:-1] if body.endswith("|") and not body.endswith("\\|") else body
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", body)]


def is_top_heading(text: str) -> bool:
    """A note, item or part with its number, a form, or one of the main statements."""
    s = text.strip().upper()
    return bool(_TOP.match(s)) or "CONSOLIDATED STATEMENTS" in s or "CONSOLIDATED BALANCE SHEETS" in s


def page_blocks(document_id: str | None, page: int | None, markdown: str | None) -> list[dict]:
    """Blocks of one page in order: every line of text is its own, a table takes all of its lines.

    A unit in parentheses at a heading's end becomes a paragraph of its own. A heading's number is the section of the
    tables and paragraphs up to the next one.
    """
    lines = (markdown or "").splitlines()
    out: list[dict] = []
    code = title = None
    n_tables = i = 0

    def add(kind, text=None, **more):
        no = len(out) + 1
        out.append({"document_id": document_id, "pdf_page": page, "block_no": no, "kind": kind, "block_id": f"p{page}_b{no:02d}", "table_id": None, "level": None, "text": text, "code": code, "title": title, "headers": None, "rows": None, **more})

    while i < len(lines):
        line = lines[i].strip()
        if line.startswith("|") and i + 1 < len(lines) and lines[i + 1].strip().startswith("|") and _RULE.match(lines[i + 1].strip()) and not _RULE.match(line):
            end = i + 2
            while end < len(lines) and lines[end].strip().startswith("|"):
                end += 1
            n_tables += 1
            add("table", table_id=f"p{page}_t{n_tables:02d}", headers=split_cells(line), rows=[split_cells(x) for x in lines[i + 2 : end]])
            i = end
            continue
        i += 1
        if not line:
            continue
        head = line[0] == "#" and _HEADING.match(line)
        if not head:
            add("paragraph", line)
            continue
        name = head[2].strip().strip("*").strip()
        unit = _UNIT_TAIL.search(name)
        name = _UNIT_TAIL.sub("", name) if unit else name
        if name:
            m = _NUMBERED.match(name)
            if m:
                code = m[2] or m[4]
                title = f"{m[1]} {m[2]} {m[3]}".strip() if m[1] else m[5].strip()
            add("heading", name, level=len(head[1]))
        if unit:
            add("paragraph", unit[1])
    return out


def blocks(pages: DataFrame) -> DataFrame:
    """Blocks of every page of pages(document_id, pdf_page, markdown); page by page, without a shuffle."""

    def run(batches):
        for b in batches:
            rows = [x for d, n, m in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for x in page_blocks(d, n, m)]
            yield pa.RecordBatch.from_pylist(rows, _BLOCK_ARROW)

    return pages.selectExpr("cast(document_id as string)", "cast(pdf_page as int)", "cast(markdown as string)").mapInArrow(run, BLOCK)


def header_match(a: list[str], b: list[str]) -> float:
    """Share of columns whose headers are alike, years aside; 0 for widths that differ by more than one."""
    if not a or not b or abs(len(a) - len(b)) > 1:
        return 0.0
    plain = lambda h: re.sub(r"(?:19|20)\d{2}", "<year>", h.lower()).strip()
    alike = sum(x == y or SequenceMatcher(None, x, y).ratio() >= 0.80 for x, y in zip(map(plain, a), map(plain, b), strict=False))
    return alike / max(len(a), len(b))


@dataclass
class Table:
    table_id: str
    headers: list[str]
    rows: list[list[str]]
    pages: list[int]
    sources: list[str]
    heading: str
    footnotes: list[str] = field(default_factory=list)


@dataclass
class Section:
    code: str | None
    title: str | None
    pages: list[int]
    text: str = ""
    blocks: list[str] = field(default_factory=list)


@dataclass
class Document:
    tables: list[Table]
    sections: list[Section]
    links: list[tuple[str, str, int, int]]
    #: (block, section number, table number or None, whether it is a footnote), in order
    trace: list[tuple[dict, int, int | None, bool]]


def _open_sentence(text: str) -> bool:
    return bool(text.strip()) and text.strip()[-1] not in '.?!:"”)'


def _goes_on(text: str) -> bool:
    c = text.strip()[:1]
    return bool(c) and (c.islower() or c.isdigit() or c in "(,-")


def continues_section(heading: str, section: Section | None, page: int) -> bool:
    """Whether a heading with a word for `continued` belongs to the open section: the same number, or a neighbouring page and a number that was misread."""
    low = heading.lower()
    if section is None or not ("continued" in low or "tiếp theo" in low or "(cont" in low):
        return False
    m = _CONTINUED.search(heading)
    new, old = (m[1].lower() if m else ""), (section.code or "").lower()
    if new and new == old:
        return True
    if page - (section.pages[-1] if section.pages else page) not in (0, 1):
        return False
    if not new or not old:
        return True
    near = len(new) == len(old) and sum(a != b for a, b in zip(new, old, strict=True)) <= 1
    within = abs(len(new) - len(old)) == 1 and (new in old or old in new)
    return near or within or SequenceMatcher(None, new, old).ratio() >= 0.70 or _open_sentence(section.text)


def stitch(items: list[dict]) -> Document:
    """Tables and sections of one document's blocks, sorted by page and number.

    A table goes on with the open one if no heading came between, it is among the first three blocks of the next page
    and the first table there, and its headers match or are empty over rows of the same width. A footnote goes to the
    table above it, on its page or at the top of the next.
    """
    doc = Document([], [Section(None, None, [])], [], [])
    current: Table | None = None
    chain, anchor = False, None
    seen_table: set[int] = set()
    heading = ""
    for b in items:
        page, section = b["pdf_page"], doc.sections[-1]
        if b["kind"] == "heading":
            chain, heading = False, b["text"]
            if is_top_heading(heading):
                current = anchor = None
            if continues_section(heading, section, page):
                if section.pages and page != section.pages[-1]:
                    doc.links.append(("section", section.title or heading, section.pages[-1], page))
            elif is_top_heading(heading) or b["code"] != section.code:
                section = Section(b["code"], b["title"] or heading, [])
                doc.sections.append(section)
            doc.trace.append((b, len(doc.sections) - 1, None, False))
        elif b["kind"] == "table":
            same = current is not None and chain and page == current.pages[-1] + 1 and b["block_no"] <= 3 and page not in seen_table
            bare = not any(b["headers"]) and current is not None and current.rows and len(b["headers"]) == len(current.rows[0])
            if same and (header_match(current.headers, b["headers"]) >= 0.75 or bare):
                current.rows += b["rows"]
                current.pages.append(page)
                current.sources.append(b["table_id"])
                doc.links.append(("table", current.table_id, page - 1, page))
            else:
                current = Table(b["table_id"], b["headers"], list(b["rows"]), [page], [b["table_id"]], heading)
                doc.tables.append(current)
            chain, anchor = True, current
            seen_table.add(page)
            doc.trace.append((b, len(doc.sections) - 1, len(doc.tables) - 1, False))
        else:
            text = b["text"]
            last = anchor.pages[-1] if anchor else None
            note = anchor is not None and _FOOTNOTE.match(text) and (page == last or (page == last + 1 and b["block_no"] <= 3 and page not in seen_table))
            if note:
                anchor.footnotes.append(text)
                doc.links += [("footnote", anchor.table_id, last, page)] if page != last else []
            elif section.text and page not in section.pages and _open_sentence(section.text) and _goes_on(text):
                section.text += " " + text
                doc.links.append(("sentence", section.title or "", section.pages[-1] if section.pages else page, page))
            else:
                section.text += ("\n\n" if section.text else "") + text
            doc.trace.append((b, len(doc.sections) - 1, doc.tables.index(anchor) if note else None, bool(note)))
        section = doc.sections[-1]
        section.blocks.append(b["block_id"])
        if page not in section.pages:
            section.pages.append(page)
    return doc


def per_document(block_rows: DataFrame, work: Callable[[list[dict]], list[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    """work(blocks of one document in order) for every document, as rows of the schema.

    Documents are dealt by id, sorted within a task and streamed, so that many small ones cost no more than their rows;
    one document's blocks are in memory at a time. Pages (document_id, pdf_page, markdown) can be given in the place of
    their blocks, which are then made in the same pass and not shuffled.
    """
    if "markdown" in block_rows.columns:
        return _per_document_of_pages(block_rows, work, schema, arrow)

    def run(batches):
        held: list[dict] = []
        for b in batches:
            out: list[dict] = []
            for r in b.to_pylist():
                if held and held[0]["document_id"] != r["document_id"]:
                    out += work(held)
                    held = []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if held:
            yield pa.RecordBatch.from_pylist(work(held), arrow)

    dealt = block_rows.repartition("document_id").sortWithinPartitions("document_id", "pdf_page", "block_no")
    return dealt.mapInArrow(run, schema)


def _per_document_of_pages(pages: DataFrame, work: Callable[[list[dict]], list[dict]], schema: str, arrow: pa.Schema) -> DataFrame:
    def made(name: str | None, held: list[tuple[int | None, str | None]]) -> list[dict]:
        items = [x for page, markdown in held for x in page_blocks(name, page, markdown)]
        if len({page for page, _ in held}) < len(held):  # the blocks of a page given twice are in order of their numbers
            items.sort(key=lambda x: (x["pdf_page"] is not None, x["pdf_page"] or 0, x["block_no"]))
        return work(items) if items else []

    def run(batches):
        name, held = None, []
        for b in batches:
            out: list[dict] = []
            for d, page, markdown in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held and d != name:
                    out += made(name, held)
                    held = []
                name = d
                held.append((page, markdown))
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)
        if held:
            yield pa.RecordBatch.from_pylist(made(name, held), arrow)

    rows = pages.selectExpr("cast(document_id as string) document_id", "cast(pdf_page as int) pdf_page", "cast(markdown as string) markdown")
    return rows.repartition("document_id").sortWithinPartitions("document_id", "pdf_page").mapInArrow(run, schema)


def stitched_tables(block_rows: DataFrame) -> DataFrame:
    """(document_id, table_no, table_id, heading, headers, rows, source_pages, source_tables, footnotes, is_multi_page)."""

    def work(rows: list[dict]) -> list[dict]:
        doc = stitch(rows)
        return [{"document_id": rows[0]["document_id"], "table_no": i, "table_id": t.table_id, "heading": t.heading, "headers": t.headers, "rows": t.rows, "source_pages": t.pages, "source_tables": t.sources, "footnotes": t.footnotes, "is_multi_page": len(t.pages) > 1} for i, t in enumerate(doc.tables)]
    arrow = pa.schema([("document_id", pa.string()), ("table_no", pa.int32()), ("table_id", pa.string()), ("heading", pa.string()), ("headers", _LIST), ("rows", _ROWS), ("source_pages", pa.list_(pa.int32())), ("source_tables", _LIST), ("footnotes", _LIST), ("is_multi_page", pa.bool_())])
    return per_document(block_rows, work, "document_id string, table_no int, table_id string, heading string, headers array<string>, rows array<array<string>>, source_pages array<int>, source_tables array<string>, footnotes array<string>, is_multi_page boolean", arrow)


def stitched_sections(block_rows: DataFrame) -> DataFrame:
    """(document_id, section_no, code, title, text, source_pages, n_blocks); sections without blocks are left out."""

    def work(rows: list[dict]) -> list[dict]:
        return [{"document_id": rows[0]["document_id"], "section_no": i, "code": s.code, "title": s.title, "text": s.text, "source_pages": s.pages, "n_blocks": len(s.blocks)} for i, s in enumerate(stitch(rows).sections) if s.blocks]
    arrow = pa.schema([("document_id", pa.string()), ("section_no", pa.int32()), ("code", pa.string()), ("title", pa.string()), ("text", pa.string()), ("source_pages", pa.list_(pa.int32())), ("n_blocks", pa.int32())])
    return per_document(block_rows, work, "document_id string, section_no int, code string, title string, text string, source_pages array<int>, n_blocks int", arrow)


def page_links(block_rows: DataFrame) -> DataFrame:
    """(document_id, kind, name, from_page, to_page): what goes on across pages."""

    def work(rows: list[dict]) -> list[dict]:
        return [{"document_id": rows[0]["document_id"], "kind": k, "name": n, "from_page": a, "to_page": b} for k, n, a, b in stitch(rows).links]
    arrow = pa.schema([("document_id", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("from_page", pa.int32()), ("to_page", pa.int32())])
    return per_document(block_rows, work, "document_id string, kind string, name string, from_page int, to_page int", arrow)
