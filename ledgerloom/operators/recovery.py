"""Text that a layout engine dropped: rows of a table that goes on, tables that are none, and missing blocks.

A page is looked at with its neighbours' outputs, which `windows.with_neighbours` puts beside it; each page is then a row
of its own, so nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.operators.chunking import render
from ledgerloom.operators.structure import page_blocks

#: Least characters of a block that can be missed; a cell that swallowed text; the band of running headers, in points.
LEAST, HUGE, MARGIN = 25, 500, 40.0
NOTE = "### Recovered content"

_AMOUNT = re.compile(r"^[$₫€£¥]?\s*\(?[\d,.\s]+%?\)?$")
_PERIOD = re.compile(r"(?:months?|years?|quarter) ended|^as of|at (?:december|september|march|june)|\b(?:target|actual|budget|forecast|variance|estimate|projected|description|category)\b", re.I)
_YEAR = re.compile(r"^(?:(?:19|20)\d{2}|q[1-4](?:\s*(?:19|20)\d{2})?)$", re.I)


def plain(text: str) -> str:
    return re.sub(r"[^a-zA-Z0-9]+", " ", text.lower()).strip()


def present(passage: str, content: str) -> bool:
    """Whether plain content has two of three runs of five words of a passage; a shorter one as a whole."""
    w = plain(passage).split()
    if len(w) < 5:
        return " ".join(w) in content
    runs = [w[:5], w[len(w) // 2 :][:5], w[-5:]]
    return sum(" ".join(r) in content for r in runs) >= 2


def repair(text: str) -> str:
    """Replacement characters: a dash between digits, an apostrophe between letters, else a space."""
    text = re.sub(r"(\d)\s*�\s*(\d)", r"\1 - \2", text)
    text = re.sub(r"([^\W\d_])�([^\W\d_])", r"\1'\2", text).replace("�", " ")
    return re.sub(r"[ \t]+", " ", text).strip()


def is_header(cells: list[str]) -> bool:
    """Column labels: periods or years, or cells that aren't mostly amounts."""
    rest = [c for c in cells[1:] if c]
    if _PERIOD.search(" ".join(cells)) or (cells and _YEAR.match(cells[0])):
        return True
    if not rest:
        return False
    return all(_YEAR.match(c) for c in rest) or sum(c in ("-", "—", "–", "N/A") or bool(_AMOUNT.match(c)) for c in rest) < 0.5 * len(rest)


def _tables(markdown: str) -> tuple[list[dict], list[dict]]:
    found = page_blocks("", 0, markdown)
    return found, [b for b in found if b["kind"] == "table"]


def continued_table(blocks: list[dict], markdown: str, before: str | None) -> str | None:
    """The page with its first rows as a table under the headers of the table that ends the page before; null if they are none."""
    found, tables = _tables(before or "")
    if not tables or len(tables[-1]["headers"]) < 2 or not any(tables[-1]["headers"][1:]):
        return None
    after = found[found.index(tables[-1]) + 1 :]
    if sum(len(b["text"] or "") for b in after if b["kind"] == "paragraph" and len(b["text"]) > 30) >= 100:
        return None
    headers = tables[-1]["headers"]
    own = _tables(markdown)[1]
    if own and sum(len(t["rows"]) for t in own) >= 2:
        first = own[0]["headers"]
        if is_header(first) or len(first) != len(headers) or not first[0]:
            return None
        rest = [b["text"] if b["kind"] != "table" else render(b["headers"], b["rows"]) for b in _tables(markdown)[0] if b is not own[0]]
        rest = [x for x in rest if x != render(own[0]["headers"], own[0]["rows"])]
        return "\n\n".join([render(headers, [first, *own[0]["rows"]]), *rest])
    rows: list[list[str]] = []
    for b in blocks:
        lines = re.sub(r"(?m)^\s*([$€£¥])\s*\n", r"\1 ", b["text"]).split("\n")  # a currency sign belongs to the next cell
        cells = [x.strip() for x in lines if x.strip()]
        if b["y0"] > 120 or len(cells) != len(headers) or is_header(cells):
            break
        rows.append(cells)
    if not rows:
        return None
    return "\n\n".join([render(headers, rows), *[repair(b["text"]) for b in blocks[len(rows) :] if not re.fullmatch(r"\s*\d{1,4}\s*", b["text"])]])


def is_degenerate(markdown: str, raw: str) -> bool:
    """Tables without rows, or one of a single row on a page of text that it swallowed or lost."""
    tables = _tables(markdown)[1]
    rows = [r for t in tables for r in t["rows"]]
    if not tables:
        return False
    if not rows:
        return True
    if len(tables) > 1 or len(rows) > 1 or len(raw) <= 500:
        return False
    words, known = plain(raw).split(), set(plain(markdown).split())
    return any(len(c) >= HUGE for r in rows for c in r) or (bool(words) and sum(w in known for w in words) < 0.70 * len(words))


def missing_blocks(blocks: list[dict], height: float, outputs: list[str]) -> list[tuple[float, str]]:
    """(place, text) of the paragraphs that none of the outputs has; page numbers and the like in the margins aside."""
    have = [plain(x) for x in outputs]
    out = []
    for b in blocks:
        margin = b["y0"] < MARGIN or b["y1"] > height - MARGIN
        if margin and (re.fullmatch(r"\s*\d{1,4}\s*", b["text"]) or "table of contents" in b["text"].lower()):
            continue
        for p in re.split(r"\n\s*\n", b["text"]):
            if len(p.strip()) >= LEAST and not any(present(p, h) for h in have):
                out.append((b["y0"], repair(p)))
    return out


def recover_page(blocks: list[dict], height: float, markdown: str, raw: str, before: str | None, after: str | None) -> tuple[str, str]:
    """(markdown, action) of one page: reconstructed_table_continuation, reconstructed_false_table, appended_orphan_blocks or untouched."""
    table = continued_table(blocks, markdown, before)
    if table is not None:
        return table, "reconstructed_table_continuation"
    if is_degenerate(markdown, raw):
        return "\n\n".join(x for x in (repair(b["text"]) for b in blocks) if x), "reconstructed_false_table"
    lost = missing_blocks(blocks, height, [markdown, before or "", after or ""])
    if not lost:
        return markdown, "untouched"
    top = [t for y, t in lost if y < 0.35 * height]
    rest = [t for y, t in lost if y >= 0.35 * height]
    parts = [*top, markdown, *([NOTE, *rest] if rest else [])]
    return "\n\n".join(p for p in parts if p), "appended_orphan_blocks"


def recover(pages: DataFrame) -> DataFrame:
    """pages with `recovered` and `action`.

    pages(blocks array<struct<y0, y1, text>>, page_height, markdown, raw_text, prev_content, next_content) and any others.
    """
    names = [c for c in pages.columns if c not in ("recovered", "action")]
    kept = pages.select(*names)

    def run(batches):
        for b in batches:
            get = {c: b.column(c).to_pylist() for c in ("blocks", "page_height", "markdown", "raw_text", "prev_content", "next_content")}
            got = [recover_page(x or [], h or 792.0, m or "", r or "", p, n) for x, h, m, r, p, n in zip(*get.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], [*b.schema.names, "recovered", "action"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("recovered", StringType()), StructField("action", StringType())]))
