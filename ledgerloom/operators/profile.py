"""Page profiles from positioned text blocks, images and fonts: body text, features and class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators.quality import page_class

CHART = r"(?i)(stock )?performance graph|cumulative total (shareholder )?return|total shareholder return|the following graph|the graph (below|above|shows)|shareholder return graph|(five|5)-year cumulative total|biểu đồ|đồ thị"
RUNNING = r"(?i)table of contents|form 10-[kq]|annual report|all rights reserved|\bpage\b|©|^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$"


def is_margin_block(content: Column, y0: Column, y1: Column, height: Column, from_end: Column) -> Column:
    """Whether a block is a running header or footer: by its place and words, or a page number or copyright line among the last two."""
    plain = F.trim(content)
    one = F.size(F.split(plain, "\n")) == 1
    header = ((y1 < 0.08 * height) & plain.rlike(RUNNING)) | ((y1 < 0.04 * height) & one)
    footer = (y0 > 0.94 * height) & (plain.rlike(RUNNING) | one)
    tail = (from_end < 2) & (y0 > 0.40 * height) & (plain.rlike(r"^[-–—]?\s*\d{1,4}\s*[-–—]?$") | plain.rlike(r"(?i)all rights reserved|©\s*\d{4}|\(c\)\s*\d{4}"))
    return header | footer | tail


def body_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, raw_text): a page's blocks in order without its running headers and footers; all of them if nothing else is left.

    blocks(keys, block_no, y0, y1, height, text).
    """
    back = Window.partitionBy(*keys).orderBy(F.desc("block_no"))
    marked = blocks.withColumn("_margin", is_margin_block(F.col("text"), F.col("y0"), F.col("y1"), F.col("height"), F.row_number().over(back) - 1))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "text", "_margin")))
    rows = marked.groupBy(*keys).agg(ordered.alias("b"))
    body = F.array_join(F.transform(F.filter("b", lambda x: ~x["_margin"]), lambda x: x["text"]), "\n")
    return rows.select(*keys, F.when(F.trim(body) != "", body).otherwise(F.array_join(F.transform("b", lambda x: x["text"]), "\n")).alias("raw_text"))


def image_coverage(images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, max_image, total_image): shares of the page that images cover, each and together, 1 at most. images(keys, width, height, page_area)."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("width") * F.col("height") / F.greatest(F.lit(1.0), F.col("page_area"))))
    return images.groupBy(*keys).agg(F.max(share).alias("max_image"), F.least(F.lit(1.0), F.sum(share)).alias("total_image"))


def font_signals(fonts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, type3, suspicious_font): fonts without outlines, and names that tell of text recognition. fonts(keys, font_type, name)."""
    odd = F.lower("name").rlike("glyphless|hidden|invisible|ocr|tesseract")
    return fonts.groupBy(*keys).agg(F.max(F.col("font_type") == "Type3").alias("type3"), F.max(F.coalesce(odd, F.lit(False))).alias("suspicious_font"))


def profile(pages: DataFrame, keys: list[str], images: DataFrame | None = None, fonts: DataFrame | None = None) -> DataFrame:
    """(keys, raw_text, language, n_chars, n_words, ratios, max_image, total_image, page_class) of pages(keys, raw_text)."""
    p = pages
    p = p.join(image_coverage(images, keys), keys, "left") if images is not None else p.withColumn("max_image", F.lit(0.0)).withColumn("total_image", F.lit(0.0))
    p = p.join(font_signals(fonts, keys), keys, "left") if fonts is not None else p.withColumn("type3", F.lit(False)).withColumn("suspicious_font", F.lit(False))
    p = p.fillna({"max_image": 0.0, "total_image": 0.0, "type3": False, "suspicious_font": False})
    raw = F.coalesce("raw_text", F.lit(""))
    p = p.withColumn("n_chars", F.length(F.trim(raw))).withColumn("n_words", F.size(F.filter(F.split(raw, r"\s+"), lambda w: w != "")))
    p = p.withColumn("ratios", text.character_ratios(raw)).withColumn("language", text.language_evidence(raw)).withColumn("vector_chart", raw.rlike(CHART))
    bad = F.greatest("ratios.replacement", "ratios.private_use", "ratios.control")
    kind = page_class(F.col("n_chars"), F.col("n_words"), F.col("max_image"), F.col("total_image"), bad, F.col("suspicious_font"), F.col("type3"), F.col("vector_chart"))
    return p.withColumn("page_class", kind)
