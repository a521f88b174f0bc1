"""Ordered operators: runs, windows over tokens and characters, running sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contiguous_runs(df: DataFrame, keys: list[str], number: str, most: int = 10) -> DataFrame:
    """(keys, first, last, n): runs of consecutive numbers, cut after `most` of them; repeated numbers count once."""
    w = Window.partitionBy(*keys).orderBy(number)
    once = df.select(*keys, F.col(number).cast("long").alias(number)).filter(F.col(number).isNotNull()).distinct()
    once = once.withColumn("island", F.col(number) - F.row_number().over(w))
    part = F.floor((F.row_number().over(Window.partitionBy(*keys, "island").orderBy(number)) - 1) / most)
    return once.withColumn("part", part).groupBy(*keys, "island", "part").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("island", "part")


def window_count(n: Column, size: int, step: int) -> Column:
    """Windows of `size` at `step` that cover n items; none for none."""
    return F.when(n <= 0, 0).otherwise(F.ceil(F.greatest(n - size, F.lit(0)) / step) + 1).cast("int")


def token_windows(df: DataFrame, keys: list[str], tokens: Column, size: int = 512, overlap: int = 100) -> DataFrame:
    """(keys, chunk_no, token_count, tokens): closed form, no loop over a document."""
    step = size - overlap
    rows = df.select(*keys, tokens.alias("_t"))
    rows = rows.withColumn("chunk_no", F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), window_count(F.size("_t"), size, step) - 1)), lambda _: F.size("_t") > 0)))
    piece = F.slice("_t", (F.col("chunk_no") * step + 1).cast("int"), size)
    return rows.select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), F.size(piece).cast("long").alias("token_count"), piece.alias("tokens"))


def character_windows(df: DataFrame, keys: list[str], content: str, size: int = 1024, overlap: int = 30) -> DataFrame:
    """(keys, chunk_no, content): windows over characters, stripped; blank ones are left out."""
    step = size - overlap
    n = F.length(F.coalesce(F.col(content), F.lit("")))
    rows = df.withColumn("chunk_no", F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), window_count(n, size, step) - 1)), lambda _: n > 0)))
    piece = F.regexp_replace(F.substring(F.col(content), F.col("chunk_no") * step + 1, F.lit(size)), r"^\s+|\s+$", "")
    return rows.select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), piece.alias("content")).filter("content <> ''")


def running_sections(df: DataFrame, keys: list[str], position: str, is_heading: Column) -> DataFrame:
    """df with `section_no`: the number of headings up to a line, in order."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("section_no", F.sum(is_heading.cast("long")).over(w))


def first_by(df: DataFrame, keys: list[str], value: str, position: str) -> DataFrame:
    """(keys, value): the value at the smallest position."""
    return df.groupBy(*keys).agg(F.min_by(value, position).alias(value))


def with_neighbours(pages: DataFrame, keys: list[str], number: str, content: str) -> DataFrame:
    """pages with the content of the pages before and after, null where these numbers are missing."""
    w = Window.partitionBy(*keys).orderBy(number)
    near = lambda c, n, d: F.when(n == F.col(number) + d, c)
    return pages.withColumn("prev_content", near(F.lag(content).over(w), F.lag(number).over(w), -1)).withColumn("next_content", near(F.lead(content).over(w), F.lead(number).over(w), 1))


def joined_in_order(df: DataFrame, keys: list[str], position: str, content: str, separator: str = "\n\n", most: int | None = None) -> DataFrame:
    """(keys, content): texts joined in order, the first `most` of them if given."""
    ordered = F.array_sort(F.collect_list(F.struct(position, content)))
    ordered = ordered if most is None else F.slice(ordered, 1, most)
    return df.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[content]), separator).alias(content))


def tabular_words(words: DataFrame, keys: list[str], height: Column) -> DataFrame:
    """(keys, likely_tabular): whether numeric words stand in columns by their right edges.

    words(keys, x1, y0, text): within the margins of 5 and 94 percent of the page's height; right edges cluster against
    a running mean, within 8 points. A page without such words has no columns. An Arrow function per page, as the running mean depends on the order.
    """
    import pyarrow as pa

    numeric = words.filter(F.col("text").rlike(r"^[$₫€£¥(]*-?\d[\d.,]*[)%]*$") & (F.col("y0") > 0.05 * height) & (F.col("y0") < 0.94 * height))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema if f.name in keys)

    def cluster(key, table):
        points = sorted(zip(table["x1"].to_pylist(), table["y0"].to_pylist(), strict=True))
        columns: list[list] = []
        if len(points) >= 4:
            for x, y in points:
                for c in columns:
                    if abs(x - c[0]) <= 8.0:
                        c[0] += (x - c[0]) / (len(c[1]) + 1)
                        c[1].append(y)
                        break
                else:
                    columns.append([x, [y]])
        heights = []
        for _, ys in columns:
            if len(ys) >= 3:
                n, last = 0, None
                for y in sorted(ys):
                    if last is None or y - last >= 7.0:
                        n, last = n + 1, y
                heights.append(n)
        good = [n for n in heights if n >= 3]
        likely = any(n >= 5 for n in heights) or (len(good) >= 2 and sum(good) >= 6)
        return pa.table({k: [v.as_py()] for k, v in zip(keys, key, strict=True)} | {"likely_tabular": [likely]})

    found = numeric.groupBy(*keys).applyInArrow(cluster, f"{schema}, likely_tabular boolean")
    return words.select(*keys).distinct().join(found, keys, "left").select(*keys, F.coalesce("likely_tabular", F.lit(False)).alias("likely_tabular"))
