"""Sources and sinks: page text, corpora, chunks, points and gold questions, as Spark tables and files."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import windows

PAGES = "document_id string, pdf_page int, raw_text string"


class Extractor(Protocol):
    """Turns the bytes of one document into (page number, text) pairs; runs on executors, once per document."""

    def __call__(self, content: bytes) -> Iterator[tuple[int, str]]: ...


def plain_text(content: bytes) -> Iterator[tuple[int, str]]:
    """Pages of a text file, parted by form feeds."""
    yield from enumerate(content.decode("utf-8", "replace").split("\f"), 1)


#: Extractors by file ending; others can be registered. PDF and layout engines plug in here.
EXTRACTORS: dict[str, Extractor] = {"txt": plain_text, "md": plain_text}


def register_extractor(ending: str, extractor: Extractor) -> None:
    EXTRACTORS[ending.lower().lstrip(".")] = extractor


def read_pages(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """(document_id, pdf_page, raw_text) of every file under path; page numbers from 1, both bounds inclusive.

    document_id is the file's name without its ending. Raises ValueError for an empty range of pages.
    """
    if first is not None and last is not None and last < first or (last is not None and last < 1):
        raise ValueError("the range of pages is empty")
    known = dict(EXTRACTORS if extractors is None else extractors)

    def run(batches):
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                stem, _, ending = file.rpartition("/")[2].rpartition(".")
                if ending.lower() in known:
                    rows = [(n, t) for n, t in known[ending.lower()](content) if (first or 1) <= n <= (last or n)]
                    yield pa.RecordBatch.from_arrays([pa.array([stem] * len(rows), pa.string()), pa.array([n for n, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.string())], ["document_id", "pdf_page", "raw_text"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, PAGES)


class ServiceError(RuntimeError):
    """A service's answer that is no success; adapters raise it with the HTTP status."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"HTTP {status} {message}".strip())
        self.status = status


#: States of a service that pass, so that asking again may help.
PASSING = (429, 500, 502, 503, 504)


def with_fallback(adapters: list[Callable[[str], str | None]], attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], str | None]:
    """One adapter of several: the first that answers; null if none does.

    An adapter is asked up to `attempts` times while it gives no text or raises ConnectionError, TimeoutError or a
    ServiceError that passes, with pauses of wait, wait squared and so on; after any other ServiceError the next adapter is
    asked at once. Other errors are the caller's.
    """

    def call(request: str) -> str | None:
        for adapter in adapters:
            for attempt in range(1, attempts + 1):
                try:
                    answer = adapter(request)
                    if answer is not None and answer.strip():
                        return answer
                except (ConnectionError, TimeoutError):
                    pass
                except ServiceError as error:
                    if error.status not in PASSING:
                        break
                if attempt < attempts:
                    sleep(wait**attempt)
        return None

    return call


def apply_by_runs(pages: DataFrame, engine: Callable[[str, int, int], dict[int, str]], out: str = "markdown", deepest: int = 6) -> DataFrame:
    """pages with what a layout engine makes of them: it is called once for each run of consecutive pages of a document.

    pages(document_id, pdf_page, ...), engine(document_id, first, last) gives texts by page, null where it has none.
    Headings of more than `deepest` marks are cut to that level.
    """
    runs = windows.contiguous_runs(pages.select("document_id", "pdf_page").distinct(), ["document_id"], "pdf_page")

    def run(batches):
        for b in batches:
            rows = [(d, p, t) for d, first, last in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for p, t in sorted(engine(d, first, last).items()) if first <= p <= last]
            clamp = lambda t: None if t is None else re.sub(rf"(?m)^#{{{deepest + 1},}}(?=\s)", "#" * deepest, t)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([clamp(r[2]) for r in rows], pa.string())], ["document_id", "_page", out])

    found = runs.select("document_id", F.col("first").cast("int"), F.col("last").cast("int")).mapInArrow(run, f"document_id string, _page int, {out} string")
    return pages.drop(out).join(found.withColumnRenamed("_page", "pdf_page"), ["document_id", "pdf_page"], "left")


def apply_adapter(df: DataFrame, column: str, adapter: Callable[[str], str | None], out: str) -> DataFrame:
    """df with the adapter's answer for each value of a column; an external model plugs in here, Arrow batch by batch."""
    names = [c for c in df.columns if c != out]
    kept = df.select(*names)

    def run(batches):
        for b in batches:
            got = [None if x is None else adapter(x) for x in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def corpus_fields(document_id: Column) -> Column:
    """struct<ticker, fiscal_year>: the first part of a name in upper case, and its right-most year, 2024 without one."""
    years = F.regexp_extract_all(document_id, F.lit(r"(?<!\d)(?:19|20)\d{2}(?!\d)"), F.lit(0))
    return F.struct(F.upper(F.split(document_id, "[_\\- ]")[0]).alias("ticker"), F.coalesce(F.try_element_at(years, F.lit(-1)).cast("int"), F.lit(2024)).alias("fiscal_year"))


def find_files(names: DataFrame, column: str, companies: list[str], years: list[int]) -> DataFrame:
    """Rows whose name holds one of the companies and one of the years; an empty list asks nothing."""
    low = F.lower(column)
    holds = lambda words: F.lit(not words) | F.exists(F.array(*[F.lit(str(w).lower()) for w in words] or [F.lit("")]), lambda w: F.contains(low, w))
    return names.filter(holds(companies) & holds(years))


def split_by_membership(df: DataFrame, key: str, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among the members, and the others (null keys among these)."""
    keys = members.select(key).distinct()
    return df.join(keys, key, "left_semi"), df.join(keys, key, "left_anti")


def unfinished(df: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Rows that the output lacks; all with force."""
    return df if force else df.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new in place of those with their key; of equal keys within new any one row, the largest, stays.

    Rows of the table are shuffled by key only, and not at all if new is small enough for Spark to broadcast its keys.
    """
    others = [c for c in new.columns if c != key]
    latest = new.groupBy(key).agg(F.max(F.struct(*others)).alias("_row")).select(key, "_row.*")
    return table.join(latest.select(key), key, "left_anti").unionByName(latest.select(*table.columns))


def patch(table: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """table with `columns` taken from new where it has the key and a value; rows that new alone has are not added."""
    short = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns]).dropDuplicates([key])
    joined = table.join(short, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else c for c in table.columns])


def collection_statistics(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, points, with_vector, dimension) of stored points."""
    return points.groupBy(*by).agg(F.count("*").alias("points"), F.count("embedding").alias("with_vector"), F.max(F.size("embedding")).cast("long").alias("dimension"))


def payload(chunks: DataFrame, tickers: list[str]) -> DataFrame:
    """chunks(chunk_id, document_id, ticker, fiscal_year, content, chunk_type) with the fields that searches filter by.

    A missing ticker is the document's first part if it is known; a missing year the document's, else 2025; period
    years are the years of the content, else the fiscal year.
    """
    from ledgerloom.functions import text, vocab

    head = F.upper(F.split("document_id", "_")[0])
    ticker = F.upper(F.coalesce("ticker", F.when(head.isin(*(tickers or vocab.TICKERS)), head)))
    named = F.nullif(F.regexp_extract("document_id", r"(?<!\d)(20\d{2})(?!\d)", 1), F.lit("")).cast("int")
    year = F.coalesce("fiscal_year", named, F.lit(2025))
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(r"(?<!\d)20[12]\d(?!\d)"), F.lit(0)), lambda x: x.cast("int"))))
    rows = chunks.withColumn("ticker", ticker).withColumn("fiscal_year", year).withColumn("period_years", F.when(F.size(found) > 0, found).otherwise(F.array(year)))
    rows = rows.withColumn("document_id", F.lower(F.coalesce("document_id", F.concat_ws("_", F.lower("ticker"), F.col("fiscal_year").cast("string"), F.lit("10k")))))
    flags = text.content_flags(F.col("content"), F.col("chunk_type"))
    rows = rows.withColumn("_f", flags).withColumn("contains_table", F.col("_f.contains_table")).withColumn("contains_text", F.col("_f.contains_text")).drop("_f")
    unit = text.unit_metadata(F.col("content"))
    rows = rows.withColumn("statement_type", text.statement_type(F.substring("content", 1, 120), F.col("content"))).withColumn("currency", unit["currency"]).withColumn("scale", unit["scale"])
    return rows.withColumn("fiscal_period", F.lit("FY")).withColumn("form_type", F.lit("10-K")).withColumn("point_id", text.uuid5(F.col("chunk_id")))


GOLD_SCHEMA = "id string, question string, question_type string, difficulty string, answerable boolean, gold_answer string, document string, gold_chunk_ids string, keywords array<string>"


def read_gold(spark: SparkSession, path: str, schema: str = GOLD_SCHEMA) -> DataFrame:
    """Questions of a file of JSON lines; blank lines and lines that begin with # are skipped, bad lines give nulls."""
    lines = spark.read.text(path).filter(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    return lines.select(F.from_json("value", schema).alias("q")).select("q.*")


def split_by_level(gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions to answer (L1 to L4) and to decline (L5); without a level, by whether they are answerable."""
    declines = F.when(F.col("difficulty").isin("L1", "L2", "L3", "L4"), False).when(F.col("difficulty") == "L5", True).otherwise(~F.coalesce("answerable", F.lit(True)))
    return gold.filter(~declines), gold.filter(declines)


def write_chunks(chunks: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Chunks as JSON lines, in folders by `by`."""
    writer = chunks.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_chunks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks of JSON lines under a declared schema."""
    return spark.read.schema(schema).json(path)


def review_queue(pages: DataFrame, status: str = "status") -> DataFrame:
    """Pages that didn't pass, to be looked at."""
    return pages.filter(F.col(status) != "pass")


def with_row_order(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


_SAFE = re.compile(r"[^A-Za-z0-9._-]+")


def safe_name(name: str) -> str:
    """A name that is a file name everywhere."""
    return _SAFE.sub("_", name).strip("_")


def write_pages(pages: DataFrame, path: str) -> None:
    """Canonical pages as JSON in a folder for each document; a rerun replaces the documents it has."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").json(path)


def read_ordered_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pages written before, with their place in the document by number."""
    pages = spark.read.schema(schema).json(path)
    return with_row_order(pages, ["document_id"], ["pdf_page"], "page_order")


def manifest(pages: DataFrame) -> DataFrame:
    """One row per document: pages, by engine and by state."""
    return pages.groupBy("document_id").agg(F.count("*").alias("pages"), *[F.sum((F.col("status") == s).cast("long")).alias(s) for s in ("pass", "warning", "fail")], F.array_sort(F.collect_set("engine")).alias("engines"))


def create_collection(spark: SparkSession, name: str, dimension: int, recreate: bool = False) -> None:
    """A table of points with vectors and payload, partitioned by method so that searches read one method only."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    fields = "point_id STRING, chunk_id STRING, document_id STRING, ticker STRING, fiscal_year INT, period_years ARRAY<INT>, statement_type STRING, fiscal_period STRING, form_type STRING, contains_table BOOLEAN, contains_text BOOLEAN, content STRING, embedding ARRAY<FLOAT>, indices ARRAY<BIGINT>, weights ARRAY<DOUBLE>, method STRING"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet PARTITIONED BY (method) TBLPROPERTIES ('dimension' = '{int(dimension)}')")


def attach_vectors(chunks: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """chunks with their vectors by key; raises ValueError unless every chunk has one."""
    joined = chunks.join(vectors.select(key, "embedding"), key, "left")
    missing = joined.filter(F.col("embedding").isNull()).count()
    if missing:
        raise ValueError(f"{missing} chunks have no vector")
    return joined


def encode_texts(df: DataFrame, column: str, encoder, batch: int = 64, prefix: str = "") -> DataFrame:
    """df with `embedding`: unit vectors that encoder(list of texts) gives for each batch of texts behind a prefix; null texts are empty ones."""
    import numpy as np

    names = [c for c in df.columns if c != "embedding"]
    kept = df.select(*names)

    def run(batches):
        for b in batches:
            texts = [prefix + (x or "") for x in b.column(column).to_pylist()]
            rows = [v for i in range(0, len(texts), batch) for v in np.asarray(encoder(texts[i : i + batch]), float)]
            unit = [(v / n if (n := np.linalg.norm(v)) else v).astype(np.float32) for v in rows]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(unit, pa.list_(pa.float32()))], [*b.schema.names, "embedding"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def save_gold(gold: DataFrame, path: str) -> None:
    """Questions as JSON lines."""
    gold.select(F.to_json(F.struct(*gold.columns)).alias("value")).write.mode("overwrite").text(path)


def export_review(hits: DataFrame, path: str, limit: int = 1000) -> None:
    """The first hits to be looked at by hand, one Markdown section each; `limit` is the report's length."""
    row = F.format_string("## %s\n\nrank %s, score %s\n\n%s\n", F.col("query").cast("string"), F.col("rank").cast("string"), F.col("score").cast("string"), F.col("content"))
    hits.orderBy("query", "rank").limit(limit).select(row.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def halved(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with the column as bytes of half floats, in which caches keep them; `restored` gives single floats back."""
    return _recoded(vectors, column, T.BinaryType(), lambda x: np.array(x, np.float32).astype("<f2").tobytes(), pa.binary())


def restored(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vectors with a column of half floats as an array of single floats; null stays null."""
    return _recoded(vectors, column, T.ArrayType(T.FloatType()), lambda x: np.frombuffer(x, "<f2").astype(np.float32), pa.list_(pa.float32()))


def _recoded(df: DataFrame, column: str, kind: T.DataType, code, arrow: pa.DataType) -> DataFrame:
    def run(batches):
        for b in batches:
            new = pa.array([None if x is None else code(x) for x in b.column(column).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([new if n == column else b.column(n) for n in b.schema.names], b.schema.names)

    return df.mapInArrow(run, T.StructType([T.StructField(f.name, kind) if f.name == column else f for f in df.schema.fields]))


def encode_cached(texts: DataFrame, cache: DataFrame, model: str, encoder, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(vectors, new): the vector of every distinct text by the model, and the rows to append to the cache.

    cache(key, embedding) is keyed by `model::text`, so vectors of different models don't mix; only texts that it lacks are
    encoded, each once. Null texts have no vector.
    """
    asked = texts.select(F.col(text).alias("text")).filter("text is not null").distinct().withColumn("key", F.concat(F.lit(f"{model}::"), "text"))
    known = cache.groupBy("key").agg(F.first("embedding").alias("embedding"))
    new = encode_texts(asked.join(known, "key", "left_anti"), "text", encoder)
    held = asked.join(known, "key").select("text", "key", "embedding")
    return held.unionByName(new.select("text", "key", "embedding")), new.select("key", "embedding")


def write_store(points: DataFrame, path: str) -> None:
    """Points of all documents in one table by document: the shared store, of which each document is a single one."""
    points.repartition("document_id").write.mode("overwrite").partitionBy("document_id").parquet(path)


def read_store(spark: SparkSession, path: str, document_id: str | None = None) -> DataFrame:
    """The shared store, or the single store of one document, of which only its own folder is read."""
    store = spark.read.option("recursiveFileLookup", False).parquet(path).withColumn("document_id", F.col("document_id").cast("string"))
    return store if document_id is None else store.filter(F.col("document_id") == document_id)
