"""Dense, lexical and fused top-k search with payload filters before or after ranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators.batches import are_unique, counted, in_arrow, term_counts
from ledgerloom.operators.joins import checked_join

#: Constant of reciprocal rank fusion; weights of the lexical score.
RRF_K = 60
K1, B = 1.5, 0.75
#: Hits that are ranked before a filter that comes after ranking, and on the second try.
FETCH, RETRY = 200, 400
#: Queries of one block, whose vectors are sent to every task.
QUERIES = 10_000
#: Queries and chunks of one product.
CHUNKS = 2048

#: Queries times terms up to which lexical weights are a matrix; chunks that are scored together.
CELLS, DOCS, TERMS = 5_000_000, 512, 4096

FILTERS = ("ticker", "document_id", "fiscal_year", "period_year", "statement_type", "fiscal_period", "form_type", "contains_table", "contains_text")
SELECTIVE = ("ticker", "fiscal_year", "statement_type", "document_id")


def payload_filter(**wanted) -> Column:
    """A conjunction over the given fields; None asks nothing.

    Tickers compare in upper case, document ids and periods in lower case; a year holds if it is the fiscal year or
    among the period years.
    """
    unknown = set(wanted) - set(FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    out = F.lit(True)
    year = wanted.get("period_year") or wanted.get("fiscal_year")
    if year is not None:
        out = out & (F.coalesce(F.array_contains("period_years", int(year)), F.lit(False)) | (F.col("fiscal_year") == int(year)))
    for name in FILTERS:
        value = wanted.get(name)
        if value is None or name in ("fiscal_year", "period_year"):
            continue
        if name == "ticker":
            out = out & (F.upper(name) == str(value).upper())
        elif name in ("document_id", "fiscal_period"):
            out = out & (F.lower(name) == str(value).lower())
        else:
            out = out & (F.col(name) == value)
    return out


def is_selective(**wanted) -> bool:
    """Whether two or more of the selective fields are asked for, so that filtering before ranking pays."""
    return sum(wanted.get(k) is not None for k in SELECTIVE) >= 2


def ranked(hits: DataFrame, query: str, item: str, k: int, score: str = "score") -> DataFrame:
    """hits with `rank` 1 to k per query, by descending score and then the item's id."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    return hits.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int, item: str = "vec_id", query: str = "query_id", digits: int = 5, _depth: int = 0) -> DataFrame:
    """(query, item, score, rank): exact inner products of every query with every chunk, the k best of each query.

    chunks(item, embedding), queries(query, vector), whose vectors go to every task; more than QUERIES of them are
    searched in blocks by a hash of the query's id, each over all chunks. Each batch of chunks keeps its own k best
    before anything is shuffled, so the exchange is small whatever the table's size. Vectors of different length don't meet; null
    ids, and vectors that are null, empty or hold a null, are left out. Scores are rounded before they are ranked, ties go to the smaller id.
    """
    asked = queries.select(F.col(query).cast("long"), F.col("vector").cast("array<double>")).limit(QUERIES + 1).toArrow()
    if len(asked) > QUERIES:
        if _depth == 8:
            raise ValueError(f"more than {QUERIES} rows of one query")
        blocks = -(-queries.count() // QUERIES)
        block = F.pmod(F.xxhash64(F.col(query).cast("long"), F.lit(_depth)), F.lit(blocks))
        return reduce(DataFrame.unionByName, [dense_topk(chunks, queries.filter(block == i), k, item, query, digits, _depth + 1) for i in range(blocks)])
    by_size: dict[int, tuple[list, list]] = {}
    for i, v in zip(asked.column(0).to_pylist(), asked.column(1).to_pylist(), strict=True):
        if i is not None and v and None not in v:
            ids, rows = by_size.setdefault(len(v), ([], []))
            ids.append(i)
            rows.append(v)
    matrices = {size: (np.array(ids), np.array(rows, float)) for size, (ids, rows) in by_size.items()}

    def best(batches):
        for b in batches:
            size = np.diff(b.column(1).offsets.to_numpy())
            for width, (ids, matrix) in matrices.items():
                own = b.filter(pa.array(size == width))
                for lo in range(0, own.num_rows, CHUNKS):
                    part = own.slice(lo, CHUNKS)
                    items, x = part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)
                    for at in range(0, len(ids), CHUNKS):
                        yield _k_best(ids[at : at + CHUNKS], items, np.round(matrix[at : at + CHUNKS] @ x.T, digits), k, query, item)

    vector = F.col("embedding").cast("array<double>")
    found = chunks.filter(F.col(item).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull())).select(F.col(item).cast("long"), vector.alias("embedding"))
    return ranked(found.mapInArrow(best, f"{query} long, {item} long, score double"), query, item, k)


def _k_best(ids: np.ndarray, items: np.ndarray, scores: np.ndarray, k: int, query: str, item: str) -> pa.RecordBatch:
    """Of each row of scores the k best, ties to the smaller item; what can't be among them isn't sorted."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((items[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(ids)))
    keep = np.arange(len(row)) - first[row] < k
    row, col = row[keep], col[keep]
    return pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(items[col], pa.int64()), pa.array(scores[row, col], pa.float64())], [query, item, "score"])


def dense_filtered(chunks: DataFrame, queries: DataFrame, condition: Column, k: int, before: bool, fetch: int = FETCH, retry: int = RETRY, **names) -> DataFrame:
    """Dense search with a filter on the chunks' columns before or after ranking.

    After ranking, only the `fetch` best hits are looked at; a query of which none survives looks at the `retry` best.
    """
    item, query = names.get("item", "vec_id"), names.get("query", "query_id")
    if before:
        return dense_topk(chunks.filter(condition), queries, k, **names)
    hits = dense_topk(chunks, queries, max(retry, k), **names).withColumnRenamed("rank", "place")
    kept = hits.join(chunks.filter(condition).select(item), item, "left_semi")
    near = F.max((F.col("place") <= max(fetch, k)).cast("int")).over(Window.partitionBy(query)) == 1
    kept = kept.withColumn("near", near).filter(~F.col("near") | (F.col("place") <= max(fetch, k)))
    return ranked(kept.drop("place", "near"), query, item, k)


def postings(chunks: DataFrame, item: str, tokens: Column, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, item, tf, size) for the terms asked for, and (n, mean) over all chunks.

    One pass over the chunks for each; only the asked terms' counts are shuffled.
    """
    sized = chunks.select(item, tokens.alias("_tokens")).withColumn("size", F.size("_tokens").cast("long"))
    figures = sized.agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    words = sized.select(item, "size", F.explode("_tokens").alias("term"))
    return checked_join(words, terms, ["term"], "left_semi").groupBy("term", item, "size").agg(F.count("*").alias("tf")), figures


def lexical_scores(chunks: DataFrame, queries: DataFrame, item: str, query: str, chunk_tokens: Column | None = None, query_tokens: Column | None = None, digits: int = 6) -> DataFrame:
    """(query, item, score): BM25 of every query with every chunk that shares a term; a query's repeated terms count once."""
    chunk_tokens = text.tokens(F.col("text")) if chunk_tokens is None else chunk_tokens
    query_tokens = text.tokens(F.col("text")) if query_tokens is None else query_tokens
    asked = queries.select(query, F.explode(F.array_distinct(query_tokens)).alias("term"))
    posts, figures = postings(chunks, item, chunk_tokens, asked.select("term").distinct())
    n, mean = figures.first()
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select(query, "term", idf.alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean or 1.0)))
    return checked_join(posts, weighed, ["term"]).groupBy(query, item).agg(F.round(F.sum(part), digits).alias("score"))


def lexical_topk(chunks: DataFrame, queries: DataFrame, k: int, item: str = "doc_id", query: str = "item_id", chunk_tokens: Column | None = None, query_tokens: Column | None = None, digits: int = 6) -> DataFrame:
    """(query, item, score, rank) of the k best by BM25, of the chunks that share a term with the query.

    Up to CELLS queries times terms, their weights are one matrix that every task gets; a batch of chunks, of few MB, is scored by a
    product and keeps its own k best, so only these are shuffled. Beyond that, scores come from joins. Null ids are left out.
    """
    chunk_tokens = text.tokens(F.col("text")) if chunk_tokens is None else chunk_tokens
    query_tokens = text.tokens(F.col("text")) if query_tokens is None else query_tokens
    asked = queries.filter(F.col(query).isNotNull()).select(F.col(query).cast("long").alias(query), F.explode(F.array_distinct(query_tokens)).alias("term"))
    sizes = asked.agg(F.count_distinct(query), F.count_distinct("term")).first()
    if sizes[0] * sizes[1] > CELLS:
        return ranked(lexical_scores(chunks, queries, item, query, chunk_tokens, query_tokens, digits), query, item, k)
    table = asked.distinct().toArrow()
    ids, at = np.unique(table.column(0).to_numpy(), return_inverse=True)
    terms = pc.unique(table.column(1).combine_chunks())
    rows = chunks.filter(F.col(item).isNotNull()).select(F.col(item).cast("long").alias(item), chunk_tokens.alias("tokens"))

    def count(batches):
        n = size = 0
        df = np.zeros(len(terms), np.int64)
        for b in batches:
            _, term, _, length = term_counts(b.column(1), terms)
            n, size = n + b.num_rows, size + int(length.sum())
            df += np.bincount(term, minlength=len(terms))
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, np.arange(len(terms))]), pa.array(np.r_[n, size, df])], ["key", "n"])

    total = {r[0]: r[1] for r in in_arrow(rows, count, "key long, n long").groupBy("key").agg(F.sum("n")).collect()}
    n, mean = total.get(-1, 0), total.get(-2, 0) / max(total.get(-1, 0), 1) or 1.0
    df = np.array([total.get(i, 0) for i in range(len(terms))], float)
    weights = np.zeros((len(terms), len(ids)))
    which = pc.index_in(table.column(1).combine_chunks(), value_set=terms).to_numpy()
    weights[which, at] = np.log(1 + (n - df[which] + 0.5) / (df[which] + 0.5)) * (K1 + 1)

    def best(batches):
        for b in batches:
            items = b.column(0).to_numpy(zero_copy_only=False)
            doc, term, tf, length = term_counts(b.column(1), terms)
            for lo in range(0, b.num_rows, DOCS):
                hi = min(lo + DOCS, b.num_rows)
                own = slice(*np.searchsorted(doc, [lo, hi]))
                row, col, value = doc[own] - lo, term[own], tf[own] / (tf[own] + K1 * (1 - B + B * length[doc[own]] / mean))
                scores = np.zeros((hi - lo, len(ids)))
                for at in range(0, len(terms), TERMS):  # only so many terms are a matrix at once
                    here = (col >= at) & (col < at + TERMS)
                    part = np.zeros((hi - lo, min(TERMS, len(terms) - at)))
                    part[row[here], col[here] - at] = value[here]
                    scores += part @ weights[at : at + TERMS]
                found = _k_best(ids, items[lo:hi], np.round(scores.T, digits), k, query, item)
                yield found.filter(pc.greater(found.column(2), 0.0))

    return ranked(in_arrow(rows, best, f"{query} long, {item} long, score double"), query, item, k)


def fuse(legs: list[DataFrame], query: str, item: str, k: int, constant: int = RRF_K, digits: int = 9) -> DataFrame:
    """(query, item, score, rank): reciprocal rank fusion of ranked legs (query, item, rank)."""
    union = legs[0].select(query, item, "rank")
    for leg in legs[1:]:
        union = union.unionByName(leg.select(query, item, "rank"))
    scored = union.groupBy(query, item).agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), digits).alias("score"))
    return ranked(scored, query, item, k)


def search(
    chunks: DataFrame, queries: DataFrame, k: int, mode: str = "hybrid", strategy: str = "post_filter", depth: int = 40, item: str = "chunk_id", query: str = "query_id",
    chunk_tokens: Column | None = None, query_tokens: Column | None = None, **wanted,
) -> DataFrame:
    """(query, item, score, rank): the k best chunks of each query.

    chunks(item, text, embedding and the fields of `payload_filter`), queries(query, text, vector). mode: `dense`, `sparse`
    (words) or `hybrid`, which fuses the `depth` best of both (twice k at least). The filter given by **wanted holds before
    ranking (`pre_filter`) or after it (`post_filter`); selective filters always go first. After ranking, FETCH hits are
    looked at, and RETRY of a query of which none is left.
    """
    if mode not in ("dense", "sparse", "hybrid") or strategy not in ("pre_filter", "post_filter"):
        raise ValueError("mode is dense, sparse or hybrid, strategy pre_filter or post_filter")
    filtered = any(v is not None for v in wanted.values())
    before = filtered and (strategy == "pre_filter" or is_selective(**wanted))
    condition = payload_filter(**wanted)
    own = chunks.filter(condition) if before else chunks

    def leg(name: str, n: int) -> DataFrame:
        if name == "dense":
            return dense_topk(own, queries, n, item=item, query=query)
        return lexical_topk(own, queries, n, item, query, chunk_tokens, query_tokens)

    def legs(n: int) -> DataFrame:
        return leg(mode, n) if mode != "hybrid" else fuse([leg(x, max(depth, 2 * n)) for x in ("dense", "sparse")], query, item, n)

    if before or not filtered:
        return legs(k)
    hits = legs(max(RETRY, k)).withColumnRenamed("rank", "place")
    kept = hits.join(chunks.filter(condition).select(item), item, "left_semi")
    first = max(FETCH, k)
    near = F.max((F.col("place") <= first).cast("int")).over(Window.partitionBy(query)) == 1
    kept = kept.withColumn("near", near).filter(~F.col("near") | (F.col("place") <= first))
    return ranked(kept.drop("place", "near"), query, item, k)


def sparse_vectors(chunks: DataFrame, item: str, tokens: Column) -> DataFrame:
    """(item, indices, weights): BM25 term weights of each chunk, without document frequencies; terms by 31-bit hash.

    Chunks are counted where they lie; only where their ids repeat are terms shuffled.
    """
    sized = chunks.select(item, tokens.alias("_tokens")).withColumn("size", F.size("_tokens"))
    mean = sized.agg(F.avg("size")).first()[0] or 1.0
    if are_unique(chunks, [item]):
        tf = counted(sized, [item, "size"], F.col("_tokens")).filter(F.size("tokens") > 0)
        weight = lambda n: n * (K1 + 1) / (n + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
        sorted_ = tf.select(item, F.array_sort(F.zip_with("tokens", "n0", lambda t, n: F.struct(F.pmod(F.xxhash64(t), F.lit(1 << 31)).alias("index"), weight(n).alias("weight")))).alias("p"))
    else:
        tf = sized.select(item, "size", F.explode("_tokens").alias("term")).groupBy(item, "size", "term").agg(F.count("*").alias("tf"))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
        pairs = tf.select(item, F.struct(F.pmod(F.xxhash64("term"), F.lit(1 << 31)).alias("index"), weight.alias("weight")).alias("p"))
        sorted_ = pairs.groupBy(item).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return sorted_.select(item, F.transform("p", lambda x: x["index"]).alias("indices"), F.transform("p", lambda x: x["weight"]).alias("weights"))
