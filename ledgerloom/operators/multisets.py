"""Multisets of tokens or numbers as long tables (key columns, token, cnt), and what is computed from two of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.batches import are_unique, counted, exploded, in_arrow, term_counts
from ledgerloom.operators.joins import checked_join

#: Queries times wanted tokens up to which containment is a product of matrices; chunks and tokens of one product.
CELLS, DOCS, TERMS = 5_000_000, 512, 4096


def multiset(df: DataFrame, keys: list[str], items: Column) -> DataFrame:
    """(keys, token, cnt) of an array column; counts are summed before the shuffle."""
    return df.select(*keys, F.explode(items).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("cnt"))


def row_multiset(df: DataFrame, keys: list[str], items: Column) -> DataFrame:
    """`multiset` of strings for long rows: each row is counted where it lies, and only keys that repeat are summed by a shuffle."""
    rows = exploded(counted(df, keys, items), keys, cnt="n0")
    return rows if are_unique(df, keys) else rows.groupBy(*keys, "token").agg(F.sum("cnt").alias("cnt"))


def row_pairs(df: DataFrame, keys: list[str], left: Column, right: Column) -> DataFrame:
    """`paired` multisets of two array columns of strings, from one pass; only keys that repeat are summed by a shuffle."""
    rows = exploded(counted(df, keys, left, right), keys, a="n0", b="n1")
    return rows if are_unique(df, keys) else rows.groupBy(*keys, "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, token, a, b): counts on both sides, 0 where a side lacks the token. One aggregation of the union, no join."""
    both = left.select(*keys, "token", F.col("cnt").alias("a"), F.lit(0).cast("long").alias("b")).unionByName(
        right.select(*keys, "token", F.lit(0).cast("long").alias("a"), F.col("cnt").alias("b"))
    )
    return both.groupBy(*keys, "token").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _side(pairs: DataFrame, keys: list[str], count: Column) -> DataFrame:
    return pairs.select(*keys, "token", count.alias("cnt")).filter("cnt > 0")


def difference(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens that the left side has more of (EXCEPT ALL)."""
    return _side(pairs, keys, F.col("a") - F.col("b"))


def intersection(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of both sides (INTERSECT ALL)."""
    return _side(pairs, keys, F.least("a", "b"))


def max_union(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The larger count of each token."""
    return _side(pairs, keys, F.greatest("a", "b"))


def total(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of both counts (UNION ALL)."""
    return _side(pairs, keys, F.col("a") + F.col("b"))


def sizes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, size, tokens): tokens with repeats and distinct ones of all four of the above, by one aggregation; kinds without tokens are left out."""
    kinds = {"difference": F.col("a") - F.col("b"), "intersection": F.least("a", "b"), "max_union": F.greatest("a", "b"), "total": F.col("a") + F.col("b")}
    found = pairs.groupBy(*keys).agg(*[F.struct(F.lit(k).alias("kind"), F.sum(F.greatest(n, F.lit(0))).alias("size"), F.count_if(n > 0).alias("tokens")).alias(k) for k, n in kinds.items()])
    return found.select(*keys, F.inline(F.array(*kinds))).filter("tokens > 0")


def agreement(pairs: DataFrame, keys: list[str], empty: float = 1.0) -> DataFrame:
    """(keys, recall, precision, missing, extra): a is the source, b the output; a side without tokens agrees by `empty`, fully."""
    common, a, b = F.sum(F.least("a", "b")), F.sum("a"), F.sum("b")
    return pairs.groupBy(*keys).agg(
        F.when(a == 0, F.lit(empty)).otherwise(common / a).alias("recall"),
        F.when(b == 0, F.lit(empty)).otherwise(common / b).alias("precision"),
        (a - common).alias("missing"),
        (b - common).alias("extra"),
    )


def containment(queries: DataFrame, query_key: str, chunks: DataFrame, chunk_key: str, query_tokens: Column, chunk_tokens: Column, best: int | None = None, least: str | None = None, digits: int = 6) -> DataFrame:
    """(query_key, chunk_key, containment): the share of a query's tokens that a chunk has, counted with repeats, where above 0.

    With `best`, pairs are left out that are not among that many of their query, by the share rounded to digits and the
    smaller id, unless they reach `least`, a column of the queries. Up to CELLS queries times wanted tokens, these are one
    matrix that every task gets; a batch of chunks is counted by a product where it lies, and nothing is joined or shuffled.
    Beyond that, or where chunks' ids repeat, pairs meet on tokens, and all of them are given. A query without tokens meets nothing.
    """
    q = multiset(queries.filter(F.col(query_key).isNotNull()), [query_key], query_tokens).withColumnRenamed("cnt", "wanted")
    columns = q.groupBy("token").agg(F.max("wanted").alias("n")).agg(F.sum("n")).first()[0] or 0
    if columns * q.select(query_key).distinct().count() > CELLS or not are_unique(chunks, [chunk_key]):
        return _joined(q, query_key, chunks, chunk_key, chunk_tokens)
    asked = q.toArrow()
    bound = {} if least is None else {r[0]: r[1] for r in queries.select(query_key, least).collect()}
    rows = chunks.select(chunk_key, chunk_tokens.alias("tokens"))
    kinds = [f"{x.name} {x.dataType.simpleString()}" for x in (q.schema[query_key], rows.schema[chunk_key])]
    return in_arrow(rows, _products(asked, query_key, chunk_key, best, bound, digits), ", ".join([*kinds, "containment double"]))


def _products(asked: pa.Table, query_key: str, chunk_key: str, best: int | None, bound: dict, digits: int):
    """For mapInArrow over (chunk, tokens). A token that a query wants n times has n columns; the k-th is 1 for whoever has it k times."""
    names, words = asked[query_key].combine_chunks(), asked["token"].combine_chunks()
    ids, terms, wanted = pc.unique(names), pc.unique(words), asked["wanted"].to_numpy()
    at, term = pc.index_in(names, value_set=ids).to_numpy(), pc.index_in(words, value_set=terms).to_numpy()
    most = np.zeros(len(terms), np.int64)
    np.maximum.at(most, term, wanted)
    start = np.r_[0, np.cumsum(most)]

    def cells(term: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(start[term], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    weights = np.zeros((start[-1], len(ids)), np.float32)  # sums of ones, exact up to 2**24
    weights[cells(term, wanted), np.repeat(at, wanted)] = 1
    size = weights.sum(0, dtype=np.float64)
    reach = np.array([bound.get(i, np.inf) for i in ids.to_pylist()], float)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, DOCS):
                part = b.slice(lo, DOCS)
                doc, has, tf, _ = term_counts(part.column(1), terms)
                n = np.minimum(tf, most[has])
                row, col = np.repeat(doc, n), cells(has, n)
                common = np.zeros((part.num_rows, len(ids)), np.float32)
                for first in range(0, start[-1], TERMS):
                    here = (col >= first) & (col < first + TERMS)
                    own = np.zeros((part.num_rows, min(TERMS, start[-1] - first)), np.float32)
                    own[row[here], col[here] - first] = 1
                    common += own @ weights[first : first + TERMS]
                shares = common / size
                keep = common > 0
                if best is not None:
                    order = np.argsort(pc.sort_indices(part.column(0)).to_numpy(), kind="stable")  # places of the ids
                    rounded = np.round(shares, digits)
                    first = np.lexsort((np.broadcast_to(order[:, None], shares.shape), -rounded), axis=0)[:best]
                    near = np.zeros_like(keep)
                    np.put_along_axis(near, first, True, axis=0)
                    keep &= near | (shares >= reach)
                which, query = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), part.column(0).take(pa.array(which)), pa.array(shares[which, query], pa.float64())], [query_key, chunk_key, "containment"])

    return run


def _joined(q: DataFrame, query_key: str, chunks: DataFrame, chunk_key: str, chunk_tokens: Column) -> DataFrame:
    """Containment by joins on tokens, chunks reduced to the queries' tokens first."""
    words = chunks.select(chunk_key, F.explode(chunk_tokens).alias("token"))
    words = checked_join(words, q.select("token").distinct(), ["token"], "left_semi")
    c = words.groupBy(chunk_key, "token").agg(F.count("*").alias("got"))
    size = q.groupBy(query_key).agg(F.sum("wanted").alias("size"))
    met = checked_join(c, q, ["token"]).groupBy(query_key, chunk_key).agg(F.sum(F.least("wanted", "got")).alias("common"))
    return checked_join(met, size, [query_key]).select(query_key, chunk_key, (F.col("common") / F.col("size")).alias("containment"))
