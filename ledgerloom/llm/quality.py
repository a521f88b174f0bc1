"""Quality rules: exact base counts, then a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Word unigrams and bigrams are hashed into BUCKETS; one multinomial is counted over all documents (raw), one over
trusted documents (target). A document's score is the sum of log(target/raw) over its n-grams divided by their
number; every document is held against the same threshold. Only the target is fitted on labelled rows, at most
TRUSTED_ROWS of them; the raw counts cover every document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._util import map_arrow
from ledgerloom.llm._words import SPACE, blocks, covered, mix, repeated, row_of, slices_of, spans, word_hashes

BUCKETS = 1 << 16
#: Most labelled good documents that the target multinomial is fitted on.
TRUSTED_ROWS = 20_000
#: Documents below this mean log ratio per n-gram are rejected.
THRESHOLD = -0.1
#: Added to each bucket's count, as a share of the mean count.
SMOOTHING = 0.05
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sum_rows(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[offs])


class Block:
    """The words of a block of documents and what the rules count in them; all counts compare bytes, not hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        self.inside = ~SPACE[buf]
        self.starts, self.ends, self.first = spans(self.inside, offs)
        self.words = slices_of(buf, self.inside, self.starts, self.ends)[0]
        self.row = row_of(self.first)

    def base(self) -> dict[str, np.ndarray]:
        buf, offs, n = self.buf, self.offs, len(self.offs) - 1
        out = {"n_words": np.diff(self.first)}
        out["word_chars"] = _sum_rows(self.inside & ((buf & 0xC0) != 0x80), offs)
        out["n_symbols"] = _sum_rows(SYMBOLS[buf], offs)
        starts, ends, first = spans(buf != 10, offs)
        row = row_of(first)
        full = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        lines, kinds = slices_of(buf, buf != 10, starts, ends)
        new = np.unique(row[full] * max(len(kinds), 1) + lines[full]) // max(len(kinds), 1)
        out["n_dup_lines"] = np.bincount(row[full], minlength=n) - np.bincount(new, minlength=n)
        k = REPEAT_WINDOW
        last = np.repeat(self.first[1:], np.diff(self.first)) - k
        at = np.flatnonzero(np.arange(len(self.words)) <= last)
        out["n_repeat_words"] = _sum_rows(covered(len(self.words), self._twice(at, k), k), self.first)
        return out

    def _twice(self, at: np.ndarray, k: int) -> np.ndarray:
        """Those of the windows of k words that start at `at` which occur twice or more in their text."""
        key = mix(self.row[at].astype(np.uint64) + np.uint64(1))
        for i in range(k):
            key = mix(key + self.words[at + i].astype(np.uint64))
        at = at[repeated(key)]  # a superset: equal windows have equal keys
        if not len(at):
            return at
        rows = np.column_stack([self.row[at], self.words[at[:, None] + np.arange(k)]])
        rows = np.ascontiguousarray(rows).view([("", rows.dtype)] * rows.shape[1]).ravel()
        return at[repeated(np.unique(rows, return_inverse=True)[1])]

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of each unigram and each bigram."""
        words = word_hashes(self.buf, self.starts, self.ends)[:, 0]
        pair = np.flatnonzero(self.row[1:] == self.row[:-1]) if len(self.row) else np.zeros(0, np.int64)
        two = mix(words[pair] * np.uint64(3) + words[pair + 1]) if len(pair) else np.zeros(0, np.uint64)
        return np.concatenate([self.row, self.row[pair]]), (np.concatenate([words, two]) >> np.uint64(48)).astype(np.int64)


def _columns(b: pa.RecordBatch, column: int):
    for lo, hi, buf, offs in blocks(b.column(column)):
        yield lo, hi, Block(buf, offs)


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_ROWS) -> np.ndarray:
    """doc_ids of at most `limit` documents labelled good and never bad, by the hash of the id; null labels and ids are left out."""
    good = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    rows = good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect()
    return np.sort(np.array([r[0] for r in rows], np.int64))


def log_ratios(docs: DataFrame, trusted: np.ndarray) -> np.ndarray:
    """log(target/raw) of every bucket, counted over all of docs(doc_id, text); zeros without trusted documents."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            ids = b.column(0)
            good = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), trusted) & ids.is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, block in _columns(b, 1):
                row, bucket = block.grams()
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[lo:hi][row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, count, "bucket int, raw long, target long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = rows["bucket"].to_numpy()
    raw[at], target[at] = rows["raw"].to_numpy(), rows["target"].to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x, total: (x + SMOOTHING * total / BUCKETS) / (total * (1 + SMOOTHING))
    return np.log(share(target, target.sum())) - np.log(share(raw, raw.sum()))


def _judge(block: Block, ratios: np.ndarray, threshold: float) -> dict[str, np.ndarray]:
    """The base counts of a block's texts, whether the base rules fail them, their verdict and their score."""
    base, n = block.base(), len(block.offs) - 1
    row, bucket = block.grams()
    score = np.bincount(row, ratios[bucket], n) / np.maximum(np.bincount(row, minlength=n), 1)
    words = base["n_words"]
    failed = (words < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * words)
    return base | {"base_failed": failed, "kept": ~failed & (score >= threshold), "score": score}


def assess(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score) per row of docs.

    score is the mean log ratio per unigram or bigram (0 for texts without words). A null text counts as empty; it and
    every text of fewer than MIN_WORDS words fails the base rules. A score equal to the threshold is kept. Without trusted
    labels, the base rules decide alone. Rows that repeat are judged each for itself; other columns are ignored.
    """
    ratios = log_ratios(docs, trusted_ids(labels, trusted_rows))
    names = [*_BASE, "base_failed", "kept", "score"]

    def judge(batches):
        for b in batches:
            found = [_judge(block, ratios, threshold) for _, _, block in _columns(b, 1)]
            if found:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.concatenate([f[k] for f in found])) for k in names)], ["doc_id", *names])

    kinds = ", ".join(f"{k} long" for k in _BASE)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, judge, f"doc_id long, {kinds}, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """The rows of docs that `assess` keeps, with all their columns; the verdict is made in the same pass, without a join."""
    ratios = log_ratios(docs, trusted_ids(labels, trusted_rows))
    at = docs.columns.index("text")

    def sift(batches):
        for b in batches:
            kept = [_judge(block, ratios, threshold)["kept"] for _, _, block in _columns(b, at)]
            if kept and (keep := np.concatenate(kept)).any():
                yield b.filter(pa.array(keep))

    return docs.transform(map_arrow, sift, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the base counts and verdict of every document."""
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
