"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Tokens are runs of ASCII letters, digits and bytes from 0x80, lower-cased. Labels exist for documents only, so tokens
are labelled from them: how much likelier a document with a word (or a word that begins so) is toxic gives each token
its log odds, and in toxic documents the tokens with high odds are the toxic ones. A field with two states learns from
such sequences how far to trust a token's own odds, its neighbours' and the previous state. Forward-backward marginals
give the spans, and a logistic curve over their sum and maximum gives the score, fitted on the documents' labels.

Learned from at most TRAIN_ROWS labelled rows that aren't held out, whole texts; of these, FIELD_ROWS of each label fit the
field, as far as they have FIELD_TOKENS tokens together. Every text is scored whole; a text's marginals take two steps per
token, of some microseconds, in the task that has it, and shorter texts take their steps together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._util import map_arrow
from ledgerloom.llm._words import Hasher, blocks, mix, row_of, spans

#: Most labelled documents to learn from.
TRAIN_ROWS = 20_000
#: Most documents of each label whose tokens the field is fitted on, and most of their tokens.
FIELD_ROWS, FIELD_TOKENS = 400, 2_000_000
#: Most words and word beginnings with odds.
LEXICON = 20_000
#: Documents that a word must be in; log odds of a token that labels it toxic.
MIN_DOCS, SEED_ODDS = 3, 2.5
#: Bytes of a word's beginning.
PREFIX = 5
#: Tokens that take their steps together.
TOKENS = 1 << 20

TOKEN = np.zeros(256, bool)
TOKEN[0x30:0x3A] = TOKEN[0x41:0x5B] = TOKEN[0x61:0x7B] = TOKEN[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_FILTER = 20


def _tokens(buf: np.ndarray, offs: np.ndarray, hasher: Hasher):
    """(starts, ends, first of each row, hash of each token, hash of its beginning)."""
    starts, ends, first = spans(TOKEN[buf], offs)
    sums = hasher.sums(LOWER[buf])
    whole = hasher.slices(sums, starts, ends)
    begin = mix(hasher.slices(sums, starts, np.minimum(ends, starts + PREFIX)) + np.uint64(1))
    return starts, ends, first, whole, begin


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(labels: DataFrame, limit: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted doc_ids, their labels) of at most `limit` rows that aren't held out, by the hash of the id.

    Null ids and labels are left out; of contradicting labels of one document the higher counts.
    """
    rows = labels.filter("doc_id is not null and toxic is not null").filter(~_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    got = sorted((r[0], r[1]) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).collect())
    return np.array([x[0] for x in got], np.int64), np.array([x[1] for x in got], np.int64)


class Lexicon:
    """Log odds of hashed words and word beginnings, 0 for all others; small and of a fixed size at most."""

    def __init__(self, keys: np.ndarray, odds: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.odds = keys[order], odds[order].astype(np.float32)
        self.maybe = np.zeros(1 << _FILTER, bool)
        self.maybe[self.keys >> np.uint64(64 - _FILTER)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.float32)
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - _FILTER)])
        if len(at):
            place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
            hit = self.keys[place] == h[at]
            out[at[hit]] = self.odds[place[hit]]
        return out


def _marked(docs: DataFrame, ids: np.ndarray) -> DataFrame:
    """The training documents; their ids are a bounded list."""
    keys = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64())}))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(keys), "doc_id")


def lexicon(docs: DataFrame, ids: np.ndarray, toxic: np.ndarray, most: int = LEXICON) -> Lexicon:
    """Odds from the number of toxic and other training documents that each word is in."""

    def count(batches):
        hasher, keys, sides = Hasher(), [], []
        for b in batches:
            label = toxic[np.searchsorted(ids, b.column(0).to_numpy())]
            for lo, _, buf, offs in blocks(b.column(1)):
                _, _, first, whole, begin = _tokens(buf, offs, hasher)
                row = row_of(first)
                both, rows = np.concatenate([whole, begin]), np.concatenate([row, row])
                _, one = np.unique(mix(both + mix(rows.astype(np.uint64))), return_index=True)
                keys.append(both[one])
                sides.append(label[lo + rows[one]] > 0)
        if keys:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            side = np.concatenate(sides)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, side, len(key)).astype(np.int64)), pa.array(np.bincount(at, ~side, len(key)).astype(np.int64))], ["key", "toxic", "other"])

    n1, n0 = int((toxic > 0).sum()), int((toxic <= 0).sum())
    counts = _marked(docs, ids).transform(map_arrow, count, "key long, toxic long, other long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 - F.col("toxic") + 0.5)) - F.log((F.col("other") + 0.5) / (n0 - F.col("other") + 0.5))
    best = counts.filter(F.col("toxic") >= MIN_DOCS).withColumn("odds", odds).filter("odds > 1").orderBy(F.desc("odds"), "key").limit(most).toArrow()
    return Lexicon(best["key"].to_numpy().view(np.uint64), best["odds"].to_numpy())


class Field:
    """Two states, O and T: a token's log potential for T is a sum of weighted features; O has 0."""

    N = 6

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves  # moves: log potentials O>O (0), O>T, T>O, T>T

    @staticmethod
    def features(word: np.ndarray, begin: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bias, odds of the word and of its beginning, whether the word has odds, odds of both neighbours in the text."""
        left, right = np.zeros_like(word), np.zeros_like(word)
        left[1:], right[:-1] = word[:-1], word[1:]
        edge = first[1:-1]
        left[edge[edge < len(word)]] = 0
        right[edge[edge > 0] - 1] = 0
        return np.stack([np.ones_like(word), word / 4, begin / 4, word > 0, left / 4, right / 4], axis=1)

    def ratios(self, emit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each token, the forward and the backward odds of T; all texts take a step at once."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], first[:-1][order]
        steps = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, steps + 1), "right").tolist()
        oo, ot, to, tt = np.exp(self.moves)
        e = np.exp(np.clip(emit, -40, 40))
        forward, backward = np.empty(len(e)), np.ones(len(e))
        for t, k in enumerate(active):
            at = begin[:k] + t
            if t:
                r = forward[at - 1]
                forward[at] = e[at] * (ot + tt * r) / (oo + to * r)
            else:
                forward[at] = e[at]
        for t in range(steps - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            x = e[at + 1] * backward[at + 1]
            backward[at] = (to + tt * x) / (oo + ot * x)
        return forward, backward

    def marginals(self, feats: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability of T for each token."""
        f, b = self.ratios(feats @ self.weights, first)
        return f * b / (1 + f * b)

    @classmethod
    def fit(cls, feats: np.ndarray, first: np.ndarray, state: np.ndarray, rounds: int = 80, rate: float = 0.25, ridge: float = 1e-3) -> Field:
        """Maximum likelihood by Adam over whole sequences."""
        own = cls(np.array([-4.0, 2, 0, 0, 0, 0]), np.array([0.0, -1, 0, 0]))
        inner = np.ones(len(state), bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        at = np.flatnonzero(inner)
        seen_emit = feats.T @ state
        seen_move = np.bincount(2 * state[at - 1] + state[at], minlength=4)
        m, v = np.zeros(cls.N + 4), np.zeros(cls.N + 4)
        for i in range(1, rounds + 1):
            emit = feats @ own.weights
            f, b = own.ratios(emit, first)
            p = f * b / (1 + f * b)
            e = np.exp(np.clip(emit, -40, 40))[at]
            w = np.exp(own.moves)
            joint = np.stack([np.full(len(at), w[0]), w[1] * e * b[at], w[2] * f[at - 1], w[3] * f[at - 1] * e * b[at]])
            joint /= joint.sum(0)
            grad = np.concatenate([seen_emit - feats.T @ p, seen_move - joint.sum(1)]) / max(len(first) - 1, 1)
            grad -= ridge * np.concatenate([own.weights, own.moves])
            grad[cls.N] = 0
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            own = cls(own.weights + step[: cls.N], own.moves + step[cls.N :])
        return own


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What the score looks at: bias, logs of the sum, the maximum and the mean of a text's marginals; texts without tokens have none."""
    n = len(first) - 1
    total = np.bincount(row_of(first), p, n)
    top = np.zeros(n)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        top[full] = np.maximum.reduceat(p, first[full])
    tiny = 1e-3
    return np.stack([np.ones(n), np.log(total + tiny), np.log(top + tiny), np.log(total / np.maximum(np.diff(first), 1) + 1e-5)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Lexicon, field and curve; `prior` is the score of everything if one of the labels is missing."""

    def __init__(self, words: Lexicon | None = None, field: Field | None = None, curve: np.ndarray | None = None, prior: float = 0.0):
        self.words, self.field, self.curve, self.prior = words, field, curve, prior

    def score(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary(p, first) @ self.curve, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, field_rows: int = FIELD_ROWS, field_tokens: int = FIELD_TOKENS, words_kept: int = LEXICON) -> Model:
    """Learn from at most train_rows labelled rows of docs(doc_id, text), the first by the hash of doc_id; texts count whole.

    The lexicon keeps the words_kept words and beginnings of the highest odds. The field is fitted on at most field_rows
    texts of each label, those that have field_tokens tokens together. The driver gets the tokens with odds of train_rows
    texts. Rows that repeat a doc_id are learned from each.
    """
    ids, toxic = training_rows(labels, train_rows)
    if not len(ids) or not (toxic > 0).any() or not (toxic <= 0).any():
        return Model(prior=float(toxic.mean()) if len(ids) else 0.0)
    words = lexicon(docs, ids, toxic, words_kept)
    if not len(words.keys):
        return Model(prior=float((toxic > 0).mean()))

    def sequences(batches):
        """Tokens with odds, as the places of their non-zero odds."""
        hasher = Hasher()
        for b in batches:
            out: list[tuple] = []
            for lo, hi, buf, offs in blocks(b.column(1)):
                _, _, first, whole, begin = _tokens(buf, offs, hasher)
                x, y = words.of(whole), words.of(begin)
                at = np.flatnonzero((x > 0) | (y > 0))
                edge = np.searchsorted(at, first)
                for i in range(hi - lo):
                    own = at[edge[i] : edge[i + 1]]
                    out.append((b.column(0)[lo + i].as_py(), int(first[i + 1] - first[i]), own - first[i], x[own], y[own]))
            ids_, n, at, x, y = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(x, pa.list_(pa.float32())), pa.array(y, pa.list_(pa.float32()))], ["doc_id", "n", "at", "word", "begin"])

    got = _marked(docs, ids).transform(map_arrow, sequences, "doc_id long, n int, at array<int>, word array<float>, begin array<float>").toArrow()
    got = got.sort_by("doc_id").combine_chunks()
    n = got["n"].to_numpy().astype(np.int64)
    y = (toxic[np.searchsorted(ids, got["doc_id"].to_numpy())] > 0).astype(float)
    ats, ws, bs = (got[c].to_pylist() for c in ("at", "word", "begin"))

    def dense(which):
        first = np.concatenate([[0], np.cumsum(n[which])])
        word, begin = np.zeros(first[-1], np.float32), np.zeros(first[-1], np.float32)
        for k, i in enumerate(which.tolist()):
            at = first[k] + np.array(ats[i], np.int64)
            word[at], begin[at] = ws[i], bs[i]
        return first, word, begin

    order = np.argsort(mix(got["doc_id"].to_numpy().view(np.uint64)), kind="stable")
    some = []
    for label in (y[order] > 0, y[order] == 0):
        own = order[label][:field_rows]
        some.append(own[np.cumsum(n[own]) <= field_tokens // 2] if n[own[0]] <= field_tokens // 2 else own[:1])
    some = np.sort(np.concatenate(some))
    first, word, begin = dense(some)
    state = ((word >= SEED_ODDS) & (np.repeat(y[some], n[some]) > 0)).astype(np.int64)
    field = Field.fit(Field.features(word, begin, first).astype(float), first, state)
    seen = []
    block = np.cumsum(n) // TOKENS
    for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(block)) + 1):
        first, word, begin = dense(part)
        seen.append(summary(field.marginals(Field.features(word, begin, first), first), first))
    return Model(words, field, logistic(np.concatenate(seen), y))


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) for every row of docs(doc_id, text); other columns are ignored.

    spans are (start, stop, p) in code points: runs of tokens with a marginal of 0.5 or more, p their largest. Null and
    empty texts are scored as texts without tokens. Without both labels to learn from, every score is the share of
    toxic labels (0 without any) and there are no spans.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        hasher = Hasher()
        for b in batches:
            held, out, total = [], [], 0
            for _, _, buf, offs in blocks(b.column(1)):
                held.append((buf, offs, *_tokens(buf, offs, hasher)))
                total += len(held[-1][2])
                if total > TOKENS:
                    out.append(settle(held))
                    held, total = [], 0
            if held:
                out.append(settle(held))
            scores, found = (np.concatenate([x[0] for x in out]), [s for x in out for s in x[1]]) if out else (np.zeros(0), [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(found, span)], ["doc_id", "score", "spans"])

    def settle(held):
        rows = sum(len(x[1]) - 1 for x in held)
        if model.field is None:
            return np.full(rows, model.prior), [[] for _ in range(rows)]
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x[4]) for x in held]))])
        word = model.words.of(np.concatenate([x[5] for x in held]))
        begin = model.words.of(np.concatenate([x[6] for x in held]))
        p = model.field.marginals(Field.features(word, begin, first), first)
        found: list[list] = []
        done = 0
        for buf, offs, starts, ends, own, _, _ in held:
            q = p[done : done + len(starts)]
            here: list[list] = [[] for _ in range(len(offs) - 1)]
            at = np.flatnonzero(q >= 0.5)
            if len(at):
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                row = np.searchsorted(own, at, "right") - 1
                cut = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(row) > 0), True])
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    base = chars[offs[row[i]]]
                    here[row[i]].append({"start": int(chars[starts[at[i]]] - base), "stop": int(chars[ends[at[j - 1]]] - base), "p": float(q[at[i:j]].max())})
            found += here
            done += len(starts)
        return model.score(p, first), found

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(map_arrow, run, "doc_id long, score double, spans array<struct<start:int,stop:int,p:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the score of every document; a null doc_id is neither learned from nor held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = tag(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
