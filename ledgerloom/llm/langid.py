"""Language identification of mixed texts: script ranges, per-word scores, and a Viterbi path with a switching penalty.

A word is a run of letters: ASCII letters and all characters beyond but for marks, signs and symbols. For each language the training texts give log
probabilities of byte trigrams (with the word's edges) and of whole words, both hashed into BUCKETS. The scripts that
a language's words use narrow the candidates of each word: only languages with words in its script are scored for it. The best path over the words of a text, where changing the
language costs PENALTY, labels spans; the language with most bytes is the text's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._util import map_arrow
from ledgerloom.llm._words import Hasher, blocks, row_of, spans

BUCKETS = 1 << 16
#: Cost of changing the language, in nats.
PENALTY = 12.0
#: Share of a language's training words that must be in a script for the language to be its candidate.
SCRIPT_SHARE = 0.01
#: Score of a language that isn't a candidate.
NEVER = np.float32(-1e6)
#: Words times languages that are labelled together; a longer text is labelled alone.
CELLS = 1 << 23
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = LETTER[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Fixed values of Unicode: first and last code point of blocks of the scripts told apart.
SCRIPTS = {
    "Latin": [(0x00AA, 0x00AA), (0x00BA, 0x00BA), (0x00C0, 0x024F), (0x1E00, 0x1EFF)],
    "Greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x0400, 0x052F)],
    "Armenian": [(0x0531, 0x058F)],
    "Hebrew": [(0x0591, 0x05F4)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF)],
    "Devanagari": [(0x0900, 0x097F)],
    "Bengali": [(0x0980, 0x09FF)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Thai": [(0x0E00, 0x0E7F)],
    "Myanmar": [(0x1000, 0x109F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
}
#: Fixed values of Unicode: blocks of marks, signs and symbols, which are no letters.
SIGNS = [
    (0x0080, 0x00A9), (0x00AB, 0x00B4), (0x00B6, 0x00B9), (0x00BB, 0x00BF), (0x00D7, 0x00D7), (0x00F7, 0x00F7), (0x2000, 0x206F), (0x20A0, 0x20CF),
    (0x2190, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x3004), (0x3008, 0x3020), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF01, 0xFF20), (0xFFE0, 0xFFFF), (0x1F000, 0x1FAFF),
]
_NAMES = ["other", *SCRIPTS]
_SIGN = 255
_RANGES = sorted([(lo, hi, i) for i, s in enumerate(SCRIPTS, 1) for lo, hi in SCRIPTS[s]] + [(lo, hi, _SIGN) for lo, hi in SIGNS])
#: Code points where the kind of character changes, and the kinds from there on; 0 is another script's.
_EDGES = np.array([x for lo, hi, _ in _RANGES for x in (lo, hi + 1)], np.int64)
_KINDS = np.array([x for _, _, i in _RANGES for x in (i, 0)], np.uint8)


def kinds_of(points: np.ndarray) -> np.ndarray:
    """Number of each code point's script, 0 for others, _SIGN for no letter."""
    at = np.searchsorted(_EDGES, points, "right") - 1
    return np.where(at >= 0, _KINDS[np.maximum(at, 0)], 0).astype(np.uint8)


_ANY_LETTER = regex.compile(r"\p{L}")


class Words:
    """Words of a block of texts with their features."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, hasher: Hasher):
        kind = self._kinds(buf)
        inside = LETTER[buf] & (kind != _SIGN)
        self.buf, self.offs = buf, offs
        self.starts, self.ends, self.first = spans(inside, offs)
        low = np.where(inside, LOWER[buf], 0)
        at = np.flatnonzero(inside)
        code = low.astype(np.uint32) << np.uint32(8)
        code[1:] |= low[:-1].astype(np.uint32) << np.uint32(16)
        code[:-1] |= low[1:]
        edge = offs[1:-1]
        edge = edge[(edge > 0) & (edge < len(buf))]
        code[edge] &= np.uint32(0x00FFFF)
        code[edge - 1] &= np.uint32(0xFFFF00)
        self.grams = (code[at] * np.uint32(2654435761)) >> np.uint32(16)
        self.gram_first = np.concatenate([[0], np.cumsum(self.ends - self.starts)])[:-1]
        self.whole = (hasher.slices(hasher.sums(low), self.starts, self.ends) >> np.uint64(48)).astype(np.int64)
        #: of each word the last of its characters' scripts in the order of SCRIPTS
        self.script = np.maximum.reduceat(kind[at], self.gram_first) if len(at) else np.zeros(0, np.uint8)

    @staticmethod
    def _kinds(buf: np.ndarray) -> np.ndarray:
        """The kind of each byte's character; ASCII letters are Latin."""
        kind = np.zeros(len(buf), np.uint8)
        kind[buf < 0x80] = 1
        lead = np.flatnonzero(buf >= 0xC0)
        if len(lead):
            wide = np.concatenate([buf, [0, 0, 0]]).astype(np.int64)
            b, tail = wide[lead], [wide[lead + i] & 0x3F for i in (1, 2, 3)]
            two, three = (b & 0x1F) << 6 | tail[0], (b & 0x0F) << 12 | tail[0] << 6 | tail[1]
            points = np.where(b < 0xE0, two, np.where(b < 0xF0, three, (b & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
            found = kinds_of(points)
            for i in range(4):
                at = lead + i
                own = (at < len(buf)) & (i <= (b >= 0xE0).astype(int) + (b >= 0xF0) + 1)
                kind[at[own]] = found[own]
        return kind


def _training(docs: DataFrame) -> DataFrame:
    """The rows to learn from: a language, a text, and a doc_id that isn't held out."""
    return docs.filter("lang is not null and text is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)


class Model:
    """Languages and their log probabilities, as arrays of a fixed size for each language."""

    def __init__(self, langs: list[str], grams: np.ndarray, words: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        log = lambda c: (np.log(c + 0.5) - np.log(c.sum(1, keepdims=True) + 0.5 * BUCKETS)).T.astype(np.float32)
        self.grams, self.words = np.ascontiguousarray(log(grams)), np.ascontiguousarray(log(words))
        used = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
        used[:, ~used.any(0)] = True  # a script that no language uses tells nothing
        self.candidates = [np.flatnonzero(used[:, i]) for i in range(used.shape[1])]

    def scores(self, w: Words) -> np.ndarray:
        """Log probability of each word in each of its script's candidates, NEVER in other languages."""
        out = np.full((len(w.starts), len(self.langs)), NEVER, np.float32)
        size = w.ends - w.starts
        for script in np.unique(w.script).tolist():
            langs = self.candidates[script]
            own = w.script == script
            at = np.flatnonzero(own)
            grams, first = (w.grams, w.gram_first) if own.all() else (w.grams[np.repeat(own, size)], np.cumsum(size[at]) - size[at])
            whole = len(langs) == len(self.langs)
            table, words = (self.grams, self.words) if whole else (self.grams[:, langs], self.words[:, langs])
            out[at[:, None], langs] = np.add.reduceat(table[grams], first, axis=0) + words[w.whole[at]]
        return out


def fit(docs: DataFrame) -> Model:
    """Counts over all training rows of docs(doc_id, text, lang); what reaches the driver is BUCKETS numbers per language."""

    def count(batches):
        hasher, found = Hasher(), {}
        for b in batches:
            langs = b.column(1).dictionary_encode()
            names, which = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in blocks(b.column(0)):
                w = Words(buf, offs, hasher)
                lang = which[lo:hi][row_of(w.first)]
                long = np.repeat(lang, w.ends - w.starts)
                for i in np.unique(lang):
                    have = found.setdefault(names[i], np.zeros(2 * BUCKETS + 64, np.int64))
                    have[:BUCKETS] += np.bincount(w.grams[long == i], minlength=BUCKETS)
                    have[BUCKETS : 2 * BUCKETS] += np.bincount(w.whole[lang == i], minlength=BUCKETS)
                    have[2 * BUCKETS :] += np.bincount(w.script[lang == i], minlength=64)
        for name, have in found.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(have[at])], ["lang", "slot", "n"])

    rows = _training(docs.select("doc_id", "text", "lang")).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    table = rows.transform(map_arrow, count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    which = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(langs), 2 * BUCKETS + 64))
    counts[[which[x] for x in table["lang"].to_pylist()], table["slot"].to_numpy()] = table["n"].to_numpy()
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS : 2 * BUCKETS], counts[:, 2 * BUCKETS : 2 * BUCKETS + len(_NAMES)])


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best language of each word; texts are the words first[i] to first[i + 1] - 1. All texts take a step at once."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    n, langs = scores.shape
    active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), "right")
    came = np.empty(n, np.int16)
    changed = np.zeros((n, langs), bool)
    best = np.zeros((len(size), langs), np.float64)
    for t, k in enumerate(active.tolist()):
        at = begin[:k] + t
        if t:
            own = best[:k]
            top = own.argmax(1)
            other = own[np.arange(k), top][:, None] - penalty
            move = other > own
            came[at], changed[at] = top, move
            best[:k] = np.where(move, other, own)
        best[:k] += scores[at]
    path = np.empty(n, np.int16)
    state = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        now = state[:k]
        path[at] = now
        if t:
            state[:k] = np.where(changed[at, now], came[at], now)
    return path


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, with_spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score), and spans if asked for, of every row of docs(doc_id, text); other columns are ignored.

    Words of equal scores take the first language by name. A text's path takes one step per word, of some microseconds, in
    the task that has it; shorter texts take their steps together.

    lang_pred is the language with most bytes in words (the first by name of equal ones), score its share of these
    bytes; texts that are null or have no letter, and all texts if nothing was learned, get `und` and 0. spans are
    (lang, start, stop) in code points, from the first word of a language to its last before the next one.
    """
    names = np.array([*model.langs, UNKNOWN], object)
    schema = "doc_id long, lang_pred string, score double" + ", spans array<struct<lang:string,start:int,stop:int>>" * with_spans

    def label(batches):
        hasher = Hasher()
        for b in batches:
            held, rows, out = [], 0, []
            for lo, hi, buf, offs in blocks(b.column(1)):
                w = Words(buf, offs, hasher)
                held.append((w, model.scores(w)))
                rows += len(w.starts)
                if rows * max(1, len(model.langs)) > CELLS:
                    out += settle(held)
                    held, rows = [], 0
            out += settle(held)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())] + ([pa.array([x[2] for x in out], pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])))] if with_spans else []), ["doc_id", "lang_pred", "score"] + ["spans"] * with_spans)

    def settle(held):
        if not held:
            return []
        sizes = np.concatenate([np.diff(w.first) for w, _ in held])
        first = np.concatenate([[0], np.cumsum(sizes)])
        n = len(names) - 1
        path = viterbi(np.concatenate([s for _, s in held]), first, penalty) if n else np.zeros(first[-1], np.int16)
        weight = np.concatenate([w.ends - w.starts for w, _ in held])
        share = np.bincount(row_of(first) * max(n, 1) + path, weight, len(sizes) * max(n, 1)).reshape(len(sizes), -1)
        top, total = share.argmax(1), share.sum(1)
        out, done = [], 0
        for w, _ in held:
            ascii_letters = np.zeros(len(w.offs) - 1, bool)
            plain = np.concatenate([[0], np.cumsum(LETTER[w.buf] & (w.buf < 0x80))])
            ascii_letters[:] = np.diff(plain[w.offs]) > 0
            chars = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80)]) if with_spans else None
            for i in range(len(w.offs) - 1):
                j = done + i
                known = n and total[j] and (ascii_letters[i] or _ANY_LETTER.search(w.buf[w.offs[i] : w.offs[i + 1]].tobytes().decode()))
                row = (names[top[j]], share[j, top[j]] / total[j]) if known else (UNKNOWN, 0.0)
                if with_spans:
                    p = path[first[j] : first[j + 1]]
                    cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) and known else np.zeros(0, np.int64)
                    a, z = w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]]
                    base = chars[w.offs[i]]
                    row += ([{"lang": names[p[c]], "start": int(chars[a[c]] - base), "stop": int(chars[z[d - 1]] - base)} for c, d in zip(cut, [*cut[1:], len(p)], strict=True)] if len(cut) else [],)
                out.append(row)
            done += len(w.offs) - 1
        return out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(map_arrow, label, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the language of every document; a null doc_id is neither learned from nor held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, fit(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
