"""BPE encoding and decoding by speculation: propose greedily, verify pairs, merge exactly only what fails.

A tokenizer file of the `tokenizers` library with end-of-word BPE is read as data: its vocabulary, ranked merges and added
tokens. Its normaliser, pre-tokeniser and decoder must be those written below; files with others are rejected. For words not met before, an automaton proposes the longest matching tokens from left to
right. A proposal is the true encoding exactly if every token encodes to itself and every adjacent pair is compatible,
that is, no merge across their border comes before the merges that build them; all pairs of a batch are tested at once
over arrays by walking down the two spines at the border. Words with a failing pair go through exact merging.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ledgerloom.llm._util import map_arrow

#: Distinct words whose encodings a Python worker keeps; the table starts anew beyond.
CACHE_WORDS = 250_000
#: Characters of text that are encoded together; a longer document is a batch of its own.
BATCH_CHARS = 1 << 19

#: Letters beyond which a word is merged by a heap.
LONG_WORD = 200

#: Fixed values of the vocabulary files: the mark of a word's end, and the pattern that splits normalised text.
END = "</w>"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"

#: Fixed values of the vocabulary files: what else they must say.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT.replace(r"\p{White_Space}", r"\s")}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}

_STOP = "\U0010fffd"  # stands for END in the automaton, where it is one character
_NONE = np.iinfo(np.int64).max
_WORDS = regex.compile(SPLIT)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter of each byte: itself where Latin-1 prints it, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes as the file says; safe to build once for each Python worker."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or model["continuing_subword_prefix"] or model.get("ignore_merges"):
            raise ValueError("only BPE with an end-of-word mark and without prefixes is supported")
        if data.get("normalizer") != NORMALIZER or data.get("pre_tokenizer") != PRE_TOKENIZER or data.get("decoder") is not None or model.get("dropout") or model.get("byte_fallback"):
            raise ValueError("the file normalises, splits or decodes in another way than this codec")
        if any(t[k] != v for t in data["added_tokens"] for k, v in ADDED.items()):
            raise ValueError("only added tokens that stand for themselves in raw text are supported")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = {b: ord(x) for b, x in _byte_letters().items()} | {10: ord(_STOP)}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.texts = np.full(size, None, object)
        for table in (self.vocab, self.special):
            for t, i in table.items():
                self.texts[i] = t
        self.numbers = np.array([str(i) for i in range(size)], object)
        # of each token: the merge that makes it, and its halves
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merges: dict[tuple[int, int], int] = {}
        codes, ranks, made = [], [], []
        for r, (a, b) in enumerate(tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merges.setdefault((i, j), r)
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
            codes.append(i * size + j)
            ranks.append(r)
            made.append(k)
        self.size, self.made = size, np.array(made, np.int64)
        self.codes, first = np.unique(np.array(codes, np.int64), return_index=True)
        self.code_rank = np.array(ranks, np.int64)[first]
        self.automaton = ahocorasick.Automaton()
        for t, i in self.vocab.items():
            key = t[: -len(END)] + _STOP if t.endswith(END) and t != END else t
            self.automaton.add_word(key, (i, len(key)))
        self.automaton.make_automaton()
        every = np.fromiter(self.vocab.values(), np.int64)
        self.stable = np.zeros(size, bool)
        made = every[self.rank[every] >= 0]
        self.stable[every[self.rank[every] < 0]] = True
        self.stable[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for i in made[np.argsort(self.rank[made])]:  # halves have lower ranks than what they make
            self.stable[i] &= self.stable[self.left[i]] and self.stable[self.right[i]]
        letters = [t for t, i in self.vocab.items() if self.rank[i] < 0 and len(t.removesuffix(END)) > 1]
        for t in letters:  # no merge makes them, so no text gives them
            self.stable[self.vocab[t]] = False
        self.forget()

    def forget(self) -> None:
        self.flat = np.array(list(self.special.values()), np.int32)
        self.offs = np.arange(len(self.special) + 1)
        self.known = {"\0" + s: n for n, s in enumerate(self.special)}

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        code = a * self.size + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.code_rank[at], _NONE)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Which pairs of tokens stay apart: no merge across the border ranks below `before` (any merge, if None).

        From the finished tokens back in time: whichever of the two was made last is undone, and the parts that
        then meet at the border must not have a merge that would have come before it. Of equal merges the left one
        comes first, so undoing the right token also forbids a merge of the same rank.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NONE) if before is None else before.copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            clash = self._pair_rank(x, y) < limit[live]
            ok[live[clash]] = False
            live, x, y = live[~clash], x[~clash], y[~clash]
            rx, ry = self.rank[x], self.rank[y]
            more = (rx >= 0) | (ry >= 0)
            live, x, y, rx, ry = live[more], x[more], y[more], rx[more], ry[more]
            undo_left = rx > ry
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            limit[live] = np.where(undo_left, rx, ry + 1)
        return ok

    def _exact(self, word: str) -> list[int]:
        """The merges of one long word of letters by a heap: lowest rank first, from the left."""
        ids = [self.vocab[x] for x in (*word[:-1], word[-1] + END)]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (r := self.merges.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        for i in range(len(ids)):
            offer(i)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue  # one of the two has gone meanwhile
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]

    def _exact_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per word) by exact merges; all words take their next merge at once."""
        out: list = [None] * len(words)
        short = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = np.array(self._exact(w), np.int64)
            else:
                short.append(i)
        ids = np.array([self.vocab[x] for i in short for x in (*words[i][:-1], words[i][-1] + END)], np.int64)
        owner = np.repeat(np.array(short, np.int64), [len(words[i]) for i in short]) if short else np.zeros(0, np.int64)
        while len(ids):
            rank = np.full(len(ids), _NONE)
            at = np.minimum(np.searchsorted(self.codes, code := ids[:-1] * self.size + ids[1:]), len(self.codes) - 1)
            hit = (self.codes[at] == code) & (owner[1:] == owner[:-1])
            rank[:-1][hit] = self.code_rank[at[hit]]
            edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            least = np.minimum.reduceat(rank, edge)
            size = np.diff(np.r_[edge, len(ids)])
            done = np.repeat(least == _NONE, size)
            if done.any():
                for lo, n in zip(edge[least == _NONE].tolist(), size[least == _NONE].tolist(), strict=True):
                    out[owner[lo]] = ids[lo : lo + n]
            place = np.flatnonzero((rank == np.repeat(least, size)) & ~done)
            place = place[np.r_[True, owner[place[1:]] != owner[place[:-1]]]] if len(place) else place
            ids = ids.copy()
            ids[place] = self.made[rank[place]]
            stay = ~done
            stay[place + 1] = False
            ids, owner = ids[stay], owner[stay]
        return np.concatenate([*out, np.zeros(0, np.int64)]), np.array([len(x) for x in out], np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encodes new words and adds them to the table: first those that pass, then those that merges have to settle."""
        letters = ("\n".join(words) + "\n").encode().decode("latin-1").translate(self.letters)
        found = list(self.automaton.iter_long(letters))
        end = np.fromiter((e for e, _ in found), np.int64, len(found)) + 1
        pair = np.array([v for _, v in found], np.int64).reshape(-1, 2)
        ids, size = pair[:, 0], pair[:, 1]
        split = letters.split(_STOP)[:-1]
        edge = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in split], out=edge[1:])
        word = np.searchsorted(edge, end - 1, "right") - 1
        good = np.bincount(word, size, len(words)) == np.diff(edge)  # the proposal leaves nothing out
        good[word[~self.stable[ids]]] = False
        near = np.flatnonzero(word[1:] == word[:-1])
        good[word[near[~self.compatible(ids[near], ids[near + 1])]]] = False
        bad = np.flatnonzero(~good)
        more, sizes = self._exact_many([split[i] for i in bad.tolist()])
        flat = np.concatenate([ids[good[word]], more])
        n = np.concatenate([np.bincount(word, minlength=len(words))[good], sizes])
        lo, base = self.offs[len(self.known)], len(self.known)
        self.flat = np.concatenate([self.flat[:lo], flat.astype(np.int32)])
        self.offs = np.concatenate([self.offs[: base + 1], lo + np.cumsum(n)])
        for k, i in enumerate([*np.flatnonzero(good).tolist(), *bad.tolist()], base):
            self.known[words[i]] = k

    @staticmethod
    def normal(text: str) -> str:
        """NFC, every character lowered by itself; white space only parts words, so runs of it may stay."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _pieces(self, text: str) -> list[str]:
        """Words of a text; added tokens stand among them behind a NUL-marked key."""
        if self.cut is None or not any(s in text for s in self.special):
            return _WORDS.findall(self.normal(text))
        out = []
        for i, part in enumerate(self.cut.split(text)):
            out += ["\0" + part] if i % 2 else _WORDS.findall(self.normal(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, none of which may be None."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        pieces = [self._pieces(t) for t in texts]
        words = [w for p in pieces for w in p]
        new = {w for w in words if w not in self.known}
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        n = self.offs[at + 1] - self.offs[at]
        ends = np.cumsum(n)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.offs[at] - (ends - n), n)]
        count = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, np.concatenate([[0], ends])[count]

    def decode(self, ids: np.ndarray) -> str:
        """The tokens of the ids joined by spaces, special ones included; ids without a token are left out."""
        return " ".join([t for t in self.texts[ids[(ids >= 0) & (ids < self.size)]] if t is not None])


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The worker's codec for a tokenizer file's content."""
    name = hashlib.sha256(spec.encode()).hexdigest()
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(spec)
    return _codecs[name]


def _batches(texts: Iterable[str | None]):
    held, size = [], 0
    for t in texts:
        t = t or ""
        if held and size + len(t) > BATCH_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _read(path: str | None) -> str:
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs with `ids`, the token ids of `text` (empty for null and empty texts), in place of any column of that name.

    The tokenizer file is read by the driver and sent to the executors once; its size is fixed. Very long texts are
    encoded whole; all other columns stay.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_read(path))
    names = [c for c in docs.columns if c != "ids"]

    def run(batches):
        use = codec(spec.value)
        for b in batches:
            flat, size = [], []
            for texts in _batches(b.column("text").to_pylist()):
                ids, offs = use.encode(texts)
                flat.append(ids)
                size.append(np.diff(offs))
            offs = np.concatenate([[0], np.cumsum(np.concatenate([*size, np.zeros(0, np.int64)]))]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate([*flat, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), ids], [*names, "ids"])

    kept = docs.select(*names)
    return kept.transform(map_arrow, run, StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with `decoded`, the text of `ids` (null for null ids), in place of any column of that name."""
    spec = rows.sparkSession.sparkContext.broadcast(_read(path))
    names = [c for c in rows.columns if c != "decoded"]

    def run(batches):
        use = codec(spec.value)
        for b in batches:
            col = b.column("ids")
            out = [None if x is None else use.decode(np.array(x, np.int64)) for x in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.string())], [*names, "decoded"])

    kept = rows.select(*names)
    return kept.transform(map_arrow, run, StructType([*kept.schema.fields, StructField("decoded", StringType())]))


def digests(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and ids if asked for, for every row of docs(doc_id, text), encoded and decoded in one pass.

    Null texts count as empty; rows that repeat give equal rows; other columns are ignored.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_read(path))

    def run(batches):
        use = codec(spec.value)
        for b in batches:
            n, first, second, flat = [], [], [], []
            for texts in _batches(b.column(1).to_pylist()):
                ids, offs = use.encode(texts)
                flat.append(ids)
                for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                    own = ids[lo:hi]
                    n.append(hi - lo)
                    first.append(hashlib.sha256(" ".join(use.numbers[own]).encode()).hexdigest())
                    second.append(hashlib.sha256(use.decode(own).encode()).hexdigest())
            cols = {"doc_id": b.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(first, pa.string()), "decoded_sha256": pa.array(second, pa.string())}
            if with_ids:
                edge = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                cols["ids"] = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([*flat, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(map_arrow, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: digests of every document's ids and decoded text."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
