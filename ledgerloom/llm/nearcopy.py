"""SimHash near-dedup at a shingle similarity: wide fingerprints find candidates, an exact Jaccard similarity decides.

Texts of equal words (A-Z lowered) are one class. A class has a SimHash of BITS bits over its distinct shingles of five
words. Two sets at similarity s have count vectors at an angle of acos(2s/(1+s)) or less, so bits differ with a
probability of 0.152 or less at 0.8, and 55 differing bits of 256 let 99.7 % of such pairs pass.

1. Every class has `tables` keys of sampled fingerprint bits; the number of bits grows with the logarithm of the number
   of classes, so a key holds few unlike texts at any size, and the number of tables follows from RECALL.
2. Within a key, bit-sliced comparison (simhash.close_pairs) finds the pairs within the radius; each pair is passed on
   under the first key that it shares. A key of more than STAR classes first compares all with one: the member nearest
   to the bitwise majority, which for copies of one text is that text or a copy next to it.
3. Candidates are verified: the exact Jaccard similarity of their shingles, by a join with the texts.
4. Crowded keys whose members aren't one component yet come again with their shingles, in pairs of tiles of CAP / 2
   rows. Members outside of a tile pair's largest component are compared with all, and what lies within the radius is
   verified in the task unless links already connect it. So a large group costs little where its texts are alike, and no
   link between two of its texts is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._components import connected_components
from ledgerloom.llm._util import forget, join_small, map_arrow, materialize, shuffle_partitions
from ledgerloom.llm._words import SPACE, blocks, mix, row_of, spans, word_hashes
from ledgerloom.llm.simhash import _pairs, _runs, close_pairs, close_to, streamed

SHINGLE, SIMILARITY = 5, 0.8
BITS = 256
#: Share of pairs exactly at the similarity that get a common key; pairs above it do better (0.999 at 0.85).
RECALL = 0.99
#: Classes of a key that are compared all with all at once; rows of a key that are read together; rows of two tiles.
STAR, PIECE, CAP = 32, 1 << 15, 4096
#: Parts into which the pairs of one class are dealt.
SALTS = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * _STEP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def differing_share(similarity: float) -> float:
    """Most probability that a bit differs between two texts of this similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def radius_of(similarity: float, bits: int = BITS) -> int:
    """Differing bits that 99.7 % of the pairs at the similarity stay within."""
    p = differing_share(similarity)
    return math.ceil(bits * p + 2.75 * math.sqrt(bits * p * (1 - p)))


class Shingles:
    """Distinct hashed shingles of a block of texts, sorted within each text: hash, row, and the place of each text's first."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, words: int = SHINGLE):
        starts, ends, first = spans(~SPACE[buf], offs)
        both = word_hashes(_LOWER[buf], starts, ends)
        size, n = np.diff(first), len(offs) - 1
        #: of each text: a digest of its words
        self.whole = np.zeros((n, 2), np.uint64)
        row = row_of(first)
        place = (np.arange(len(row)) - first[row]).astype(np.uint64) if len(row) else np.zeros(0, np.uint64)
        for i in range(2):
            total = np.zeros(len(row) + 1, np.uint64)
            np.cumsum(mix(both[:, i] + mix(place + np.uint64(1))), out=total[1:])
            self.whole[:, i] = total[first[1:]] - total[first[:-1]] + size.astype(np.uint64)
        word = both[:, 0]
        hashes, rows = [], []
        for k in range(1, words + 1):
            at = np.flatnonzero(place + np.uint64(k) <= size[row].astype(np.uint64)) if k == words else first[:-1][size == k]
            h = np.zeros(len(at), np.uint64)
            for i in range(k):
                h = mix(h * _STEP + word[at + i])
            hashes.append(h)
            rows.append(row[at])
        h, r = np.concatenate(hashes), np.concatenate(rows)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        keep = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])][: len(h)]
        self.hash, self.row = h[keep], r[keep]
        self.first = np.searchsorted(self.row, np.arange(n + 1))

    def fingerprints(self, bits: int = BITS) -> np.ndarray:
        """(texts, bits / 64) words: a bit is 1 if more than half of the shingles' hashes have it; 0 without shingles."""
        n = len(self.first) - 1
        ones = np.zeros((n, bits), np.int32)
        for lo in range(0, len(self.hash), 1 << 14):
            h, r = self.hash[lo : lo + (1 << 14)], self.row[lo : lo + (1 << 14)]
            wide = np.stack([mix(h + _SEEDS[i]) for i in range(bits // 64)], axis=1)
            # bits are bytes of which eight are added at once, at most 255 rows before they are carried over
            edge = np.unique(np.r_[np.flatnonzero(np.r_[True, r[1:] != r[:-1]]), np.arange(0, len(r), 255)])
            counts = np.add.reduceat(np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little").view(np.uint64), edge, axis=0).view(np.uint8)
            part = np.flatnonzero(np.r_[True, r[edge[1:]] != r[edge[:-1]]])
            ones[r[edge[part]]] += np.add.reduceat(counts, part, axis=0, dtype=np.int32)
        return np.packbits(2 * ones > np.diff(self.first)[:, None], axis=1, bitorder="little").view(np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted distinct arrays; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


class Tables:
    """Keys of sampled bits, as many as RECALL asks for at `classes` fingerprints."""

    def __init__(self, classes: int, similarity: float, bits: int = BITS, recall: float = RECALL):
        self.width = min(48, max(16, math.ceil(math.log2(max(classes, 1))) - 2))
        self.count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing_share(similarity)) ** self.width))
        rng = np.random.default_rng(bits)
        self.at = np.stack([rng.choice(bits, self.width, replace=False) for _ in range(self.count)])

    def keys(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprints, tables): the bits of each table with its number."""
        bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
        out = np.zeros((len(fp), 8 * self.count), np.uint8).reshape(len(fp), self.count, 8)
        packed = np.packbits(bits[:, self.at.ravel()].reshape(len(fp), self.count, self.width), axis=2, bitorder="little")
        out[:, :, : packed.shape[2]] = packed
        return (mix(out.view(np.uint64)[:, :, 0] + mix(np.arange(1, self.count + 1, dtype=np.uint64))[None, :])).view(np.int64)

    def first_shared(self, a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which pairs of fingerprints share `key` as their first common one."""
        out = np.zeros(len(a), bool)
        for lo in range(0, len(a), 4096):
            x, y = self.keys(a[lo : lo + 4096]), self.keys(b[lo : lo + 4096])
            out[lo : lo + 4096] = x[np.arange(len(x)), (x == y).argmax(1)] == key[lo : lo + 4096]
        return out


def _words_of(column: pa.Array) -> np.ndarray:
    """Fingerprints of a binary column as (rows, words)."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1) if len(column) else np.zeros((0, BITS // 64), np.uint64)


def _bytes(rows: np.ndarray) -> pa.Array:
    """Rows of words as a binary column."""
    size = rows.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _fingerprinted(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, a, b, fp): a digest of the words and the fingerprint of every row."""

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in blocks(b.column(1)):
                s = Shingles(buf, offs, words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(s.whole[:, i].view(np.int64)) for i in (0, 1)), _bytes(s.fingerprints())], ["doc_id", "a", "b", "fp"])

    return docs.transform(map_arrow, run, "doc_id long, a long, b long, fp binary")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, grams): the shingles of every row."""

    def run(batches):
        for b in batches:
            for lo, hi, buf, offs in blocks(b.column(1)):
                s = Shingles(buf, offs, words)
                grams = [s.hash[i:j].tobytes() for i, j in zip(s.first[:-1], s.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(grams, pa.binary())], ["id", "grams"])

    return docs.transform(map_arrow, run, "id long, grams binary")


def _keyed(classes: DataFrame, tables: Tables) -> DataFrame:
    """(key, rep, fp): every class under each of its keys."""

    def run(batches):
        for b in batches:
            rep, fps = b.column(0).to_numpy(zero_copy_only=False), _words_of(b.column(1))
            for lo in range(0, len(rep), 512):
                keys = tables.keys(fps[lo : lo + 512])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(rep[lo : lo + 512], tables.count)), _bytes(np.repeat(fps[lo : lo + 512], tables.count, axis=0))], ["key", "rep", "fp"])

    return classes.select("rep", "fp").transform(map_arrow, run, "key long, rep long, fp binary")


def _centre(fps: np.ndarray) -> int:
    """The fingerprint nearest to the bitwise majority."""
    ones = sum(np.unpackbits(fps[i : i + 4096].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, len(fps), 4096))
    majority = np.packbits(2 * ones > len(fps), bitorder="little").view(np.uint64)
    return int(np.bitwise_count(fps ^ majority).sum(1).argmin())


def _candidates(tables: Tables, radius: int, star: int):
    """Rows sorted by key to (kind, u, v): pairs to verify (0), or a key that is crowded and its rows in this piece (1)."""

    def run(batches):
        centre: list = [None, None, None]  # key, class and fingerprint of a group that is still being read

        def settle(cols):
            key, rep, fps = cols[0], cols[1], _words_of(cols[2])
            group = _runs([key])
            size = np.bincount(group)
            small = (size[group] <= star) & (size[group] > 1) & (key != centre[0] if centre[0] is not None else True)
            if small.any():
                r, f, k = rep[small], fps[small], key[small]
                i, j = close_pairs(group[small], f, radius)
                own = tables.first_shared(f[i], f[j], k[i])
                yield _kinds(0, r[i[own]], r[j[own]])
            for g in np.flatnonzero((size > star) | (key[np.r_[0, np.cumsum(size)[:-1]]] == centre[0] if centre[0] is not None else False)):
                at = np.flatnonzero(group == g)
                if key[at[0]] != centre[0]:
                    mid = at[_centre(fps[at])]
                    centre[:] = key[mid], rep[mid], fps[mid : mid + 1].copy()
                _, near = close_to(centre[2], fps[at], radius)
                near = at[near][rep[at[near]] != centre[1]]
                yield _kinds(0, np.full(len(near), centre[1]), rep[near])
                yield _kinds(1, key[at[:1]], np.array([len(at)]))

        yield from streamed(batches, 1, settle, PIECE)

    return run


def _kinds(kind: int, u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["kind", "u", "v"])


def _similar(pairs: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """Those of pairs(u, v) whose texts have the similarity; the pairs of a frequent u are dealt over SALTS parts."""
    ids = materialize(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct().withColumn("_asked", F.lit(True)), "asked", 2 * pairs.count())
    sets = materialize(join_small(docs, ids, ["doc_id"], "inner").select("doc_id", "text").transform(_sets, words), "grams")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    left = salted.select("u", "salt").distinct().join(sets.select(F.col("id").alias("u"), F.col("grams").alias("left")), "u")
    both = salted.join(left, ["u", "salt"]).join(sets.select(F.col("id").alias("v"), F.col("grams").alias("right")), "v").select("u", "v", "left", "right")

    def run(batches):
        for b in batches:
            get = lambda i: [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(i)]  # noqa: E731, B023
            keep = pa.array([jaccard(x, y) >= similarity for x, y in zip(get(2), get(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    links = materialize(both.transform(map_arrow, run, "u long, v long"), "links", 8 * pairs.count())  # rows with two lists weigh more
    forget(ids, sets)
    return links


def _verified(tables: Tables, radius: int, similarity: float):
    """Rows (key, t1, t2, tile, rep, c, fp, grams) sorted by the first three to links that join what isn't joined."""

    def settle(cols):
        group = _runs(cols[:3])
        edge = np.flatnonzero(np.r_[True, np.diff(group) > 0, True])
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            rep, c = cols[4][lo:hi], cols[5][lo:hi]
            names, part = np.unique(c, return_inverse=True)
            if len(names) < 2:
                continue
            fps, tile = _words_of(cols[6].slice(lo, hi - lo)), cols[3][lo:hi]
            rest = np.flatnonzero(part != np.bincount(part).argmax())
            i, j = close_to(fps[rest], fps, radius)
            i = rest[i]
            seen = np.zeros(len(rep), bool)
            seen[rest] = True
            good = (part[i] != part[j]) & ((i < j) | ~seen[j]) & (np.minimum(tile[i], tile[j]) == cols[1][lo]) & (np.maximum(tile[i], tile[j]) == cols[2][lo])
            i, j = i[good], j[good]
            good = tables.first_shared(fps[i], fps[j], np.full(len(i), cols[0][lo]))
            i, j = i[good], j[good]
            order = np.argsort(np.bitwise_count(fps[i] ^ fps[j]).sum(1), kind="stable")
            parent = list(range(len(names)))

            def root(x, parent=parent):
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            grams, u, v = cols[7], [], []
            for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
                x, y = root(part[a]), root(part[b])
                if x != y and jaccard(*(np.frombuffer(grams[lo + k].as_buffer(), np.uint64) for k in (a, b))) >= similarity:
                    parent[x] = y
                    u.append(rep[a])
                    v.append(rep[b])
            yield _pairs(u, v)

    return lambda batches: streamed(batches, 3, settle)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE) -> DataFrame:
    """(doc_id, component_id) for the rows of docs(doc_id, text) that aren't the first of their group.

    component_id is the smallest doc_id that links reach: equal words, or a similarity of `similarity` or more. Null and
    wordless texts are equal to each other; a text of fewer than `words` words is one shingle. Null doc_ids make no
    links and aren't in the result; rows that repeat a doc_id link through each of their texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    rows = materialize(_fingerprinted(docs, words), "fingerprinted")
    classes = materialize(rows.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp")), "classes", rows.count())
    size = classes.count()
    tables, radius, n = Tables(size, similarity), radius_of(similarity), shuffle_partitions(docs.sparkSession)
    dealt = _keyed(classes, tables).repartition(n, "key").sortWithinPartitions("key")
    found = materialize(dealt.transform(map_arrow, _candidates(tables, radius, STAR), "kind int, u long, v long"), "candidates", size * tables.count)
    pairs = found.filter("kind = 0 and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialize(pairs, "pairs", found.count())
    links = _similar(pairs, docs, similarity, words)
    parts = materialize(connected_components(links, rows=links.count()), "components", size)
    crowded = materialize(found.filter("kind = 1").groupBy(F.col("u").alias("key")).agg(F.sum("v").alias("n")), "crowded", size)
    forget(found, pairs)
    if not crowded.isEmpty():
        again = join_small(_keyed(classes, tables), crowded, ["key"], "inner")
        again = materialize(join_small(again, parts.withColumnRenamed("node", "rep"), ["rep"]).withColumn("c", F.coalesce("component", "rep")).drop("component"), "again")
        apart = materialize(again.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key"), "apart", again.count())
        own, again = again, join_small(again, apart, ["key"], "inner")
        ids = materialize(again.select(F.col("rep").alias("doc_id")).distinct(), "asked", size)
        sets = materialize(join_small(docs, ids, ["doc_id"], "inner").transform(_sets, words), "grams")
        again = again.join(sets.withColumnRenamed("id", "rep"), "rep").withColumn("tiles", F.ceil(F.col("n") / (CAP // 2)).cast("int"))
        again = again.withColumn("tiles", F.when(F.col("n") > CAP, F.col("tiles")).otherwise(1)).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
        again = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        again = again.select("key", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "rep", "c", "fp", "grams")
        more = again.repartition(n, "key", "t1", "t2").sortWithinPartitions("key", "t1", "t2").transform(map_arrow, _verified(tables, radius, similarity), "u long, v long")
        more = materialize(more, "more", 8 * own.count())
        if not more.isEmpty():
            both = links.unionByName(more)
            parts = materialize(connected_components(both, rows=both.count()), "components", size)
        forget(own, apart, ids, sets, more)
    named = classes.join(parts, classes["rep"] == parts["node"], "left").select("a", "b", F.coalesce("component", "rep").alias("component_id"))
    named = materialize(named, "named", size)
    forget(classes, links, parts, crowded)
    return rows.join(named, ["a", "b"]).filter("doc_id > component_id").select("doc_id", "component_id")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE) -> DataFrame:
    """docs without the near copies: of each group only the rows with its smallest doc_id; all columns stay, and so do rows with a null doc_id."""
    found = near_copies(docs, similarity, words).select(F.col("doc_id").alias("_copy")).distinct().coalesce(shuffle_partitions(docs.sparkSession) // 8 + 1)
    return join_small(docs.withColumn("_copy", F.col("doc_id").cast("long")), materialize(found, "copies"), ["_copy"], "left_anti").drop("_copy")
