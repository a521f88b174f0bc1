"""Substring dedup on a compacted de Bruijn graph of token k-mers.

A window of WINDOW words is a walk over k-mers of K words. Of its k-mers the one with the least hash (the leftmost of
equal ones) is its anchor, so equal windows have equal anchors wherever they lie. The run of a document's windows with one
anchor is an edge of the graph: up to 2 * WINDOW - K words from the k-mer on, known by two 64-bit hashes of its words
and by its source coordinates, the document with the smallest doc_id that has it and the place in it. The edges before and
after it in a document are its neighbours.

1. Edges with their coordinates and neighbours meet by k-mer; aggregates give each edge its source and its in and out
   degree, that is, whether all occurrences come from one edge and go on to one. A task passes on one row for each kind
   of edge that it has seen, so a passage that a third of all documents share makes no large group.
2. A repeated edge that is the only way on from another, and that can only be reached from it, continues the other's path:
   a join of the repeated edges with themselves at their source coordinates compacts such nonbranching paths, and a join
   with the occurrences gives each document one span for each path that it walks.
3. Where a k-mer branches (its occurrences differ somewhere in the edge), each kind of edge is sent back to its source
   coordinates once and split into single windows, which meet by their own hashes.
4. Verification: the words at the source coordinates of every span are digested by SHA-256, the digests meet the
   spans by a join, and a document loses words only where its own words have the digest of the source's.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm._util import forget, join_listed, map_arrow, materialize, shuffle_partitions
from ledgerloom.llm._words import SPACE, Hasher, blocks, covered, mix, row_of, spans, word_hashes

WINDOW = 50
K = 20
#: Rows that a task holds before it compacts them.
HELD = 1 << 18
#: Kinds of edges that a task passes on for one k-mer before it settles itself that the k-mer branches.
KINDS = 8

_TAG_BITS = 24
#: Neighbours of an edge: none at the end of a document, more than one kind.
_NONE, _SEVERAL = 0, -1
#: Edges, and what a task has settled itself: spans with their source (kind 1) and edges to split (kind 2).
_EDGE = "kind int, key long, b1 long, b2 long, doc long, tag int, lo long, n long, before long, after long, src long, src_tag int, src_lo long"
_SPAN = ["doc", "tag", "lo", "n", "src", "src_tag", "src_lo"]


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the offset of the least of values[i : i + width], the leftmost of equal ones."""
    val, off, done = values, np.zeros(len(values), np.uint8), 1
    while done < width:
        step = min(done, width - done)
        left = val[:-step] <= val[step:]
        off = np.where(left, off[:-step], off[step:] + np.uint8(step))
        val = np.where(left, val[:-step], val[step:])
        done += step
    return off


class Grams:
    """Two independent families of hashes of the words in a block of documents."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, hashers: tuple[Hasher, Hasher]):
        self.starts, self.ends, self.first = spans(~SPACE[buf], offs)
        both = word_hashes(buf, self.starts, self.ends)
        self.hashers = hashers
        self.sums = [h.gram_sums(both[:, i]) for i, h in enumerate(hashers)]

    def hash(self, family: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.hashers[family].grams(self.sums[family], lo, hi)

    def tags(self) -> np.ndarray:
        """A short hash of each document's words, which tells rows with one doc_id apart."""
        return (self.hash(0, self.first[:-1], self.first[1:]) >> np.uint64(64 - _TAG_BITS)).astype(np.int64)


def _table(kind: int, **cols) -> pa.RecordBatch:
    """Columns of _EDGE; those not given are null."""
    n = len(cols["doc"])
    cols["kind"] = np.full(n, kind)
    kinds = {x.split()[0]: pa.int32() if x.endswith(" int") else pa.int64() for x in _EDGE.split(", ")}
    return pa.RecordBatch.from_arrays([pa.array(cols[k], t) if k in cols else pa.nulls(n, t) for k, t in kinds.items()], list(kinds))


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Which of the sorted rows differ from the one before."""
    return np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]


def _one_or_several(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    low, high = np.minimum.reduceat(values, edge), np.maximum.reduceat(values, edge)
    return np.where(low == high, low, _SEVERAL)


def _edges_of(window: int, k: int):
    """Documents to edges: one row for each kind of edge in the task, and what the task knows about the others."""
    width = window - k + 1

    def compact(parts: list[list[np.ndarray]]):
        key, b1, b2, doc, lo, n, tag, before, after = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((lo, tag, doc, b2, b1))
        key, b1, b2, doc, lo, n, tag, before, after = (x[order] for x in (key, b1, b2, doc, lo, n, tag, before, after))
        new = _starts(b1, b2)
        edge = np.flatnonzero(new)
        at = edge[np.cumsum(new) - 1]
        gone = doc > doc[at]
        group = np.cumsum(new) - 1
        before, after = _one_or_several(before, edge)[group], _one_or_several(after, edge)[group]
        kept = np.flatnonzero(~gone)
        # k-mers with many kinds in this task branch: two of the kinds tell the others' tasks so, the rest go straight to be split
        near = np.lexsort((doc[kept], key[kept]))
        own = key[kept][near]
        begin = np.flatnonzero(_starts(own))
        last = np.r_[begin[1:], len(own)] - 1
        d = doc[kept][near]
        crowded = (last - begin >= KINDS) & (d[begin] < d[last])
        straight = np.repeat(crowded, last - begin + 1)
        straight[begin] = straight[last] = False
        wide = np.zeros(len(kept), bool)
        wide[near[straight]] = True
        keep, split = kept[~wide], kept[wide]
        yield _table(0, key=_signed(key[keep]), b1=_signed(b1[keep]), b2=_signed(b2[keep]), doc=doc[keep], tag=tag[keep], lo=lo[keep], n=n[keep], before=before[keep], after=after[keep])
        if len(split):
            yield _table(2, doc=doc[split], tag=tag[split], lo=lo[split], n=n[split])
        if gone.any():
            at = at[gone]
            yield _spans(_merged(doc[gone], tag[gone], lo[gone], n[gone], doc[at], tag[at], lo[at]))

    def run(batches):
        hashers, parts, held = (Hasher(0), Hasher(1)), [], 0
        for b in batches:
            ids, known = b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for r, _, buf, offs in blocks(b.column(1)):
                g = Grams(buf, offs, hashers)
                row = row_of(g.first)
                if len(row) < window:
                    continue
                i = np.arange(len(row) - window + 1)
                i = i[(row[i] == row[i + window - 1]) & known[r + row[i]]]
                if not len(i):
                    continue
                all_k = np.arange(len(row) - k + 1)
                kmers = g.hash(0, all_k, all_k + k)
                anchor = i + _leftmost_min(kmers, width)[i]
                at = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                n = np.diff(np.r_[at, len(i)])
                lo = i[at]
                shape = mix(n.astype(np.uint64) * np.uint64(64) + (anchor[at] - lo).astype(np.uint64))
                b1 = g.hash(0, lo, lo + n + window - 1) + shape
                name = np.where((b1 == 0) | (b1 == ~np.uint64(0)), np.uint64(1), b1).view(np.int64)
                same = row[lo[1:]] == row[lo[:-1]]
                before, after = np.full(len(at), _NONE), np.full(len(at), _NONE)
                before[1:][same], after[:-1][same] = name[:-1][same], name[1:][same]
                parts.append([kmers[anchor[at]], b1, g.hash(1, lo, lo + n + window - 1) + shape, ids[r + row[lo]], lo - g.first[row[lo]], n, g.tags()[row[lo]], before, after])
                held += len(at)
                if held >= HELD:
                    yield from compact(parts)
                    parts, held = [], 0
        if parts:
            yield from compact(parts)

    return run


def _merged(doc, tag, lo, n, src, src_tag, src_lo) -> list[np.ndarray]:
    """Spans in order, those that go on in both documents as one."""
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, n, src, src_tag, src_lo = (x[order] for x in (doc, tag, lo, n, src, src_tag, src_lo))
    new = _starts(doc, tag, src, src_tag, src_lo - lo)
    new[1:] |= lo[1:] > lo[:-1] + n[:-1]
    at = np.flatnonzero(new)
    return [doc[at], tag[at], lo[at], np.maximum.reduceat(lo + n, at) - lo[at], src[at], src_tag[at], src_lo[at]] if len(at) else [doc, tag, lo, n, src, src_tag, src_lo]


def _spans(cols: list[np.ndarray]) -> pa.RecordBatch:
    return _table(1, **dict(zip(_SPAN, cols, strict=True)))


def _windows_of(window: int):
    """Documents with the edges to split: one row for each window in the task (kind 0), and spans of those known to repeat."""

    def compact(parts):
        w1, w2, doc, tag, lo = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((lo, tag, doc, w2, w1))
        w1, w2, doc, tag, lo = (x[order] for x in (w1, w2, doc, tag, lo))
        new = _starts(w1, w2)
        edge = np.flatnonzero(new)
        at = edge[np.cumsum(new) - 1]
        gone = doc > doc[at]
        yield _table(0, b1=_signed(w1[~gone]), b2=_signed(w2[~gone]), doc=doc[~gone], tag=tag[~gone], lo=lo[~gone])
        if gone.any():
            at = at[gone]
            yield _spans(_merged(doc[gone], tag[gone], lo[gone], np.ones(len(at), np.int64), doc[at], tag[at], lo[at]))

    def run(batches):
        hashers, parts, held = (Hasher(0), Hasher(1)), [], 0
        for b in batches:
            ids, asked = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            edges = asked.offsets.to_numpy() - asked.offsets[0].as_py()
            flat = asked.flatten()
            lo, n, tag = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            for r, hi, buf, offs in blocks(b.column(1)):
                g = Grams(buf, offs, hashers)
                own = slice(edges[r], edges[hi])
                row = np.repeat(np.arange(hi - r), np.diff(edges[r : hi + 1]))
                own_lo, own_n, own_tag = lo[own], n[own], tag[own]
                fits = (g.tags()[row] == own_tag) & (g.first[row] + own_lo + own_n + window - 1 <= g.first[row + 1])
                row, own_lo, own_n, own_tag = row[fits], own_lo[fits], own_n[fits], own_tag[fits]
                if not len(row):
                    continue
                step = np.arange(own_n.sum()) - np.repeat(np.cumsum(own_n) - own_n, own_n)
                row, place, own_tag = np.repeat(row, own_n), np.repeat(own_lo, own_n) + step, np.repeat(own_tag, own_n)
                i = g.first[row] + place
                parts.append([g.hash(0, i, i + window), g.hash(1, i, i + window), ids[r + row], own_tag, place])
                held += len(i)
                if held >= HELD:
                    yield from compact(parts)
                    parts, held = [], 0
        if parts:
            yield from compact(parts)

    return run


def _met_edges(edges: DataFrame) -> DataFrame:
    """Edges with their source, their degrees over all documents, and whether their k-mer branches; only what repeats or branches."""
    kind, key = Window.partitionBy("key", "b1", "b2"), Window.partitionBy("key")
    rows = edges.filter("kind = 0").select("key", "b1", "b2", "doc", "tag", "lo", "n", "before", "after").repartition(shuffle_partitions(edges.sparkSession), "key")
    rows = rows.withColumn("source", F.min(F.struct("doc", "tag", "lo")).over(kind)).withColumn("repeats", F.max("doc").over(kind) > F.col("source.doc"))
    for c in ("before", "after"):
        rows = rows.withColumn(c, F.when(F.min(c).over(kind) == F.max(c).over(kind), F.col(c)).otherwise(_SEVERAL))
    several = (F.min("b1").over(key) < F.max("b1").over(key)) | (F.min("b2").over(key) < F.max("b2").over(key))
    rows = rows.withColumn("branches", several & (F.min("doc").over(key) < F.max("doc").over(key)))
    rows = rows.filter("repeats or branches").select("b1", "doc", "tag", "lo", "n", "before", "after", "repeats", "branches", F.col("source.doc").alias("src"), F.col("source.tag").alias("src_tag"), F.col("source.lo").alias("src_lo"))
    return materialize(rows, "met", edges.filter("kind = 0").count())


def _paths(met: DataFrame) -> DataFrame:
    """(src, src_tag, src_lo, path): every repeated edge, by its source coordinates, with the first edge of its nonbranching path."""
    own = met.filter("repeats and doc = src and tag = src_tag and lo = src_lo").select("src", "src_tag", "src_lo", "n", "b1", "before", "after").distinct()
    ahead = own.filter(F.col("after") != _SEVERAL).select("src", "src_tag", (F.col("src_lo") + F.col("n")).alias("src_lo"), F.col("b1").alias("_from"), F.col("after").alias("_to"))
    both = own.join(ahead, ["src", "src_tag", "src_lo"], "left")
    both = both.withColumn("goes_on", F.coalesce((F.col("before") == F.col("_from")) & (F.col("_to") == F.col("b1")), F.lit(False)))
    order = Window.partitionBy("src", "src_tag").orderBy("src_lo")
    return both.select("src", "src_tag", "src_lo", F.max(F.when(~F.col("goes_on"), F.col("src_lo"))).over(order).alias("path"))


def _joined(single: DataFrame) -> DataFrame:
    """Spans of one window each, those that go on in both documents as one."""
    same = Window.partitionBy("doc", "tag", "src", "src_tag", F.col("src_lo") - F.col("lo")).orderBy("lo")
    rows = single.withColumn("_run", F.col("lo") - F.dense_rank().over(same))
    return rows.groupBy("doc", "tag", "src", "src_tag", (F.col("src_lo") - F.col("lo")).alias("_far"), "_run").agg(F.min("lo").alias("lo"), F.countDistinct("lo").alias("n")).withColumn("src_lo", F.col("lo") + F.col("_far")).select(*_SPAN)


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc, tag, lo, n, src, src_tag, src_lo): runs of n windows from word lo of a document that hash like those from word
    src_lo of a document with a smaller doc_id; tags tell texts with the same doc_id apart. A window may be found twice.
    """
    if not 0 < k <= window < k + 64:
        raise ValueError("k must be 1 to window, window - k under 64")
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    edges = materialize(rows.transform(map_arrow, _edges_of(window, k), _EDGE), "edges")
    met = _met_edges(edges)
    n_met = met.count()
    paths = materialize(_paths(met), "paths", n_met)
    gone = met.filter("doc > src").join(paths, ["src", "src_tag", "src_lo"])
    gone = gone.withColumn("_far", F.col("src_lo") - F.col("lo"))
    walk = ["doc", "tag", "src", "src_tag", "path", "_far"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*walk).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walked = gone.withColumn("_run", F.col("lo") - before).groupBy(*walk, "_run").agg(F.min("lo").alias("lo"), F.sum("n").alias("n")).withColumn("src_lo", F.col("lo") + F.col("_far")).select(*_SPAN)
    asked = met.filter("branches and doc = src").select("doc", "lo", "n", "tag").unionByName(edges.filter("kind = 2").select("doc", "lo", "n", "tag")).distinct()
    listed = materialize(asked.groupBy("doc").agg(F.collect_list(F.struct("lo", "n", "tag")).alias("found")), "asked", n_met + edges.count())
    split = materialize(join_listed(rows, listed, "doc", True).select("doc", "text", "found").transform(map_arrow, _windows_of(window), _EDGE), "windows")
    same = Window.partitionBy("b1", "b2")
    single = split.filter("kind = 0").select("b1", "b2", "doc", "tag", "lo").repartition(n, "b1", "b2").withColumn("source", F.min(F.struct("doc", "tag", "lo")).over(same)).filter("doc > source.doc")
    single = _joined(single.select("doc", "tag", "lo", F.col("source.doc").alias("src"), F.col("source.tag").alias("src_tag"), F.col("source.lo").alias("src_lo")))
    settled = edges.filter("kind = 1").select(*_SPAN).unionByName(split.filter("kind = 1").select(*_SPAN))
    found = materialize(walked.unionByName(single).unionByName(settled), "spans", 2 * n_met + edges.count() + split.count())
    forget(edges, met, paths, listed, split)
    return found


def _digest(words: list[bytes], lo: int, n: int, window: int) -> bytes | None:
    """SHA-256 of the words of n windows from word lo on; None if the text ends before."""
    return hashlib.sha256(b" ".join(words[lo : lo + n + window - 1])).digest() if lo + n + window - 1 <= len(words) else None


def _tag(text: str, hashers: tuple[Hasher, Hasher]) -> int:
    buf = np.frombuffer(text.encode(), np.uint8)
    return int(Grams(buf, np.array([0, len(buf)]), hashers).tags()[0])


def _sources(window: int):
    """(src, text, found) to the digests of the spans asked for."""

    def run(batches):
        hashers = (Hasher(0), Hasher(1))
        for b in batches:
            out: list[tuple] = []
            for src, text, found in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = (text or "").encode().split()
                tag = _tag(text, hashers) if words else 0
                out += [(src, f["src_tag"], f["src_lo"], f["n"], _digest(words, f["src_lo"], f["n"], window)) for f in found if f["src_tag"] == tag]
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["src", "src_tag", "src_lo", "n", "digest"])

    return run


def verified_spans(docs: DataFrame, found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, found): per doc_id its spans (lo, n, tag) with the digests of the words at their source coordinates."""
    where = ["src", "src_tag", "src_lo", "n"]
    asked = found.select(*where).distinct().groupBy("src").agg(F.collect_list(F.struct("src_tag", "src_lo", "n")).alias("found"))
    rows = docs.select(F.col("doc_id").cast("long").alias("src"), F.col("text").cast("string").alias("text"))
    size = found.count()
    asked = materialize(asked, "sources", size)
    digests = join_listed(rows, asked, "src", True).select("src", "text", "found").transform(map_arrow, _sources(window), "src long, src_tag int, src_lo long, n long, digest binary")
    digests = materialize(digests.filter("digest is not null").distinct(), "digests", size)
    listed = materialize(found.join(digests, where).groupBy("doc").agg(F.collect_set(F.struct("lo", "n", "tag", "digest")).alias("found")), "listed", size)
    forget(asked, digests)
    return listed


def _removed(window: int, cut: bool):
    """Rows (doc_id, text, found, ...): what is left of each text."""

    def keep(text: str | None, found) -> tuple[list[bytes], int]:
        words = (text or "").encode().split()
        if found is None or not words:
            return words, 0
        tag = _tag(text, hashers)
        same = [(f["lo"], f["n"] + window - 1) for f in found if f["tag"] == tag and _digest(words, f["lo"], f["n"], window) == f["digest"]]
        if not same:
            return words, 0
        at = np.array(same, np.int64)
        gone = covered(len(words), at[:, 0], at[:, 1])
        return list(compress(words, (~gone).tolist())), int(gone.sum())

    hashers = (Hasher(0), Hasher(1))

    def digest(batches):
        for b in batches:
            out = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words, gone = keep(text, found)
                for x, y in zip(out, (len(words) + gone, gone, hashlib.sha256(b" ".join(words)).hexdigest()), strict=True):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    def texts(batches):
        for b in batches:
            out = []
            for text, found in zip(b.column("text").to_pylist(), b.column("_found").to_pylist(), strict=True):
                words, gone = keep(text, found) if found is not None else (None, 0)
                out.append(b" ".join(words).decode() if gone else text)
            names = [x for x in b.schema.names if x != "_found"]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if x == "text" else b.column(x) for x in names], names)

    return texts if cut else digest


def _found(docs: DataFrame, window: int, k: int) -> DataFrame:
    spans_ = repeated_spans(docs, window, k)
    listed = verified_spans(docs, spans_, window)
    forget(spans_)
    return listed


def digests(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs(doc_id, text); other columns are ignored.

    A null text has no words; texts of fewer than `window` words lose none. A null doc_id is neither smaller nor larger
    than others: such rows keep all words and remove none. Rows with one doc_id never remove words of each other.
    """
    found = _found(docs, window, k)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    joined = join_listed(rows, found, "doc").select(F.col("doc").alias("doc_id"), "text", "found")
    return joined.transform(map_arrow, _removed(window, False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """docs with the repeated words taken out of `text`; all columns stay.

    Texts that lose words have the rest joined by single spaces, others stay as they are; n_chars, if there, is counted anew.
    """
    found = _found(docs, window, k).select(F.col("doc").alias("_doc"), F.col("found").alias("_found"))
    joined = join_listed(docs.withColumn("_doc", F.col("doc_id").cast("long")), found, "_doc").select(*docs.columns, "_found")
    out = joined.transform(map_arrow, _removed(window, True), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what is left of every document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), m AS (
  SELECT h, min(doc_id) AS first FROM s GROUP BY h
), g AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM s JOIN m USING (h) WHERE first < doc_id
), u AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), k AS (
  SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY i) AS t FROM u ANTI JOIN g USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
