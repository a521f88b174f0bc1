"""SimHash near-duplicates: 64-bit fingerprints, linked at few differing bits by bit-sliced comparison.

Fingerprints are collapsed to distinct ones first, so exact copies never meet. A pigeonhole key (two of four
16-bit blocks agree for every pair within two bits) brings candidates together; a key with more than HOT distinct
fingerprints is split again by the same rule on its remaining 32 bits, after which at most 65,536 distinct
fingerprints can share a key. Within a key, pairs are lanes: XORs of fingerprints are stored as vertical bit planes,
carry-save counters update all distances of a block at once, and a block is abandoned when all its lanes exceed the
radius. Only links that join what isn't joined yet leave a key.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._components import connected_components, spanning
from ledgerloom.llm._util import forget, join_small, map_arrow, materialize, shuffle_partitions

RADIUS = 2
SHINGLE = 3
#: Distinct fingerprints under one key above which the key is split again.
HOT = 1024

_FULL = ~np.uint64(0)


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; 0 for null and for texts without a word."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    n = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(flat[a:b], 42) for a, b in zip(starts, ends[n - 1 :], strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 255):  # bits are bytes of which eight are added at once
        ones += np.unpackbits(h[i : i + 255].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8).sum(0).view(np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row of docs(doc_id, text), as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, words) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(map_arrow, run, "doc_id long, fp long")


def plane_store(fp: np.ndarray) -> np.ndarray:
    """Fingerprints (n, 64-bit words) as vertical bit planes: row b has bit b of all fingerprints, 64 to a word, and room to shift."""
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    width = -(-packed.shape[1] // 8)
    store = np.zeros((len(packed), 8 * (width + 2)), np.uint8)
    store[:, : packed.shape[1]] = packed
    return store.view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three planes."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


def close_words(differing, count: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Of the lanes in `valid` (words of 64), those with `radius` differing bits at most.

    differing(k, at) gives planes k to k + 7 of the differing bits for the words `at`. Counters that overflow beyond the
    radius are kept as planes as well; words all of whose lanes have overflowed are abandoned.
    """
    at = np.flatnonzero(valid)
    out = np.zeros(len(valid), np.uint64)
    width = max(4, (radius + 1).bit_length())
    begin = (1 << width) - 1 - radius
    over = ~valid[at]
    digit = [np.full(len(at), _FULL if begin >> i & 1 else 0, np.uint64) for i in range(width)]
    for k in range(0, count, 8):
        x = differing(k, at)
        ones, a = _add(digit[0], x[0], x[1])
        ones, b = _add(ones, x[2], x[3])
        twos, c = _add(digit[1], a, b)
        ones, a = _add(ones, x[4], x[5])
        digit[0], b = _add(ones, x[6], x[7])
        digit[1], d = _add(twos, a, b)
        digit[2], carry = _add(digit[2], c, d)
        for i in range(3, width):
            digit[i], carry = digit[i] ^ carry, digit[i] & carry
        over |= carry
        if k % 16:
            alive = over != _FULL
            if not alive.all():
                at, over, digit = at[alive], over[alive], [y[alive] for y in digit]
                if not len(at):
                    return out
    out[at] = ~over
    return out


def close_pairs(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of fingerprints (n, words) within `radius` bits, inside each run of equal `group` values.

    The planes are stored once; all pairs at one distance in the order are compared by shifting them.
    """
    n = len(fp)
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    end = np.repeat(edge[1:], np.diff(edge))
    planes = plane_store(fp)
    width = planes.shape[1] - 2
    lanes = np.flatnonzero(end - np.arange(n) > 1)
    left, right, shift = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 1
    while len(lanes):
        mask = np.zeros(64 * width, bool)
        mask[lanes] = True
        far, by = divmod(shift, 64)

        def differing(k, at, far=far, by=np.uint64(by), back=np.uint64(64 - by)):
            own, other = planes[k : k + 8, at], planes[k : k + 8, np.minimum(at + far, width)]
            if by:
                other = (other >> by) | (planes[k : k + 8, np.minimum(at + far + 1, width)] << back)
            return own ^ other

        hit = close_words(differing, len(planes), np.packbits(mask, bitorder="little").view(np.uint64), radius)
        i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
        left.append(i)
        right.append(i + shift)
        shift += 1
        lanes = lanes[end[lanes] - lanes > shift]
    return np.concatenate(left), np.concatenate(right)


def close_to(queries: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, index) pairs of fingerprints within `radius` bits, all queries against all of fp."""
    planes = plane_store(fp)
    width = planes.shape[1] - 2
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    valid = np.packbits(np.arange(64 * width) < len(fp), bitorder="little").view(np.uint64)
    step = max(1, (1 << 16) // max(width, 1))
    for lo in range(0, len(queries), step):
        part = queries[lo : lo + step]
        own = np.where(np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little").T > 0, _FULL, np.uint64(0))
        hit = close_words(lambda k, at, own=own: planes[k : k + 8, at % width] ^ own[k : k + 8, at // width], len(planes), np.tile(valid, len(part)), radius)
        i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
        found[0].append(lo + i // (64 * width))
        found[1].append(i % (64 * width))
    return np.concatenate(found[0]), np.concatenate(found[1])


def streamed(batches, keys: int, settle, most: int = 0):
    """Batches sorted by their first `keys` columns, dealt to settle(columns) in whole groups; a group of more than `most` rows (0: any number) in pieces."""
    held: list | None = None
    for b in batches:
        cols = [b.column(i) for i in range(b.num_columns)]
        cols = [c if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in cols]
        held = cols if held is None else [_joined(x, y) for x, y in zip(held, cols, strict=True)]
        n = len(held[0])
        if not n:
            continue
        other = np.flatnonzero(np.any([k != k[-1] for k in held[:keys]], axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if most and n - cut > most:
            cut = n
        if cut:
            yield from settle([x[:cut] for x in held])
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield from settle(held)


def _joined(x, y):
    return pa.concat_arrays([x, y]) if isinstance(x, pa.Array) else np.concatenate([x, y])


def _runs(cols: list[np.ndarray]) -> np.ndarray:
    """A number for each run of equal rows."""
    return np.cumsum(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]) - 1


def _pairs(u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _compare(radius: int):
    def settle(cols):
        key, sub, fp, rep = cols
        group = _runs([key, sub])
        keep = np.bincount(group)[group] > 1
        if keep.any():
            rep = rep[keep]
            i, j = close_pairs(group[keep], np.ascontiguousarray(fp[keep]).view(np.uint64).reshape(-1, 1), radius)
            if len(i):
                yield _pairs(*spanning(rep[i], rep[j]))

    return lambda batches: streamed(batches, 2, settle)


def _part(fp, i: int, width: int):
    return F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keys(fp, tag: int, width: int, parts: list[int]):
    """One key for each two of the parts: the pair's number above the bits of both."""
    out = []
    for n, (i, j) in enumerate(combinations(parts, 2)):
        out.append(F.lit(tag * 64 + n).cast("long") * F.lit(1 << (2 * width)).cast("long") + _part(fp, i, width) * F.lit(1 << width).cast("long") + _part(fp, j, width))
    return out


def near_links(classes: DataFrame, hot: int = HOT, radius: int = RADIUS) -> DataFrame:
    """(u, v): representatives of fingerprints that lie within `radius` bits, enough of them to span every component.

    classes has distinct fingerprints: (fp, rep). `radius` is 2 at most (the keys promise no more).
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    pairs = list(combinations(range(4), 2))
    # each key carries its own number, so that a split key knows which 32 bits it has left
    keyed = classes.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), k.alias("key")) for n, k in enumerate(_keys(F.col("fp"), 0, 16, [0, 1, 2, 3]))])).alias("k")).select("fp", "rep", "k.n", "k.key")
    crowded = materialize(keyed.groupBy("key").count().filter(F.col("count") > hot).select("key", F.lit(True).alias("crowded")), "crowded", 6 * classes.count())
    keyed = join_small(keyed, crowded, ["key"])
    sub = F.lit(None).cast("array<long>")
    for n, pair in enumerate(pairs):
        left = [p * 2 + half for p in range(4) if p not in pair for half in (0, 1)]
        sub = F.when(F.col("n") == n, F.array(*_keys(F.col("fp"), 1, 8, left))).otherwise(sub)
    keyed = keyed.withColumn("sub", F.explode(F.when(F.col("crowded"), sub).otherwise(F.array(F.lit(-1).cast("long"))))).select("key", "sub", "fp", "rep")
    dealt = keyed.repartition(shuffle_partitions(classes.sparkSession), "key", "sub").sortWithinPartitions("key", "sub", "fp")
    return dealt.transform(map_arrow, _compare(radius), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs(doc_id, text); other columns are ignored.

    component_id is the smallest doc_id that links of `radius` or fewer differing bits reach, the row itself
    included. Null and wordless texts have fingerprint 0 and link as any other. Rows that repeat a doc_id each get
    a result; a null doc_id joins the class of its fingerprint (null if no other row has that) and makes no links.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes", rows.count())
    parts = materialize(connected_components(near_links(distinct.filter("rep is not null"), hot, radius)), "components", distinct.count())
    classes = distinct.join(parts, distinct["rep"] == parts["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    labelled = materialize(classes, "labelled", distinct.count())
    forget(parts, distinct)
    return rows.join(labelled, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs without the near-copies: of each component only the rows with its smallest doc_id; all columns stay.

    Rows with a null doc_id stay, as they have no rank in their group; rows that repeat the smallest doc_id all stay.
    """
    found = near_duplicates(docs, words, radius).filter("doc_id > component_id").select(F.col("doc_id").alias("_copy")).distinct()
    return join_small(docs.withColumn("_copy", F.col("doc_id").cast("long")), materialize(found, "copies"), ["_copy"], "left_anti").drop("_copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's fingerprint and component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
