"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping cluster shards.

1. Valid vectors collapse to classes of equal vectors with equal labels.
2. Each label's classes are dealt to the clusters of their OVERLAP nearest pivots; pivots are a sample of bounded size,
   kept apart so that no group of copies has more than one. A cluster of more than CAP classes is dealt again to pivots of
   its own, whose number grows with it, so shards stay of one size as the table grows. What is still larger, a group of
   near copies, is dealt as pairs of random tiles, so that every pair of its members still meets.
3. In each shard a flat graph is built: searches from the medoid over a start graph of random projections give each
   node's candidates, robust pruning keeps DEGREE of them, reverse edges are added and pruned likewise.
4. The adjacency lists of a node from all its shards are united, and every member is searched for from the medoid;
   the beam closes in, then the search spreads through all nodes within a slack of the radius.
5. Every link found is verified in double precision and counted in one shard only; links that span components go to a
   distributed component search.
6. Recall is audited against brute force for a bounded sample of classes, half of them with links; below GOAL the beam
   and the overlap grow, and after ATTEMPTS all pairs of a label are compared exactly, in tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm._components import connected_components, spanning
from ledgerloom.llm._util import forget, join_small, map_arrow, materialize

RADIUS = 0.98
#: Cosine down to which the search spreads beyond the beam.
SLACK = 0.04
#: Classes per pivot, most pivots over all labels, most cosine between two pivots, clusters of a vector.
SHARD, PIVOTS, APART, OVERLAP = 256, 4096, 0.85, 2
#: Most classes of a shard that isn't tiled.
CAP = 4096
DEGREE, BEAM, EXPAND, ALPHA = 16, 40, 4, 1.2
#: Queries that are searched together.
QUERIES = 256
#: Classes in the audit, recall to reach and attempts.
AUDIT, GOAL, ATTEMPTS = 256, 0.95, 3

_CLASS = "label string, rep long, n long, raw binary"


def _units(raw: list[bytes], dtype=np.float64) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float32) if len(r) % 2 == 0 else np.frombuffer(r[:-1], np.float64) for r in raw]).astype(np.float64)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(dtype)


def _clean(batches):
    """Valid rows with their vector as bytes, one more byte behind doubles; invalid rows have none."""
    for b in batches:
        vec, out = b.column(2), [None] * b.num_rows
        good = vec.is_valid().to_numpy(zero_copy_only=False) & b.column(0).is_valid().to_numpy(zero_copy_only=False) & b.column(1).is_valid().to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(good).tolist():
            x = vec[i].values
            if len(x) and not x.null_count:
                x = x.to_numpy()
                x = x + x.dtype.type(0)  # no negative zeros
                if np.isfinite(x).all() and x.any():
                    out[i] = x.tobytes() + b"d" * (x.dtype == np.float64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "raw"])


def clean(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, raw, key): raw and key are null for rows that link with nothing. Single floats stay so, others become doubles."""
    kind = "float" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return rows.transform(map_arrow, _clean, "vec_id long, label string, raw binary").withColumn("key", F.md5("raw"))


def robust_prune(near: np.ndarray, sims: np.ndarray, between: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each row of candidates `near` (-1: none), those kept: the nearest one left, again and again, each of which
    removes the candidates that are alpha times nearer to it than to the row's own node. between: their cosines."""
    rows = np.arange(len(near))
    far = np.sqrt(np.maximum(2 - 2 * sims, 0))
    apart = np.sqrt(np.maximum(2 - 2 * between, 0))
    alive = near >= 0
    out = np.full((len(near), degree), -1, np.int64)
    for k in range(degree):
        dist = np.where(alive, far, np.inf)
        best = dist.argmin(1)
        some = np.isfinite(dist[rows, best])
        if not some.any():
            break
        out[some, k] = near[rows[some], best[some]]
        alive &= ~(alpha * apart[rows, best] <= far) | ~some[:, None]
        alive[rows, best] = False
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int, radius: float | None = None, slack: float = SLACK):
    """Best nodes of the greedy search for each query node: (ids, cosines), and with a radius also the pairs within it.

    x has unit rows, graph the neighbours of each node (-1: none). With a radius the search then spreads through every
    node within the slack, until no such node is left unexpanded.
    """
    q, m = len(queries), len(x)
    own = np.arange(q)[:, None]
    seen = np.zeros((q, m), bool)
    done = np.zeros((q, m), bool)
    ids = np.broadcast_to(start, (q, len(start))).copy()
    seen[own, ids] = True
    sims = x[queries] @ x[start].T
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def collect(row, node, sim):
        if radius is not None and (hit := sim >= radius - slack).any():
            pairs.append((row[hit] * m + node[hit], sim[hit]))

    def visit(row, node):
        """New neighbours of expanded (row, node): (row, node, cosine)."""
        to = graph[node]
        at = np.repeat(row, to.shape[1])
        to = to.ravel()
        fresh = (to >= 0) & ~seen[at, to]
        code = np.unique(at[fresh] * m + to[fresh])
        at, to = code // m, code % m
        seen[at, to] = True
        sim = np.empty(len(at), x.dtype)
        for i in range(0, len(at), 1 << 16):
            part = slice(i, i + (1 << 16))
            sim[part] = np.einsum("ij,ij->i", x[queries[at[part]]], x[to[part]])
        collect(at, to, sim)
        return at, to, sim

    collect(np.repeat(np.arange(q), len(start)), ids.ravel(), sims.ravel())
    while True:
        open_ = ~done[own, np.maximum(ids, 0)] & (ids >= 0)
        score = np.where(open_, sims, -np.inf)
        pick = np.argsort(-score, axis=1)[:, :EXPAND]
        row, col = np.nonzero(np.isfinite(np.take_along_axis(score, pick, 1)))
        if not len(row):
            break
        node = ids[row, pick[row, col]]
        done[row, node] = True
        at, to, sim = visit(row, node)
        if not len(at):
            continue
        n = np.bincount(at, minlength=q)
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        more = np.full((q, n.max()), -1, np.int64)
        more_sims = np.full((q, n.max()), -np.inf, x.dtype)
        more[at, place], more_sims[at, place] = to, sim
        ids, sims = np.concatenate([ids, more], 1), np.concatenate([sims, more_sims], 1)
        if ids.shape[1] > beam:
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
            ids[~np.isfinite(sims)] = -1
    if radius is None:
        return ids, sims, None
    used = 0
    while used < len(pairs):
        code = np.concatenate([p[0] for p in pairs[used:]])
        used = len(pairs)
        row, node = code // m, code % m
        new = ~done[row, node]
        row, node = row[new], node[new]
        done[row, node] = True
        if len(row):
            visit(row, node)
    code = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    return ids, sims, (code // m, code % m)


def medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.sum(0)))


def start_graph(x: np.ndarray, rng: np.random.Generator, projections: int = DEGREE // 2) -> np.ndarray:
    """Each node with those next to it in the orders of random projections."""
    m = len(x)
    graph = np.full((m, 2 * projections), -1, np.int64)
    for k in range(projections):
        order = np.argsort(x @ rng.standard_normal(x.shape[1]).astype(x.dtype), kind="stable")
        graph[order[1:], 2 * k] = order[:-1]
        graph[order[:-1], 2 * k + 1] = order[1:]
    return graph


def _prune_block(x: np.ndarray, nodes: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Robust pruning of the candidates of some nodes; repeated candidates and the nodes themselves go."""
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    near[near == nodes[:, None]] = -1
    order = np.argsort(near < 0, axis=1, kind="stable")
    near = np.take_along_axis(near, order, 1)[:, : max(1, int((near >= 0).sum(1).max(initial=0)))]
    v = x[np.maximum(near, 0)]
    sims = np.einsum("ij,ikj->ik", x[nodes], v)
    return robust_prune(near, sims, v @ v.transpose(0, 2, 1))


def build(x: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """The pruned graph of a shard's unit vectors, medoid searches included: (nodes, DEGREE) with -1 for none."""
    m = len(x)
    rng = np.random.default_rng(m)
    graph = start_graph(x, rng)
    start = np.unique(np.r_[medoid(x), rng.integers(m, size=min(m, 3))])
    kept = np.full((m, DEGREE), -1, np.int64)
    for i in range(0, m, QUERIES):
        nodes = np.arange(i, min(i + QUERIES, m))
        ids, _, _ = beam_search(x, graph, start, nodes, beam)
        kept[nodes] = _prune_block(x, nodes, np.concatenate([ids, graph[nodes]], 1))
    # reverse edges; nodes with too many are pruned again
    node, slot = np.nonzero(kept >= 0)
    to = kept[node, slot]
    order = np.argsort(to, kind="stable")
    node, to = node[order], to[order]
    n = np.bincount(to, minlength=m)
    place = np.arange(len(to)) - np.repeat(np.cumsum(n) - n, n)
    some = place < 3 * DEGREE  # the rest stay reachable by their own edges
    back = np.full((m, min(3 * DEGREE, n.max(initial=1))), -1, np.int64)
    back[to[some], place[some]] = node[some]
    both = np.concatenate([kept, back], 1)
    for i in range(0, m, QUERIES):
        nodes = np.arange(i, min(i + QUERIES, m))
        kept[nodes] = _prune_block(x, nodes, both[nodes])
    return kept


def _adjacency(beam: int):
    def run(table: pa.Table) -> pa.Table:
        """A shard's members (shard, t1, t2, tile, rep, n, raw) to (rep, near)."""
        table = table.sort_by("rep")
        rep = table["rep"].to_numpy()
        near = build(_units(table["raw"].to_pylist(), np.float32), beam) if len(rep) > 1 else np.full((1, 1), -1)
        lists = [rep[r[r >= 0]] for r in near]
        return pa.table({"shard": table["shard"], "rep": rep, "near": pa.array(lists, pa.list_(pa.int64()))})

    return run


def _links(beam: int, radius: float, exact: bool = False):
    def run(table: pa.Table) -> pa.Table:
        """A shard's members with united lists to verified counts (kind 0: u, rows linked) and spanning links (kind 1: u, v)."""
        table = table.sort_by("rep")
        rep, n, tile = table["rep"].to_numpy(), table["n"].to_numpy(), table["tile"].to_numpy()
        m = len(rep)
        t1, t2 = table["t1"][0].as_py(), table["t2"][0].as_py()
        lists = table["near"].combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        size = np.diff(lists.offsets.to_numpy())
        at = np.minimum(np.searchsorted(rep, flat), m - 1)
        here = rep[at] == flat
        node, to = np.repeat(np.arange(m), size)[here], at[here]
        count = np.bincount(node, minlength=m)
        graph = np.full((m, max(1, count.max(initial=0))), -1, np.int64)
        graph[node, np.arange(len(node)) - np.repeat(np.cumsum(count) - count, count)] = to
        x = _units(table["raw"].to_pylist())
        x32 = x.astype(np.float32)
        rng = np.random.default_rng(m)
        start = np.unique(np.r_[medoid(x32), rng.integers(m, size=min(m, 3))])
        codes = []
        for i in range(0, m, QUERIES):
            nodes = np.arange(i, min(i + QUERIES, m))
            row, to = np.nonzero(x32[nodes] @ x32.T >= radius - 1e-4) if exact else beam_search(x32, graph, start, nodes, beam, radius)[2]
            a = nodes[row]
            for j in range(0, len(a), 1 << 16):
                u, v = a[j : j + (1 << 16)], to[j : j + (1 << 16)]
                good = (u != v) & (np.einsum("ij,ij->i", x[u], x[v]) >= radius)
                codes.append(np.minimum(u, v)[good] * m + np.maximum(u, v)[good])
        code = np.unique(np.concatenate([*codes, np.zeros(0, np.int64)]))
        a, b = code // m, code % m
        # of a cluster's tile pairs, the one that is this pair's own; of clusters, the first that both are in
        mine = (np.minimum(tile[a], tile[b]) == t1) & (np.maximum(tile[a], tile[b]) == t2)
        a, b = a[mine], b[mine]
        homes = table["homes"].combine_chunks()
        width = int(np.diff(homes.offsets.to_numpy()).max(initial=1))
        home = np.full((m, width), -1, np.int64)
        k = np.diff(homes.offsets.to_numpy())
        home[np.repeat(np.arange(m), k), np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)] = homes.flatten().to_numpy(zero_copy_only=False)
        shared = (home[a][:, :, None] == home[b][:, None, :]) & (home[a] >= 0)[:, :, None]
        first = np.where(shared.any(2), home[a], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
        a, b = a[first == table["shard"][0].as_py()], b[first == table["shard"][0].as_py()]
        rows = np.bincount(a, n[b], m) + np.bincount(b, n[a], m)
        some = np.flatnonzero(rows)
        u, v = spanning(rep[a], rep[b]) if len(a) else (rep[:0], rep[:0])
        return pa.table({"kind": pa.array(np.r_[np.zeros(len(some), np.int32), np.ones(len(u), np.int32)]), "u": np.r_[rep[some], u], "v": np.r_[rows[some].astype(np.int64), v]})

    return run


def pivots(classes: DataFrame, shard: int = SHARD, most: int = PIVOTS) -> dict[tuple[str, int], tuple[int, np.ndarray]]:
    """{(label, bytes): (number of the first, unit vectors)} of labels with more than one pivot.

    A sample of at most 2 * most classes in all, by the hash of their vector, thinned to cosines below APART.
    """
    n = classes.count()
    rate = min(1.0 / shard, most / max(n, 1))
    crowded = classes.groupBy("label", F.length("raw").alias("size")).count().filter(F.col("count") > 2 * shard)
    picked = join_small(classes.withColumn("size", F.length("raw")), crowded, ["label", "size"], "inner").filter(F.pmod(F.xxhash64("raw"), F.lit(1 << 40)) < F.lit(int(rate * 1.0995e12)))
    found: dict[tuple[str, int], list[bytes]] = {}
    for r in picked.select("label", "size", "raw").orderBy(F.xxhash64("raw"), "rep").limit(2 * most).collect():
        found.setdefault((r[0], r[1]), []).append(bytes(r[2]))
    out, number = {}, 0
    for k in sorted(found):
        kept = _units(found[k], np.float32)
        kept = kept[_apart(kept)]
        if len(kept) > 1:
            out[k] = number, kept
            number += len(kept)
    return out


def _home(*parts) -> int:
    """The number of a cluster that has no number of its own, beyond those of the pivots."""
    return (1 << 62) | (xxhash.xxh64_intdigest(repr(parts)) & ((1 << 61) - 1))


def _apart(units: np.ndarray, most: float = APART) -> np.ndarray:
    """Places of the vectors, in order, that are less than `most` alike to all kept before."""
    kept: list[int] = []
    for i in range(len(units)):
        if not kept or (units[kept] @ units[i]).max() < most:
            kept.append(i)
    return np.array(kept, np.int64)


def _parted(overlap: int):
    def run(key, rows: pa.Table, pivots: pa.Table) -> pa.Table:
        """A part of a crowded cluster's members with all of its pivots: each member's nearest clusters in it."""
        centre = _units(pivots.sort_by("pivot_rep")["pivot_raw"].to_pylist(), np.float32) if pivots.num_rows else np.zeros((0, 1), np.float32)
        centre = centre[_apart(centre)] if len(centre) else centre
        shard = key[1].as_py()
        if len(centre) < 2:  # near copies of one vector: tiles part them
            homes = [[shard]] * rows.num_rows
        else:
            top = np.argsort(-(_units(rows["raw"].to_pylist(), np.float32) @ centre.T), axis=1, kind="stable")[:, :overlap]
            names = np.array([_home(shard, i) for i in range(len(centre))])
            homes = names[top].tolist()
        return pa.table({"rep": rows["rep"], "shards": pa.array(homes, pa.list_(pa.int64()))})

    return run


def part(rows: DataFrame, overlap: int, cap: int = CAP, shard: int = SHARD) -> DataFrame:
    """rows(size, shard, rep, raw, ...) with the members of every shard of more than `cap` dealt to clusters within it.

    A crowded shard of m members gets m / `shard` pivots, sampled by hash; members are dealt to them in pieces of about
    `cap`, each of which meets all of the shard's pivots.
    """
    full = materialize(rows.groupBy("shard").agg(F.count("*").alias("m")).filter(F.col("m") > cap), "crowded", rows.count())
    if full.isEmpty():
        return rows
    marked = join_small(rows, full, ["shard"])
    crowded = marked.filter("m is not null").withColumn("pieces", F.ceil(F.col("m") / cap).cast("int"))
    spot = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    picked = crowded.filter(spot < 1.0 / shard).select(*[F.col(c).alias(f"pivot_{c}") for c in ("size", "shard", "rep", "raw")], F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("pivot_piece"))
    dealt = crowded.withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")).select("size", "shard", "piece", "rep", "raw")
    keys = ["size", "shard", "piece"]
    found = dealt.groupBy(*keys).cogroup(picked.groupBy(*[f"pivot_{k}" for k in keys])).applyInArrow(_parted(overlap), "rep long, shards array<long>")
    found = crowded.drop("m", "pieces").join(materialize(found, "parted").withColumnRenamed("rep", "_rep"), F.col("rep") == F.col("_rep")).drop("_rep")
    return marked.filter("m is null").select(*rows.columns).unionByName(found.withColumn("shard", F.explode("shards")).select(*rows.columns))


def deal(classes: DataFrame, overlap: int, cap: int = CAP, shard: int = SHARD, exact: bool = False) -> DataFrame:
    """(label, size, shard, t1, t2, tile, rep, n, raw, homes): the members of every shard; homes are all clusters of a member.

    exact: a label is one cluster, so that all of its pairs meet in some shard.
    """
    near = {} if exact else pivots(classes, shard)

    def assign(batches):
        for b in batches:
            raw, label = b.column(3).to_pylist(), b.column(0).to_pylist()
            homes: list = [None] * len(raw)
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (r, k) in enumerate(zip(raw, label, strict=True)):
                groups.setdefault((k, len(r)), []).append(i)
            for key, own in groups.items():
                if key in near:
                    number, centres = near[key]
                    sims = _units([raw[i] for i in own], np.float32) @ centres.T
                    top = np.argsort(-sims, axis=1, kind="stable")[:, :overlap] + number
                    for i, t in zip(own, np.sort(top, axis=1).tolist(), strict=True):
                        homes[i] = t
                else:
                    for i in own:
                        homes[i] = [_home(*key)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(homes, pa.list_(pa.int64()))], [*b.schema.names, "homes"])

    rows = classes.transform(map_arrow, assign, _CLASS + ", homes array<long>").withColumn("shard", F.explode("homes"))
    rows = materialize(rows.select("label", F.length("raw").alias("size"), "shard", "rep", "n", "raw"), "dealt")
    dealt = rows if exact else materialize(part(rows, overlap, cap, shard).distinct(), "parts")
    homes = dealt.groupBy("rep").agg(F.array_sort(F.collect_set("shard")).alias("homes"))
    rows, done = materialize(dealt.join(homes, "rep"), "homes"), rows
    forget(done, dealt)
    full = materialize(rows.groupBy("shard").count().filter(F.col("count") > cap), "full", rows.count())
    rows = join_small(rows, full.select("shard", F.ceil(F.col("count") / (cap // 2)).cast("int").alias("tiles")), ["shard"])
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep"), F.coalesce("tiles", F.lit(1))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))
    return rows.select("label", "size", "shard", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "rep", "n", "raw", "homes")


def audit(classes: DataFrame, counts: DataFrame, radius: float = RADIUS, sample: int = AUDIT) -> tuple[float | None, int]:
    """(recall, links tested) of `counts` (u, rows linked) on at most `sample` classes against brute force over all classes.

    Half of the sample is drawn from all classes, half from those with links. Recall is the lesser of the share of all
    links and of the mean share per class, so that a large group doesn't stand for all; None if no class has a link.
    """
    order = [F.xxhash64("rep"), "rep"]
    linked = classes.join(counts.filter("linked > 0").select(F.col("u").alias("rep")), "rep", "left_semi")
    picked = [r for part in (classes, linked) for r in part.orderBy(*order).limit(sample // 2).select("label", "rep", "raw").collect()]
    picked = list({r[1]: r for r in picked}.values())
    if not picked:
        return None, 0
    groups: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for key in {(r[0], len(r[2])) for r in picked}:
        own = [r for r in picked if (r[0], len(r[2])) == key]
        groups[key] = np.array([r[1] for r in own]), _units([bytes(r[2]) for r in own])

    def count(batches):
        found: dict[int, int] = {}
        for b in batches:
            label, rep, n, raw = (b.column(i).to_pylist() for i in range(4))
            for key, (ids, x) in groups.items():
                own = [i for i in range(len(rep)) if label[i] == key[0] and len(raw[i]) == key[1]]
                if own:
                    close = x @ _units([raw[i] for i in own]).T >= radius
                    close &= ids[:, None] != np.array([rep[i] for i in own])[None, :]
                    for k, s in zip(ids.tolist(), (close @ np.array([n[i] for i in own])).tolist(), strict=True):
                        found[k] = found.get(k, 0) + s
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["u", "truth"])

    truth = classes.transform(map_arrow, count, "u long, truth long").groupBy("u").agg(F.sum("truth").alias("truth")).filter("truth > 0")
    share = F.coalesce("linked", F.lit(0)) / F.col("truth")
    links, found, mean = truth.join(counts, "u", "left").agg(F.sum("truth"), F.sum(F.coalesce("linked", F.lit(0))), F.avg(share)).first()
    return (min(float(found) / float(links), float(mean)), int(links)) if links else (None, 0)


def link(classes: DataFrame, radius: float = RADIUS) -> tuple[DataFrame, DataFrame, float | None, int]:
    """(u, linked), (u, v), the audited recall and the links it was tested on: rows that each class links with outside of it, and spanning links."""
    beam, overlap = BEAM, OVERLAP
    for attempt in range(ATTEMPTS + 1):
        exact = attempt == ATTEMPTS
        dealt = deal(classes, overlap, exact=exact)
        members = materialize(dealt, "members")
        keys = ["label", "size", "shard", "t1", "t2"]
        if exact:
            joined = members.withColumn("near", F.array().cast("array<long>"))
        else:
            lists = members.groupBy(*keys).applyInArrow(_adjacency(beam), "shard long, rep long, near array<long>")
            united = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
            joined = members.join(united, "rep").select(*keys, "tile", "rep", "n", "raw", "homes", "near")
        found = materialize(joined.groupBy(*keys).applyInArrow(_links(beam, radius, exact), "kind int, u long, v long"), "found")
        counts = found.filter("kind = 0").groupBy("u").agg(F.sum("v").alias("linked"))
        recall, tested = (1.0, 0) if exact else audit(classes, counts, radius)
        forget(members)
        if exact or recall is None or recall >= GOAL:
            break
        forget(found)
        beam, overlap = 2 * beam, overlap + 2
    return counts, found.filter("kind = 1").select("u", "v"), recall, tested


def near_duplicates(embeddings: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings(vec_id, embedding, label); other columns are ignored.

    Rows with equal labels link if their cosine in double precision is `radius` or more. Rows with a null vec_id or
    label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing: n_links 0,
    component_id the vec_id, kept true. Vectors of different length never link. Rows that repeat a vec_id are rows of
    their own and link as any others. Labels are equal if they are so as text. Links that the search misses are audited:
    below GOAL even after ATTEMPTS, all pairs of a label are compared.
    """
    rows = materialize(clean(embeddings), "rows")
    classes = rows.filter("raw is not null").groupBy("label", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    # rows that repeat a vec_id with other vectors need representatives of their own, which are then told apart below zero
    size = rows.count()
    classes = materialize(classes, "grouped", size)
    twice = classes.groupBy("rep").count().filter("count > 1").select("rep", F.lit(True).alias("twice"))
    classes = join_small(classes, materialize(twice, "twice", size), ["rep"])
    own = F.when(F.col("twice"), -1 - F.shiftrightunsigned(F.xxhash64("label", "key"), 2)).otherwise(F.col("rep"))
    classes = materialize(classes.select("label", own.alias("rep"), "n", "raw", "key", F.col("rep").alias("least")), "classes", size)
    counts, edges, _, _ = link(classes.select("label", "rep", "n", "raw"), radius)
    parts = materialize(connected_components(edges), "parts", size)
    figures = classes.join(counts, classes["rep"] == counts["u"], "left").join(parts, F.col("rep") == parts["node"], "left")
    figures = figures.withColumn("part", F.coalesce("component", "rep"))
    least = figures.groupBy("part").agg(F.min("least").alias("component_id"))
    figures = figures.join(least, "part").select(F.col("label").alias("_label"), F.col("key").alias("_key"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    figures = materialize(figures, "figures", size)
    out = rows.select("vec_id", "label", "key").join(figures, F.col("label").eqNullSafe(F.col("_label")) & (F.col("key") == F.col("_key")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: links and component of every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
