"""Near copies by five-word shingles against all pairs."""

import random

import numpy as np
import pytest

from ledgerloom.llm import nearcopy, simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def expected(rows):
    sets = {i: grams(t) for i, t in rows}
    first = {i: i for i in sets}
    linked = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(6):
        for i, j in linked:
            first[i] = first[j] = min(first[i], first[j])
    return {i for i in sets if first[i] == i}


def changed(rng, words, changes):
    new = list(words)
    for at in rng.sample(range(len(new)), changes):
        new[at] = f"new{rng.randrange(10**9)}"
    return " ".join(new)


def rows_of(seed, groups=12, copies=5, changes=(1, 2, 3, 9)):
    rng, rows = random.Random(seed), []
    for base in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((base * 1000, " ".join(words)))
        rows += [(base * 1000 + k, changed(rng, words, changes[k % len(changes)])) for k in range(1, copies + 1)]
    return rows


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return [r.doc_id for r in nearcopy.keep_first(docs).collect()]


def test_drops_copies_from_080(spark):
    rows = rows_of(5)
    rows += [(100_000, ""), (100_001, "  "), (100_002, "one two"), (100_003, "One  two"), (100_004, "one three"), (100_005, None)]
    got = kept(spark, [*rows, (None, rows[0][1])])
    assert None in got
    assert sorted(x for x in got if x is not None) == sorted(expected(rows))


def test_recall_next_to_080(spark):
    rows = rows_of(11, groups=150, copies=1, changes=(4, 4))
    want = expected(rows)
    assert len(want) == 150
    assert len(set(kept(spark, rows)) - want) <= 5


def test_empty_table(spark):
    assert kept(spark, []) == []


@pytest.mark.parametrize(("star", "cap", "piece"), [(4, 4096, 1 << 15), (4, 20, 7), (1000, 4096, 1 << 15)])
def test_large_groups_of_copies(spark, monkeypatch, star, cap, piece):
    for name, value in (("STAR", star), ("CAP", cap), ("PIECE", piece)):
        monkeypatch.setattr(nearcopy, name, value)
    rows = rows_of(7, groups=2, copies=45, changes=(2, 3, 3, 7, 8))
    assert sorted(kept(spark, rows)) == sorted(expected(rows))


def test_similarity_is_exact():
    def of(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return nearcopy.Shingles(raw, np.array([0, len(raw)])).hash

    assert nearcopy.jaccard(of("a b c d e f g"), of("A b c d e f x")) == 2 / 4
    assert nearcopy.jaccard(of(""), of(" ")) == 1


def test_close_pairs_against_plain():
    rng = np.random.default_rng(1)
    for words, radius in ((1, 2), (1, 0), (4, 52), (2, 15), (2, 16)):
        base = rng.integers(0, 1 << 63, (9, words), dtype=np.int64).view(np.uint64)
        fp = base[rng.integers(9, size=400)]
        for _ in range(radius):
            fp[np.arange(400), rng.integers(words, size=400)] ^= np.uint64(1) << rng.integers(64, size=400).astype(np.uint64)
        group = np.sort(rng.integers(8, size=400))
        near = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= radius
        i, j = simhash.close_pairs(group, fp, radius)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a in range(400) for b in range(a + 1, 400) if near[a, b] and group[a] == group[b]}
        q, at = simhash.close_to(fp[:70], fp, radius)
        assert set(zip(q.tolist(), at.tolist(), strict=True)) == {(a, b) for a in range(70) for b in range(400) if near[a, b]}
