"""SimHash, substring dedup, quality rules, mixing and the words they share, each against a plain version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import _words, mixing, quality, simhash, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


def docs(spark, rows):
    """Rows (doc_id, text[, source]) with a column that clashes with results' names."""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "clash") for r in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sample(seed, n=40, vocabulary=60, most=180):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 6))) for _ in range(vocabulary)]
    passage = [rng.choice(vocab) for _ in range(70)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, most))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 15) : rng.randint(50, 70)]
        rows.append((i * 7 % n, " ".join(w) if i % 5 else "\n\t ".join(w)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + " tail"), (102, None), (103, ""), (104, " \n "), (None, rows[3][1]), (105, "x" * 5000)]
    return rows


@given(st.lists(st.text(alphabet="ab \t\n\x85\xa0é漢", max_size=12), max_size=6))
@settings(max_examples=60, deadline=None)
def test_spans_find_the_words(texts):
    got = []
    for _, _, buf, offs in _words.blocks(pa.array(texts, pa.string()), 7):
        starts, ends, first = _words.spans(~_words.SPACE[buf], offs)
        for i in range(len(offs) - 1):
            got.append([buf[a:b].tobytes().decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)])
    assert got == [words_of(t) for t in texts]


def plain_fingerprint(text):
    w = words_of((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_simhash_against_plain(spark):
    rows = sample(1)
    assert [simhash.fingerprint(t) for _, t in rows] == [plain_fingerprint(t) for _, t in rows]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fp = {i: plain_fingerprint(t) for i, t in rows if i is not None}
    linked = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    assert {i: r.component_id for i, r in got.items() if i is not None} == plain_components(fp, linked)
    assert got[None].component_id == got[3 * 7 % 40].component_id
    assert got[102].fp == got[103].fp == got[104].fp == 0


def test_near_links_of_chains_and_crowded_keys(spark):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(0, 1 << 62, 200)}
    base = int(rng.integers(1 << 62))
    for _ in range(300):  # a chain that drifts, all under few keys
        base ^= 1 << int(rng.integers(20))
        fps.add(base)
    fps = sorted(fps)
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    linked = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = plain_components(range(len(fps)), linked)
    for hot in (5, 10_000):
        found = simhash.connected_components(simhash.near_links(classes, hot=hot)).collect()
        got = {i: i for i in range(len(fps))} | {r.node: r.component for r in found}
        assert got == want


def test_simhash_keeps_one_of_each_group(spark):
    kept = simhash.keep_first(docs(spark, [(5, "a b c d"), (2, "a b c d"), (9, "other words here now"), (None, "a b c d")]))
    assert kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 9), (True, None)]


def test_empty_tables(spark):
    none = docs(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert simhash.near_duplicates(none).count() == 0
    assert substring.digests(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert quality.assess(none, labels).count() == 0


def plain_removed(rows, window):
    seen, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k in range(len(w := words_of(t)) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), i)
    for i, t in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and seen[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("seed", "window", "k"), [(1, 50, 20), (2, 50, 20), (3, 12, 5), (4, 8, 8)])
def test_substring_against_plain(spark, seed, window, k):
    rows = sample(seed, vocabulary=60 if window == 50 else 4)
    got = substring.digests(docs(spark, rows).repartition(3), window, k).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_removed(rows, window)))


@pytest.mark.parametrize(("held", "kinds"), [(20, 100), (1000, 2), (60, 3)])
def test_substring_pieces_of_a_large_group(spark, monkeypatch, held, kinds):
    monkeypatch.setattr(substring, "HELD", held)
    monkeypatch.setattr(substring, "KINDS", kinds)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{rng.randint(0, 3)}" for _ in range(rng.randint(0, 40))] + passage + [f"b{rng.randint(0, 3)}" for _ in range(40)])) for i in range(60)]
    got = substring.digests(docs(spark, rows).repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(plain_removed(rows, 50))


def test_substring_rows_with_one_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = substring.digests(docs(spark, [(1, text), (1, text), (1, "z " + text), (2, text)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (1, 0), (2, 60)]


def test_substring_keeps_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    got = {r.doc_id: r for r in substring.without_repeats(docs(spark, [(1, text), (2, "a\n" + text), (3, "as\nis"), (4, None)])).collect()}
    assert (got[1].text, got[2].text, got[3].text, got[4].text) == (text, "a", "as\nis", None)
    assert (got[2].n_chars, got[3].n_chars, got[2].component_id) == (1, 5, "clash")


def test_word_hashes_tell_words_apart():
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 40, 600]))) for _ in range(4000)}
    words = sorted(words | {w + "a" for w in words} | {"", *thue_morse(9)} - {""})
    raw = " ".join(words * 2).encode()
    buf = np.frombuffer(raw, np.uint8)
    starts, ends, _ = _words.spans(~_words.SPACE[buf], np.array([0, len(buf)]))
    h = _words.word_hashes(buf, starts, ends)
    assert (h[: len(words)] == h[len(words) :]).all()
    assert [len(np.unique(h[:, i])) for i in (0, 1)] == [len(words)] * 2


def thue_morse(n):
    """A string over a and b and its complement, which collide under any polynomial hash modulo a power of two."""
    bits = [i.bit_count() & 1 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse(11)
    w = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*w[:20], x, *w[20:49]])), (2, " ".join([*w[:20], y, *w[20:49]])), (3, f"{x}\n{y}\n{x}"), (4, f"{' '.join(w[:7])} {x}\n{' '.join(w[:7])} {y}")]
    d = docs(spark, rows)
    assert {r.doc_id: r.n_removed for r in substring.digests(d).collect()} == dict.fromkeys(range(1, 5), 0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.assess(d, labels).collect()}
    assert [got[i].n_dup_lines for i in (3, 4)] == [1, 0] and got[4].n_repeat_words == 0


def plain_base(text):
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = [False] * len(w)
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            hit[i : i + 8] = [True] * 8
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(hit)


def test_quality_base_counts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "é\n", "# ", "\n", "\t", "cd<"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    rows = [*enumerate(texts), (90, None), (91, ""), (None, "x y z"), (92, "a\r\nb\na\r\nb\na"), (93, "v " * 3000)]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.assess(docs(spark, rows), labels).collect()
    want = {i: plain_base(t) for i, t in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_verdict_against_plain(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"][: 2 + i % 3]) + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(70, rows[5][1]), (70, rows[5][1]), (None, rows[6][1]), (71, None)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(30)] + [(4, 0, 0)], "doc_id long, quality int, toxic int")
    trusted = {i for i in range(0, 30, 4)} - {4}

    def buckets(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        at = np.cumsum([0, *(len(w) + 1 for w in words_of(text))])
        h = [int(x) for x in _words.word_hashes(raw, at[:-1], at[1:] - 1)[:, 0]] if words_of(text) else []
        mixed = lambda x: int(_words.mix(np.array([x & (1 << 64) - 1], np.uint64))[0])
        return [x >> 48 for x in h] + [mixed(a * 3 + b) >> 48 for a, b in zip(h, h[1:], strict=False)]

    raw, good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in rows:
        for b in buckets(t):
            raw[b] += 1
            good[b] += i in trusted
    add = quality.SMOOTHING / quality.BUCKETS
    ratio = np.log((good / good.sum() + add) / (1 + quality.SMOOTHING)) - np.log((raw / raw.sum() + add) / (1 + quality.SMOOTHING))
    for r in quality.assess(docs(spark, rows), labels).collect():
        own = buckets(dict(rows)[r.doc_id])
        score = sum(ratio[b] for b in own) / len(own) if own else 0
        assert r.score == pytest.approx(score, abs=1e-9)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
    one = quality.assess(docs(spark, rows), labels).filter("doc_id = 8").first()
    assert quality.assess(docs(spark, rows), labels, threshold=one.score).filter("doc_id = 8").first().kept == (not one.base_failed)


def test_quality_tells_noise_from_prose(spark):
    rng = random.Random(4)
    prose = ["the cat sat on a mat and saw the dog".split()[rng.randint(0, 4) :] for _ in range(80)]
    good = [(i, " ".join(rng.choice(prose)[0] + " " + " ".join(rng.sample("the cat sat on a mat and saw dog with hat".split(), 9)) for _ in range(6))) for i in range(100)]
    bad = [(1000 + i, " ".join(rng.sample("THE!! CAT!! zz%%% qq$$$ CLICK!! xx### NOW!! yy&&& BUY!!".split(), 9)) * 5) for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:50]] + [(i, 0, 0) for i, _ in bad[:10]], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.assess(docs(spark, good + bad), labels).filter("not base_failed").collect()}
    assert all(v == (k < 1000) for k, v in kept.items())
    assert {r.doc_id for r in quality.keep_good(docs(spark, good + bad), labels).collect()} == {k for k, v in kept.items() if v}


def test_mixing_reaches_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 300))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows += [(300, None, "d"), (None, "x y z", "e"), (None, "x y z", "e"), (5, rows[5][1], "a"), (301, "w " * 20_000, "f")]
    got = mixing.mix(docs(spark, rows))
    found = got.collect()
    assert len(found) == len(rows)
    total = sum(r.size for r in found)
    names = ["a", "b", "c", "d", "e", "f", None]
    size = {s: sum(len(words_of(t)) for _, t, x in rows if x == s) for s in names}
    weight = dict(zip(names, [3, 1, 2, 3, 1, 2, 3], strict=True))
    target, full = {}, set()
    while True:
        rest = 1.5 * total - sum(2 * size[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 2 * size[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    by_size = {size[s]: target[s] for s in names}
    for r in found:
        assert r.taken <= 2 * r.size
        assert r.target == pytest.approx(by_size[r.source_size])
    for s in {r.source_size for r in found}:
        assert abs(sum(r.taken for r in found if r.source_size == s) - by_size[s]) <= 1
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_mixed_documents_hold_the_words_taken(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(10 + i)), "ab"[i % 2]) for i in range(40)]
    d = docs(spark, rows)
    taken = {r.doc_id: r.taken for r in mixing.mix(d).collect()}
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns
    count = {}
    for r in mixed.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + len(words_of(r.text))
        assert words_of(r.text) == words_of(dict((i, t) for i, t, _ in rows)[r.doc_id])[: len(words_of(r.text))]
        assert r.n_chars == len(r.text)
    assert count == {k: v for k, v in taken.items() if v}


def test_schedule_interleaves_evenly(spark):
    rows = mixing.sizes(docs(spark, [(i, "w " * 200, "abc"[i % 3]) for i in range(90)]))
    plan = mixing.schedule(mixing.targets(rows)).orderBy("slot").collect()
    assert len({r.slot for r in plan}) == len(plan)
    keys = [r.key for r in plan]
    total = {k: keys.count(k) for k in set(keys)}
    for k, n in total.items():
        own = [r.rank for r in plan if r.key == k]
        assert own == list(range(n))
        for prefix in range(len(keys)):
            assert abs(keys[:prefix].count(k) - prefix * n / len(keys)) <= 8


def test_every_prefix_of_the_mix_is_near_its_shares(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(20, 60), rng.choice("aaabbc")) for i in range(600)]
    d = docs(spark, rows)
    goal = {r.source_size: r.target for r in mixing.mix(d).collect()}
    mixed = mixing.mixed_documents(d, with_slot=True).collect()
    assert [r.slot for r in mixed] == sorted(r.slot for r in mixed)
    size = {s: sum(len(words_of(t)) for _, t, x in rows if x == s) for s in "abc"}
    whole = sum(goal.values())
    seen = dict.fromkeys("abc", 0)
    for r in mixed:
        seen[r.source] += len(words_of(r.text))
        done = sum(seen.values())
        for s in "abc":
            assert abs(seen[s] - done * goal[size[s]] / whole) <= 0.03 * whole
    assert {s: seen[s] for s in "abc"} == {s: round(goal[size[s]]) for s in "abc"}


def test_rows_alike_in_the_mix(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d e f", "y"), (None, "g h", None), (2, None, "x")]
    mixed = mixing.mixed_documents(docs(spark, rows)).collect()
    taken = mixing.mix(docs(spark, rows)).collect()
    assert sum(len(words_of(r.text)) for r in mixed) <= sum(r.taken for r in taken)
    assert all(len(words_of(r.text)) for r in mixed) and {r.doc_id for r in mixed} <= {1, None}
