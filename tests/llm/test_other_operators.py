"""WARC, HTML text, BPE, language, toxicity and embeddings."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
import regex

from ledgerloom.llm import bpe, htmltext, langid, toxicity, vectors, warc

PAGES = "page_id long, url string, html string, text string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES)


def test_warc_round_trip(spark):
    rows = [
        (1, "u1", "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + "é" * 100),
        (None, "u\r\n2", None),
        (None, None, "y" * 150),
        (3, "u", "y" * 150),
        (3, "u", "y" * 150),
        (9, "u", "y" * 150),
        (2, "u", ""),
        (7, "z", "z" * 99),
        (8, "z", "z" * 99),
        (None, "q", "w" * 300),
        (None, "q", "w" * 300),
        (10, "big", "long " * 50_000),
    ]
    got = sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) for r in warc.round_trip(pages(spark, rows)).collect())))
    want = []
    for i, url, text in rows:
        data = (text or "").encode()
        revisit = text == "y" * 150 and i != 3
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None, url and url.replace("\r", "%0D").replace("\n", "%0A")))
    assert got == sorted(map(str, want))
    assert warc.round_trip(pages(spark, []).limit(0)).count() == 0


def test_warc_selected_records(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i} " * (i + 1) * 10) for i in range(50)]
    warc.write(pages(spark, rows).repartition(3), str(tmp_path / "w"))
    index = warc.index(spark, str(tmp_path / "w"))
    assert index.count() == 50
    chosen = warc.read(index.filter("page_id % 7 = 0"), gap=100, most=3000).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in chosen} == {i: t for i, _, t in rows if i % 7 == 0}
    for r in index.collect():
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            data = f.read(r.length)
        assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"\r\n\r\n")


def test_warc_ranges():
    assert warc.ranges([(0, 10), (10, 5), (30, 5), (100, 5)], gap=20, most=40) == [(0, 35, 3), (100, 105, 1)]
    assert warc.ranges([(0, 100), (100, 5)], gap=20, most=40) == [(0, 100, 1), (100, 105, 1)]


ARTICLE = "<h1>Title &amp; more</h1><p>First one, with commas; and\n  more &eacute; text.<p>Second <b>bold</b>er one, it has a <a href=x>link</a>.</p><ul><li>item<li>other</ul>"
TEXT = "Title & more\n\nFirst one, with commas; and more é text.\n\nSecond bolder one, it has a link.\n\nitem\n\nother"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=1>menu</a></ul></nav><article>{ARTICLE}</article><footer>foot, foot.</footer>",
        f"<body><header>Site name</header><div class='ad'>Buy, now, all of this!</div><main>{ARTICLE}<div class='comments'><p>A comment, it is long, and has many commas, all in all.</div></main><aside>Side, side.</aside></body>",
        f"<body class=has-sidebar><div id=cookie-notice>We use cookies. Yes, we do, and more of it.</div><div class=content><header></header>{ARTICLE}<form><p>Name, please</p></form></div><script>var a='</p><p>no, no, no.';</script></body>",
        f"<body><div id='topMenu'>A, b, c, d and more of the menu.</div><div class='cookiebar'>Cookies, cookies, and more cookies.</div><table><tr><td class=leftSidebar>Links, links, and links again.<td>{ARTICLE}</table><div class='siteFooter'>Foot, foot.</div>",
        ARTICLE,
    ],
)
def test_html_main_text(page):
    assert htmltext.main_text(page) == TEXT


def test_html_edges(spark):
    assert [htmltext.main_text(x) for x in (None, "", "<p>", "<!-- x", "a < b &lt; c", "<p>x", "<div hidden>h</div>")] == ["", "", "", "", "a < b < c", "x", ""]
    got = htmltext.extract(pages(spark, [(1, "u", "<p>a  b"), (None, None, None), (2, "v", "<p>" + "word, " * 20_000)])).collect()
    assert sorted((r.page_id or 0, r.text[:4], r.n_chars) for r in got) == [(0, "", 0), (1, "a b", 3), (2, "word", 119_999)]
    assert htmltext.extract(pages(spark, []).limit(0)).count() == 0


@pytest.fixture(scope="module")
def codecs():
    import tokenizers

    with open(bpe.default_path(), encoding="utf-8") as f:
        return bpe.Codec(f.read()), tokenizers.Tokenizer.from_file(bpe.default_path())


def test_bpe_against_the_library(codecs):
    own, library = codecs
    rng = random.Random(1)
    vocab = [v.replace(bpe.END, "") for v in own.vocab]
    texts = ["", "Hello World's it'll", "ΑΣ ΣΑΣ İstanbul", "a<|endoftext|>b <|startoftext|>", " \x1c\x85 é é 日本語 🎉🎉", "don't 'S", "a" * 3000 + " " + "!" * 999, "\0abc \0<|endoftext|>", *vocab]
    texts += ["".join(rng.choice(vocab) for _ in range(3)) for _ in range(3000)] + ["".join(rng.choice("aabetnsoir é") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    ids, offs = own.encode(texts)
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[offs[i] : offs[i + 1]].tolist() == want
        if i < 500:
            assert own.decode(np.array(want, np.int64)) == library.decode(want, skip_special_tokens=False)


def test_bpe_rejects_other_rules(codecs):
    with open(bpe.default_path(), encoding="utf-8") as f:
        data = json.load(f)
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"decoder": {"type": "ByteLevel"}}, {"added_tokens": [data["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Codec(json.dumps(data | change))


def test_bpe_replaces_clashing_columns(spark, codecs):
    d = spark.createDataFrame([(1, "some text", "clash", "clash")], "doc_id long, text string, ids string, decoded string")
    got = bpe.decode(bpe.encode(d))
    assert sorted(got.columns) == ["decoded", "doc_id", "ids", "text"] and got.first().decoded == "some</w> text</w>"


def test_bpe_columns(spark, codecs):
    own, _ = codecs
    d = spark.createDataFrame([(1, "some text"), (None, None), (2, ""), (2, "")], "doc_id long, text string")
    full = bpe.decode(bpe.encode(d)).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in full) == [(0, 0, ""), (1, 2, "some</w> text</w>"), (2, 0, ""), (2, 0, "")]
    for r in bpe.digests(d, with_ids=True).collect():
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(np.array(r.ids, np.int64)).encode()).hexdigest()
    assert bpe.digests(d.limit(0)).count() == 0


def held_out(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_of_mixed_texts(spark):
    rng = random.Random(3)
    vocab = {"xx": ["thing", "hathe", "ofwith", "andly"], "yy": ["éauque", "leçon", "éreux"], "ru": ["слово", "дело", "время"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(5, 60))), k) for i in range(200) for k in [rng.choice(list(vocab))]]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "123 --", "yy"), (903, "thing thing", None), (None, "слово", "ru")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d)
    assert model.langs == ["ru", "xx", "yy"]
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:200])
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "xx", "ru"]
    assert [got[i].score for i in (900, 901, 902)] == [0, 0, 0] and all(0 <= r.score <= 1 for r in got.values())
    mixed = spark.createDataFrame([(1, "thing hathe andly thing. слово дело время слово!")], "doc_id long, text string")
    spans = langid.identify(mixed, model, with_spans=True).first().spans
    assert [(s.lang, s.start, s.stop) for s in spans] == [("xx", 0, 23), ("ru", 25, 47)]
    empty = langid.fit(d.limit(0))
    assert {r.lang_pred for r in langid.identify(d, empty).collect()} == {"und"}
    assert langid.identify(d.limit(0), model).count() == 0


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        scores = rng.normal(size=(2 * n, 3)).astype(np.float32) * 3
        first = np.array([0, n, n, 2 * n])
        path = langid.viterbi(scores, first, 2.0)
        for lo in (0, n):
            value = lambda p, lo=lo: sum(float(scores[lo + t, k]) for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
            best = max(value([k // 3**t % 3 for t in range(n)]) for k in range(3**n))
            assert value(path[lo : lo + n].tolist()) == pytest.approx(best)


def test_field_against_all_paths():
    rng = np.random.default_rng(2)
    field = toxicity.Field(rng.normal(size=6), np.array([0.0, -1.0, 0.3, 0.8]))
    feats = rng.normal(size=(9, 6))
    first = np.array([0, 4, 4, 9])
    got = field.marginals(feats, first)
    for lo, hi in ((0, 4), (4, 9)):
        n, emit, total = hi - lo, feats[lo:hi] @ field.weights, 0.0
        share = np.zeros(n)
        for k in range(1 << n):
            y = [k >> t & 1 for t in range(n)]
            w = math.exp(sum(e for e, s in zip(emit, y, strict=True) if s) + sum(field.moves[2 * a + b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            share += w * np.array(y)
        assert got[lo:hi] == pytest.approx(share / total)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(5)
    clean, bad = [f"word{i}" for i in range(80)], ["vile", "scumbag", "Rotten"]
    rows, labels = [], []
    for i in range(500):
        w = [rng.choice(clean) for _ in range(rng.randint(3, 80))]
        if toxic := i % 4 == 0:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (None, "a VILE, vile scumbag")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    got = {r.doc_id: r for r in toxicity.tag(d, model).collect()}
    assert all((got[i].score >= 0.5) == bool(t) for i, _, t in labels if held_out(i))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900].score == got[901].score < 0.5
    assert [(s.start, s.stop) for s in got[None].spans] == [(2, 20)] or [(s.start, s.stop) for s in got[None].spans] == [(2, 6), (8, 20)]
    assert {r.score for r in toxicity.tag(d, toxicity.fit(d, lab.limit(0))).collect()} == {0.0}
    assert toxicity.tag(d.limit(0), model).count() == 0


def plain_links(rows):
    links = {i: set() for i in range(len(rows))}
    for i, (_, a, k) in enumerate(rows):
        for j, (_, b, m) in enumerate(rows):
            if i != j and k is not None and k == m and a is not None and b is not None and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[i].add(j)
    return links


def vector_rows(seed=7, groups=12):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(groups):
        centre = rng.normal(size=16)
        for _ in range(60 if c == 0 else int(rng.integers(1, 12))):
            rows.append((len(rows), (centre + rng.normal(size=16) * 0.1 * rng.random()).astype(np.float32).tolist(), c % 2))
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(8)]
    n = len(rows)
    return [*rows, (n, None, 1), (n + 1, rows[0][1], None), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, rows[0][1][:8], 0), (n + 5, [float("inf")] + rows[0][1][1:], 0), (n + 6, [], 0)]


# pivots once, pivots within crowded clusters, tiles, and the exact way after attempts that fail
@pytest.mark.parametrize(("cap", "shard", "goal"), [(4096, 256, 0.95), (40, 20, 0.95), (12, 6, 0.95), (40, 20, 2.0)])
def test_embeddings_against_brute_force(spark, monkeypatch, cap, shard, goal):
    monkeypatch.setattr(vectors.deal, "__defaults__", (cap, shard, False))
    monkeypatch.setattr(vectors, "GOAL", goal)
    monkeypatch.setattr(vectors, "ATTEMPTS", 1 if goal > 1 else 3)
    rows = vector_rows()
    n = len(rows)
    d = spark.createDataFrame([(*r, "clash") for r in rows], f"vec_id long, embedding array<{'double' if cap == 12 else 'float'}>, label int, component_id string")
    got = {r.vec_id: r for r in vectors.near_duplicates(d).collect()}
    links = plain_links([(i, None if v is None or not v else v, k) for i, v, k in rows])
    low = {i: i for i in links}
    for _ in range(n):
        for i, x in links.items():
            for j in x:
                low[i] = low[j] = min(low[i], low[j])
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(map(len, links.values()))
    assert all(got[i].n_links <= len(x) for i, x in links.items())
    assert goal < 1 or all(got[i].n_links == len(x) for i, x in links.items())
    assert {i: r.component_id for i, r in got.items()} == low
    assert all(r.kept == (r.component_id == i) for i, r in got.items())


def test_shards_stay_of_one_size(spark, monkeypatch):
    """Ten times the rows make about ten times the shards, none of them much larger, and no more copies of a row."""
    rng = np.random.default_rng(3)
    figures = []
    for n in (2000, 20_000):
        x = rng.normal(size=(n, 8)).astype(np.float32)
        classes = spark.createDataFrame([("a", i, 1, v.tobytes()) for i, v in enumerate(x)], "label string, rep long, n long, raw binary")
        monkeypatch.setattr(vectors.pivots, "__defaults__", (30, 16))
        dealt = vectors.deal(classes, 2, cap=120, shard=30).groupBy("shard", "t1", "t2").count().collect()
        figures.append((len(dealt) / n, max(r["count"] for r in dealt), sum(r["count"] for r in dealt) / n))
    assert figures[1][0] <= 3 * figures[0][0] and figures[1][1] <= 3 * figures[0][1] and figures[1][2] <= 3 * figures[0][2]


def test_audit_tells_what_it_tested(spark):
    rows = [r for r in vector_rows() if r[0] < 80]
    clean = vectors.clean(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).filter("raw is not null")
    classes = clean.groupBy("label", "key").agg({"vec_id": "min", "raw": "first"}).selectExpr("label", "`min(vec_id)` as rep", "1L as n", "`first(raw)` as raw")
    _, _, recall, tested = vectors.link(classes)
    assert recall >= 0.95 and tested > 20
    none = spark.createDataFrame([], "u long, linked long")
    assert vectors.audit(classes, none)[0] == 0.0
    assert vectors.audit(classes.limit(1), none) == (None, 0)


def test_embeddings_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vectors.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (None, [1.0, 0.0], 1), (2, [5.0, 0.01], 1), (3, [1.0, 0.0], 2)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, kind)).collect()
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id) for r in got))) == sorted(map(str, [(1, 2, 1), (1, 2, 1), (1, 0, 1), (None, 0, None), (2, 2, 1), (3, 0, 3)]))


def test_language_scores_and_paths_against_plain(spark):
    """Counts, candidates, scores and the best path, all by loops over words."""
    rng = random.Random(6)
    vocab = {"aa": ["alpha", "beta", "gamma"], "bb": ["bêta", "gammo", "delto"], "gr": ["λόγος", "και"]}
    rows = [(i, " ".join(rng.choice(vocab[k]) for _ in range(rng.randint(1, 30))), k) for i in range(80) for k in [rng.choice(list(vocab))]]
    rows += [(100, rows[0][1], rows[0][2]), (100, rows[0][1], rows[0][2]), (101, "alpha — “beta” … gamma", "aa"), (102, "x" * 3000 + " alpha" * 3000, "aa"), (103, "123 — …", "aa")]
    d = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid.fit(d)
    words_in = lambda t: regex.findall(r"\p{L}+", t)
    lower = lambda w: bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode())
    trigrams = lambda w: [bytes(x) for x in zip(b"\0" + w, w, w[1:] + b"\0", strict=False)]
    bucket = lambda g: ((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 & 0xFFFFFFFF) >> 16

    def whole(w):
        raw = np.frombuffer(w, np.uint8)
        h = langid.Hasher()
        return int(h.slices(h.sums(raw), np.array([0]), np.array([len(raw)]))[0]) >> 48

    grams, wholes, scripts = ({k: {} for k in vocab} for _ in range(3))
    script = lambda w: "gr" if regex.search(r"\p{Greek}", w) else "la"
    for i, t, k in rows:
        if not held_out(i):
            for w in words_in(t):
                for b in map(bucket, trigrams(lower(w))):
                    grams[k][b] = grams[k].get(b, 0) + 1
                wholes[k][whole(lower(w))] = wholes[k].get(whole(lower(w)), 0) + 1
                scripts[k][script(w)] = scripts[k].get(script(w), 0) + 1
    log = lambda table, x: math.log(table.get(x, 0) + 0.5) - math.log(sum(table.values()) + 0.5 * langid.BUCKETS)

    def plain(t):
        best: dict = {}
        for n, w in enumerate(words_in(t)):
            able = [k for k in vocab if scripts[k].get(script(w), 0) >= 0.01 * sum(scripts[k].values())]
            own = {k: sum(log(grams[k], bucket(g)) for g in trigrams(lower(w))) + log(wholes[k], whole(lower(w))) if k in able else -1e6 for k in vocab}
            if n == 0:
                best = {k: (v, [k]) for k, v in own.items()}
                continue
            top = max(sorted(vocab), key=lambda k: best[k][0])
            best = {k: ((best[k][0], best[k][1] + [k]) if best[top][0] - langid.PENALTY <= best[k][0] else (best[top][0] - langid.PENALTY, best[top][1] + [k])) for k in vocab}
            best = {k: (v + own[k], p) for k, (v, p) in best.items()}
        path = max((best[k] for k in sorted(vocab)), key=lambda x: x[0])[1] if best else []
        share = {k: sum(len(w.encode()) for w, p in zip(words_in(t), path, strict=True) if p == k) for k in sorted(vocab)}
        return (max(share, key=share.get), max(share.values()) / sum(share.values())) if path else ("und", 0.0)

    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(d, model).collect()]
    for i, lang, score in got:
        want = plain(dict((a, b) for a, b, _ in rows)[i])
        assert (lang, score) == (want[0], pytest.approx(want[1], abs=1e-9)), i
    assert len(got) == len(rows)
    assert langid.kinds_of(np.array([0x1090, 0x10D0, 0x2014, 0x201C, 0xE9, 0x4E2D, 0x41F])).tolist()[2:4] == [255, 255]


def test_toxicity_by_plain_counts(spark):
    """Odds of words, marginals and the curve recomputed by loops; repeated rows, clashing columns, long texts and ties."""
    rng = random.Random(8)
    clean, bad = [f"word{i}" for i in range(40)], ["vile", "scumbag"]
    rows, labels = [], []
    for i in range(200):
        w = [rng.choice(clean) for _ in range(rng.randint(3, 30))]
        if i % 3 == 0:
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(300, "calm " * 60_000), (301, rows[0][1]), (301, rows[0][1])]
    d = spark.createDataFrame([(i, t, 1.0, "clash") for i, t in rows], "doc_id long, text string, score double, spans string")
    lab = spark.createDataFrame([*labels, (300, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    train = [(i, t, label) for i, t in rows for j, _, label in [*labels, (300, 1, 0)] if i == j and not held_out(i)]
    n1, n0 = sum(x[2] for x in train), sum(1 - x[2] for x in train)
    odds = {}
    for w in {w for _, t, _ in train for w in t.split()}:
        a, b = sum(w in t.split() for _, t, y in train if y), sum(w in t.split() for _, t, y in train if not y)
        odds[w] = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5)) if a >= toxicity.MIN_DOCS else 0
    hasher = toxicity.Hasher()
    for w, o in odds.items():
        raw = np.frombuffer(w.encode(), np.uint8)
        _, _, _, whole, _ = toxicity._tokens(raw, np.array([0, len(raw)]), hasher)
        assert model.words.of(whole)[0] == pytest.approx(o if o > 1 else 0, abs=1e-5)
    got = toxicity.tag(d, model).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 301}) == 1
    for r in got[:40]:
        raw = np.frombuffer(dict(rows)[r.doc_id].encode(), np.uint8)
        _, _, first, whole, begin = toxicity._tokens(raw, np.array([0, len(raw)]), hasher)
        p = model.field.marginals(toxicity.Field.features(model.words.of(whole), model.words.of(begin), first), first)
        total, top, n = p.sum(), p.max(initial=0), len(p)
        z = model.curve @ [1, math.log(total + 1e-3), math.log(top + 1e-3), math.log(total / max(n, 1) + 1e-5)]
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)))
    assert next(r.score for r in got if r.doc_id == 300) < 0.5
    bounded = toxicity.fit(d, lab, train_rows=60, field_rows=5, field_tokens=50, words_kept=4)
    assert len(bounded.words.keys) <= 4
